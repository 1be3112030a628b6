"""Jobs with a command line each; the work of a job is a function that takes a session."""
