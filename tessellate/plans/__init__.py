"""Plans that compose the operators: evaluation, replay, experiments, catalog, reports."""
