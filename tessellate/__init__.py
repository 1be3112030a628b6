"""Tessellate: retrieval evaluation and data processing on Spark."""
