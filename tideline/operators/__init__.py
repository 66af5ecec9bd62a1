"""Projection operators: reducers, version order, folds, batches, sinks and checks."""
