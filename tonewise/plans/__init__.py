"""Whole jobs built from the operators: train, evaluate, run."""
