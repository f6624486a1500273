"""Profiling, preparation, predictors, recommenders and metrics as DataFrame operators."""
