"""Nonlinear time-series analytics on Spark."""
