"""Numeric kernels, error measures and solvers."""
