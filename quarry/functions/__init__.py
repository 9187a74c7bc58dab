"""Scalar functions and the regular-expression dialect."""
