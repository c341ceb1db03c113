"""Scalar, statistical and signal functions."""
