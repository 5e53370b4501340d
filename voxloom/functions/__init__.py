"""Scalar functions over header fields."""
