"""Scalar functions over Spark columns."""
