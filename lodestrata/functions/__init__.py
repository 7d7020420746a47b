"""Scalar functions on columns; none of them runs Python on the executors."""
