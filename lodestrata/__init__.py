"""Spark-first analytics over long, semi-structured documents."""

__version__ = "0.1.0"
