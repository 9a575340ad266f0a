"""Glycoflow: physiological event analytics for many subjects on Apache Spark."""

__version__ = "0.1.0"
