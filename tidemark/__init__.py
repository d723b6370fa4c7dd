"""tidemark: transaction monitoring on Spark, as plain DataFrame functions."""

__version__ = "0.1.0"
