"""sortkit: sorting, range partitioning and shuffle-style analytics on PySpark."""

__version__ = "0.1.0"
