"""Graph edge partitioning and data preparation on PySpark."""

__version__ = "0.1.0"
