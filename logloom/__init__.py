"""logloom: a Spark-first log analytics engine."""

__version__ = "0.1.0"
