"""engrama: a Spark-native analytics engine for long-lived memory data."""

__version__ = "0.1.0"
