"""keystrata: Spark-native analytics over versioned key-value logs."""

__version__ = "0.1.0"
