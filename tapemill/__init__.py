"""tapemill: a Spark-native analytics engine for daily market time series."""

__version__ = "0.1.0"
