"""codeloom: a Spark-native analytics engine over property graphs of source-code facts."""

__version__ = "0.1.0"
