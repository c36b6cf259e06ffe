"""quarrymint: a Spark-native analytics engine for evaluation, ranking and training-data records."""

__version__ = "0.1.0"
