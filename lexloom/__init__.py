"""lexloom: a Spark-native text retrieval and corpus analytics engine."""

__version__ = "0.1.0"
