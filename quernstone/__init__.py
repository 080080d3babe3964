"""quernstone: a Spark-native engine for searching and measuring text collections."""

__version__ = "0.1.0"
