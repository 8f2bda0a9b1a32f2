"""quern: a PySpark-native engine for consolidating and evaluating extracted recommendations."""
