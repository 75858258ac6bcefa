"""corvane: a Spark-native engine for series and table analytics."""
