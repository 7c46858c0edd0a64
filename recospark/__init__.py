"""recospark: a PySpark-native recommendation analytics engine."""
