"""A PySpark-native engine for literature graphs."""
