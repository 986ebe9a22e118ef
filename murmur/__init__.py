"""murmur: a PySpark-native engine for noisy text streams."""
