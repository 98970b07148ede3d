"""twinarm: a PySpark-native engine for two-arm interval data."""
