"""A PySpark-native analysis engine over code facts."""
