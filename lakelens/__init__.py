"""A PySpark-native analytics engine for lakehouse metadata and data."""
