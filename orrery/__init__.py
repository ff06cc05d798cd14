"""A PySpark-native analytics engine for code graphs that span services."""
