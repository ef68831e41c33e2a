"""A PySpark-native analytics engine for code and document knowledge bases."""
