"""A PySpark-native entity-resolution engine."""
