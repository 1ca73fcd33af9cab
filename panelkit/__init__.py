"""A PySpark-native research engine for panels (entity x date)."""
