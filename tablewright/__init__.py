"""PySpark-native table preparation, change feeds, keyed tables and tree models."""
