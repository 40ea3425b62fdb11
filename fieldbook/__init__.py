"""PySpark-native registry analytics."""
