"""PySpark-native analytics over program-flow data."""
