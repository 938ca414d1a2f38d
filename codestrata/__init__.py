"""PySpark-native analytics over source code, change sets and version history."""
