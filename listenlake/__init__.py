"""PySpark-native analytics over listening histories and other event-per-row activity data."""
