"""PySpark-native analytics for text and time-aligned speech datasets."""
