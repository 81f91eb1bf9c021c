"""PySpark-native analytics for source repositories and other graph-shaped data."""
