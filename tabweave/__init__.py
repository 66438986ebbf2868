"""PySpark-native profiling, cleaning and repair of tabular data."""
