"""A PySpark-native engine for agent memory data and training-data pipelines."""
