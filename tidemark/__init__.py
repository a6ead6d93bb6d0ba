"""tidemark: a PySpark-native analytics engine for noisy social and feedback data."""
