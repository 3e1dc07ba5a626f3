"""tessera: a PySpark-native engine for search-agent training and evaluation data."""
