"""A PySpark-native engine for search results, feeds and documents."""
