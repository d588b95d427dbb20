"""A Spark-native engine for stores of text: ingestion, retrieval, n-gram statistics, graphs and spectral codes."""
