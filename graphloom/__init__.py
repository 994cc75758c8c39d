"""A Spark-native engine for layered knowledge graphs, retrieval and corpus preparation."""
