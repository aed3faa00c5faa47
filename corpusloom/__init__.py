"""corpusloom: Spark-native text-corpus preparation, retrieval and retrieval-quality analysis."""
