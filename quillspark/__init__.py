"""A Spark-native engine for analysing scholarly-text corpora."""
