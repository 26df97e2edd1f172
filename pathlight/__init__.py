"""A Spark-native engine for network path tomography and large text corpora."""
