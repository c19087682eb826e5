"""vitrine: a Spark-native engine for tagged media catalogues."""
