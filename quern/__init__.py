"""quern: Spark-native analytics over large (id, value) integer columns."""
