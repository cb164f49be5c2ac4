"""semcodec: Spark-native analytics over dictionary-coded meaning sequences."""
