"""assayer: Spark-native screening of very large item libraries on a small scoring budget."""
