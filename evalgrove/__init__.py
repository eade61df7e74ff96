"""evalgrove: Spark-native analytics over agent traces, labels, judge scores and corpora."""
