"""newsloom: a PySpark-native news-analytics engine."""
