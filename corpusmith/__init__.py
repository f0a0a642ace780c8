"""corpusmith: Spark-native analytics for corpora of source code, predictions and text."""
