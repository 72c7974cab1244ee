"""Spark-native analytics over corpora of postings and the documents matched to them."""
