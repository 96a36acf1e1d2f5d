"""A Spark-native engine for cleaning, merging, chunking and searching records from imperfect sources."""
