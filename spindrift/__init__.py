"""Spark-native analytics for catalogues, time series, intervals, transcripts and training data."""
