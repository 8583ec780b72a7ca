"""Rhythm-level analytics on Spark: DataFrame operators over whole corpora of levels."""
