"""Readers and writers. Formats without a Spark reader are landed as text, JSON or Parquet first."""
