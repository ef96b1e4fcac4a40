"""Record resolution and data quality on Apache Spark, as DataFrame functions."""
