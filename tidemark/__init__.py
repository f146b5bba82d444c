"""Track, co-occurrence and evidence analytics as Spark DataFrame functions."""
