"""Weekly cross-sectional analytics expressed as Spark DataFrame jobs."""
