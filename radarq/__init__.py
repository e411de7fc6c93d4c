"""radarq: surveillance-message analytics expressed as Spark DataFrame transformations."""
