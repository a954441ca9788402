"""Word-origin analytics expressed as Spark logical plans."""
