"""quire: corpus analytics on Spark, expressed as DataFrame and SQL plans."""
