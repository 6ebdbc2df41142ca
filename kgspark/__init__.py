"""Knowledge-graph and document analytics expressed as Spark DataFrame plans."""
