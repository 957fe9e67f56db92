"""Document-intelligence and retrieval analytics expressed as Spark plans."""
