"""Document analytics and retrieval as Spark plans."""
