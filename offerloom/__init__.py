"""Price comparison and entity matching as declarative Spark plans."""
