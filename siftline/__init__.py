"""Hybrid lexical and semantic search over documents, expressed as Spark DataFrame plans."""
