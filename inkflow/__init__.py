"""A document and retrieval engine for Spark: chunking, structure, hybrid search, catalogue."""
