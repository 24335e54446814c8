"""A passage engine on Spark: parse, chunk, index, retrieve, evaluate, sync."""
