"""A multi-model analytics engine on Spark: collections, property graph, vectors, geometry and text search in one query."""
