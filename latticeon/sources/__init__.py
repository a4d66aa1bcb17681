"""Where collections and edges come from: Spark tables, pandas frames, saved versions."""
