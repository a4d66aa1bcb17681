"""Column expressions: predicates, scalars, vectors, geometry and text; all planned by Catalyst, no Python workers."""
