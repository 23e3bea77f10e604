"""Column-level functions: expressions without a plan of their own."""
