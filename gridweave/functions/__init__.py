"""Column expressions for IEEE double semantics on Spark."""
