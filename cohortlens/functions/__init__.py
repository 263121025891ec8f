"""Column-level functions; each takes and returns ``Column`` objects and stays in codegen where Spark can."""
