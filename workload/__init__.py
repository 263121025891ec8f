"""The registered queries on the driver's tables, and the same questions in SQL."""
