"""An append-only event log with query-scoped write conditions, on PySpark."""
