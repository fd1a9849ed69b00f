"""Named queries over the project's tables, and the same in SQL for DuckDB."""
