"""Every operator bound to the test tables, with parameters, and the same query in SQL for DuckDB."""
