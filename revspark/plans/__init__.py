"""Query catalogue: registered Spark plans and their DuckDB oracle twins."""
