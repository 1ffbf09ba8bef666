from .fixtures import fixture, duckdb_with  # noqa: F401
