"""DataFrame operators: pure functions (DataFrame..., params) -> DataFrame."""
