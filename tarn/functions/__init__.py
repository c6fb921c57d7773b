"""Column expressions with explicit null, rounding and order semantics."""
