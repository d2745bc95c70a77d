"""Column expressions: every per-row rule, as Catalyst expressions (no Python UDFs)."""
