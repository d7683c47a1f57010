"""Reports, business-rule jobs, integrity audits, request tables and the key registry (with DuckDB oracles)."""
