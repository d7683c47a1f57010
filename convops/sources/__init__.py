"""Typed platform tables: schemas and key metadata, binding from the test tables, versioned parquet store."""
