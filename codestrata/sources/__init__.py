"""Readers for parquet tables and file trees."""

from codestrata.sources.tables import read_table

__all__ = ["read_table"]
