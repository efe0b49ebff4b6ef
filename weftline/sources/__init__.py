"""Readers of files other than Parquet: CSV, JSON, XLSX and SQLite."""
