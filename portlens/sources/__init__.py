"""Readers and writers: NDJSON, Parquet tables, derived test banners."""
