"""Composed jobs: the batch ETL, refresh, named queries and their SQL oracle."""
