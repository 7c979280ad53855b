"""Delimited files, sidecars and parquet snapshots as DataFrames."""
