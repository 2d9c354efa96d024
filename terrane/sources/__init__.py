"""Catalog over a folder of Parquet tables, text inputs, dumps and generated definitions."""
