"""Readers and writers: parquet tables, essay JSON, mixtures, folds, value pools, CSV/Parquet sinks."""
