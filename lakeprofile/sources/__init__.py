"""Readers that turn files, folders and table logs into DataFrames."""
