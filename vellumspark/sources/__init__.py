"""Files as DataFrames of canonical text."""
