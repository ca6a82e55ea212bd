"""Bulk document-translation analytics on Spark DataFrames."""
