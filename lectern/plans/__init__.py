"""Registered queries, the tables they derive and their SQL twins."""
