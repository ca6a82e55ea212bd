"""Readers and writers for archives, JSON lines, glossaries and reports."""
