"""Readers: CSV, JDBC, and the registry of raw files."""
