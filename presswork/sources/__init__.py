"""Readers and writers: feed files, JDBC, tables."""
