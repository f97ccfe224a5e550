"""Readers, the adapter for the test tables, and writers."""
