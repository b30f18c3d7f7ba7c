"""Readers and writers for transaction tables and message files."""
