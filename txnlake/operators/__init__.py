"""Operators over transaction tables, grouped by the kind of work they do."""
