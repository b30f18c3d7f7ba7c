"""Operators of a training-data pipeline, and their queries (`txnlake.llm.queries`)."""
