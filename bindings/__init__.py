"""Queries over the test tables, each with the SQL it must agree with where SQL can say it."""

from bindings import anomaly, ledger, messages, reports, rule_tables, series, storage, tables  # noqa: F401
from bindings.registry import ORACLES, QUERIES  # noqa: F401
