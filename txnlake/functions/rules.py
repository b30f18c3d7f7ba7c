"""Rule lists: reading them from files and handing them to Spark as small tables."""

from __future__ import annotations

import json
import logging
import re
from collections.abc import Sequence
from pathlib import Path

import pyarrow as pa
from py4j.protocol import Py4JJavaError
from pyspark.errors import IllegalArgumentException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

log = logging.getLogger(__name__)


def load_rule_file(path: str) -> dict:
    """The mapping in a YAML or JSON rule file."""
    suffix = Path(path).suffix.lower()
    if suffix not in (".yaml", ".yml", ".json"):
        raise ValueError(f"unsupported rule file: {path}")
    with open(path, encoding="utf-8") as f:
        if suffix == ".json":
            rules = json.load(f)
        else:
            import yaml

            rules = yaml.safe_load(f)
    if not isinstance(rules, dict):
        raise ValueError(f"a rule file must hold a mapping: {path}")
    return rules


def category_rules(rules: dict) -> dict:
    """Check a category rule mapping: ``rules`` and/or ``categories``, plus an optional ``fallback``."""
    if not isinstance(rules, dict) or not ("rules" in rules or "categories" in rules):
        raise ValueError("category rules need a 'rules' or a 'categories' list")
    return rules


def alias_pairs(merchants: Sequence[dict]) -> list[tuple[str, str]]:
    """(alias in lower case, canonical name), one per alias; a later name for an alias wins."""
    found: dict[str, str] = {}
    for entry in merchants:
        if entry.get("canonical"):
            found.update({a.lower(): entry["canonical"] for a in entry.get("aliases", []) if isinstance(a, str)})
    return list(found.items())


def account_rows(accounts: dict) -> list[dict]:
    """Account table rows from a mapping of card suffix to account data."""
    rows = []
    for suffix, data in accounts.items():
        if not isinstance(data, dict) or not {"account_id", "account_type"} <= set(data):
            raise ValueError(f"account {suffix} needs account_id and account_type")
        rows.append({"card_suffix": str(suffix), **data})
    return rows


def local_table(spark: SparkSession, rows: list[dict], schema: str) -> DataFrame:
    """A rule list as a local relation, whose size the optimizer knows when it picks a join."""
    typed = StructType.fromDDL(schema)
    return spark.createDataFrame(pa.Table.from_pylist(rows, schema=to_arrow_schema(typed)), schema=typed)


def java_pattern(pattern: str) -> str:
    """A pattern matched without regard to case, over Unicode."""
    return f"(?iuU){pattern}"


def literal(pattern: str) -> str | None:
    """The text, in lower case, that a pattern of plain ASCII or caseless Arabic letters stands for; None for any other."""
    if not re.fullmatch(r"(?:[A-Za-z0-9 _-]|[\u0621-\u064A]|\\[.*-])+", pattern):
        return None
    return pattern.replace("\\", "").lower()


def needed_words(pattern: str) -> list[str] | None:
    """Words one of which is in every folded text that a pattern finds something in, as it begins or ends with a group of them.

    None if the pattern has another form. Words hold no digits and marks, which may be written in several ways.
    """
    flat, last = re.sub(r"\\.|\[(?:\\.|[^\]\\])*\]", "x", pattern), None
    while flat != last:
        flat, last = re.sub(r"\([^()]*\)", "x", flat), flat
    if "|" in flat:
        return None
    group = r"\((?:\?:)?([^()\[\]]+)\)"
    for found in (re.match(group + r"(?![?*{])", pattern), re.search(r"(?<!\\)" + group + "$", pattern)):
        words = [literal(w) for w in found[1].split("|")] if found else [None]
        if all(w and not re.search(r"[\d.,]", w) for w in words):
            return words
    return None


def valid_pattern(pattern: str) -> bool:
    """Whether the expression compiles where it will run: in the JVM."""
    compiler = SparkSession.active()._jvm.java.util.regex.Pattern
    try:
        compiler.compile(java_pattern(pattern))
        return True
    except (IllegalArgumentException, Py4JJavaError):
        log.warning("pattern skipped: %s", pattern)
        return False


def first_match(choices: Sequence[tuple[Column, int]]) -> Column:
    """The number of the first condition that holds, else NULL."""
    if not choices:
        return F.lit(None).cast("int")
    return F.coalesce(*[F.when(cond, F.lit(i)) for cond, i in choices])
