"""Text, number and date column functions."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from txnlake.functions.fixed_values import (
    ARABIC_DIGITS_AND_MARKS,
    INVISIBLE_CHARACTERS,
    TABLE_DATE_FORMATS,
    WESTERN_DIGITS_AND_MARKS,
)


def stripped(col: Column) -> Column:
    """Trim every kind of white space, not only blanks."""
    return F.regexp_replace(col, r"(?U)^\s+|\s+$", "")


def blank_to_null(col: Column) -> Column:
    return F.nullif(stripped(col), F.lit(""))


def collapsed(col: Column) -> Column:
    """Trim, and turn runs of white space into one blank."""
    return F.trim(F.regexp_replace(col, r"(?U)\s+", " "))


def folded(col: Column) -> Column:
    """Lower case, and the four letters beyond ASCII that equal an ASCII one without regard to case as that one."""
    return F.lower(F.translate(col, "\u0130\u0131\u017f\u212a", "iisk"))


def merchant_key(col: Column) -> Column:
    """The form in which merchant names are compared; blank becomes NULL."""
    return blank_to_null(F.lower(col))


FORMAT_SHAPES = {
    "yyyy": r"\d{4}", "MMMM": r"\p{L}+", "MMM": r"\p{L}{3}", "SSSSSS": r"\d{6}",
    "M": r"\d{1,2}", "d": r"\d{1,2}", "H": r"\d{1,2}", "m": r"\d{1,2}", "s": r"\d{1,2}",
}


def date_shape(fmt: str) -> str:
    """A pattern for the text a date format can read."""
    tokens = re.findall(r"y+|M+|d+|H+|m+|s+|S+|'[^']*'|.", fmt)
    return "^" + "".join(FORMAT_SHAPES.get(t) or re.escape(t.strip("'") if len(t) > 1 else t) for t in tokens) + "$"


def parse_timestamp(col: Column, formats: Sequence[str] = TABLE_DATE_FORMATS) -> Column:
    """The first format that parses wins; NULL when none does.

    A failed parse costs an exception in the JVM, so a format is tried only on text of its shape.
    """
    return F.coalesce(*[F.when(col.rlike(date_shape(f)), F.try_to_timestamp(col, F.lit(f))) for f in formats])


def reformat_date(col: Column, formats: Sequence[str] = TABLE_DATE_FORMATS, out: str = "yyyy-MM-dd") -> Column:
    """Date text in one format; unparsable text stays as it is."""
    return F.coalesce(F.date_format(parse_timestamp(col, formats), out), col)


def to_number(col: Column) -> Column:
    """Number from text with currency signs, thousands commas or blanks; NULL when it is none."""
    return F.regexp_replace(col, r"(?U)[$£€¥,\s]", "").try_cast("double")


def decimal_text(col: Column) -> Column:
    """Amount text without thousands commas and blanks."""
    return blank_to_null(F.regexp_replace(col, "[, ]", ""))


def western_digits(col: Column) -> Column:
    return F.translate(col, ARABIC_DIGITS_AND_MARKS, WESTERN_DIGITS_AND_MARKS)


def sanitized(col: Column) -> Column:
    """Trim, drop invisible marks, one blank instead of many; tabs stay."""
    visible = F.regexp_replace(stripped(col), f"[{INVISIBLE_CHARACTERS}]", "")
    return F.regexp_replace(visible, " +", " ")


def repaired(col: Column) -> Column:
    """Undo UTF-8 read as Latin-1 wherever the round trip is lossless, then trim."""
    is_latin = col.rlike(r"^[\x00-\xFF]*$") & col.rlike(r"[\x80-\xFF]")
    again = F.try_validate_utf8(F.encode(F.when(is_latin, col), "ISO-8859-1").cast("string"))
    return stripped(F.coalesce(again, col))


def combined(cols: Sequence[str]) -> Column:
    """Text columns joined by blanks, skipping NULL and blank ones."""
    return F.trim(F.concat_ws(" ", *[F.when(F.col(c).cast("string").rlike(r"(?U)\S"), F.col(c)) for c in cols]))


def words(*cols: Column) -> Column:
    """Distinct lower-case words of some text columns."""
    return F.array_distinct(F.split(F.lower(F.concat_ws(" ", *cols)), r"(?U)\W+"))


def split_list(col: Column) -> Column:
    """Parts of a comma-joined list, trimmed, empty ones dropped."""
    return F.filter(F.transform(F.split(col, ","), lambda t: F.trim(t)), lambda t: t != "")


def json_strings(col: Column) -> Column:
    """A JSON array of strings; text that is no array gives NULL."""
    return F.from_json(col, "array<string>")


def sha256(*cols: Column) -> Column:
    """SHA-256 over ``|``-joined parts, absent parts as empty text."""
    return F.sha2(F.concat_ws("|", *[F.coalesce(c.cast("string"), F.lit("")) for c in cols]), 256)


def row_id(*cols: Column) -> Column:
    """A row id: from columns that name the row, the same on every run; random without any."""
    if not cols:
        return F.uuid()
    digest = sha256(*cols)
    cuts = ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))
    return F.concat_ws("-", *[F.substring(digest, start, length) for start, length in cuts])


@F.pandas_udf(T.StringType())
def _nfc(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: t if t is None else unicodedata.normalize("NFC", t))


def nfc(col: Column) -> Column:
    """Canonical composition; plain ASCII needs none and becomes no work for Python."""
    return F.coalesce(_nfc(F.when(col.rlike(r"[^\x00-\x7F]"), col)), col)


def normal_text(col: Column, compose: bool = True) -> Column:
    """NFC, trimmed, single blanks; blank becomes NULL."""
    return F.nullif(collapsed(nfc(col) if compose else col), F.lit(""))
