"""Secret scans in DataFrame functions only: fixed patterns, and sliding-window entropy over candidate strings.

Regular expressions give the matches, ``split`` by the same expression gives what lies between them, and the
running length of both gives the spans, in code points. A candidate string is worked through once: a window of
``WINDOW`` characters slides over it, counts of characters are updated for the one that leaves and the one that
enters, and the sum of c * log2(c), from which the entropy follows, changes by four table entries. The sums are
whole numbers of millionths, so any order of work gives the same verdict.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from txnlake.llm.common import whole_row

# The kinds of the contract, in its order: pattern, group whose length counts, least length.
KINDS = {
    "assign": (r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    "access": (r"AKIA[A-Z0-9]+", 0, 20),
    "hex": (r"[0-9a-f]{24,}", 0, 24),
}

#: Characters of a candidate string, and its least length, which is also the window.
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
WINDOW = 20
CANDIDATE = r"[A-Za-z0-9+/_=-]{20,}"
#: Character classes: the first whose pattern finds something decides, by bits of entropy in a window (null: never a secret).
CLASSES = [
    ("digits", r"^[0-9+/_=-]+$", None),
    ("hex", r"^[0-9A-Fa-f]+$", 3.0),
    ("letters", r"^[A-Za-z]+$", 3.95),
    ("words", r"^[A-Za-z+/_=-]+$", None),
    ("alnum", r"^[A-Za-z0-9]+$", 3.6),
    ("base64", r"", 3.8),
]
#: Candidates with one of these are no secrets: UUIDs, placeholders, counted-up alphabets, runs of one character.
ALLOWED = (
    r"[0-9A-Fa-f]{8}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{12}|[Ee]xample|EXAMPLE|[Pp]laceholder"
    r"|[Cc]hange_?me|[Dd]ummy|[Yy]our[-_]|[Ss]ample|0123456789|abcdefgh|ABCDEFGH|xxxxxx|XXXXXX|000000"
)
SCALE = 1_000_000
#: c * log2(c) in millionths for c from 0 to WINDOW.
TERMS = [0] + [round(c * math.log2(c) * SCALE) for c in range(1, WINDOW + 1)]


def limit(bits: float | None) -> int:
    """Largest sum of terms with which a window has ``bits`` of entropy; -1 if no window may have it."""
    return -1 if bits is None else math.floor(WINDOW * (math.log2(WINDOW) - bits) * SCALE)


SPAN = "array<struct<start:bigint,rank:int,stop:bigint>>"
MASK = "[SECRET]"


def located(text: Column, pattern: str, found: Column) -> Column:
    """Array of (start, stop, text) for ``found``, all matches of ``pattern`` in ``text``."""
    between = F.split(text, pattern, -1)
    step = lambda acc, pair: F.struct(
        (acc["at"] + F.char_length(pair["gap"]) + F.char_length(pair["hit"])).alias("at"),
        F.concat(acc["out"], F.array(F.struct(
            (acc["at"] + F.char_length(pair["gap"])).alias("start"),
            (acc["at"] + F.char_length(pair["gap"]) + F.char_length(pair["hit"])).alias("stop"),
            pair["hit"].alias("text"),
        ))).alias("out"),
    )
    pairs = F.arrays_zip(F.slice(between, F.lit(1), F.size(found)).alias("gap"), found.alias("hit"))
    start = F.struct(F.lit(0).cast("bigint").alias("at"), F.array().cast("array<struct<start:bigint,stop:bigint,text:string>>").alias("out"))
    none = F.array().cast("array<struct<start:bigint,stop:bigint,text:string>>")
    return F.when(F.size(found) > 0, F.aggregate(pairs, start, step, lambda acc: acc["out"])).otherwise(none)


def fixed_spans(text: Column, found: Column, rank: int, pattern: str, group: int, least: int) -> Column:
    """Spans of the matches ``found`` whose ``group`` has ``least`` characters."""
    long_enough = F.filter(
        located(text, pattern, found),
        lambda m: F.char_length(F.regexp_extract(m["text"], pattern, group) if group else m["text"]) >= least)
    return F.transform(long_enough, lambda m: F.struct(m["start"].alias("start"), F.lit(rank).alias("rank"), m["stop"].alias("stop")))


def entropy_span(candidate: Column, most: Column) -> Column:
    """First and last window of ``candidate`` whose sum of terms is ``most`` at most, as struct (first, last); -1 if none."""
    codes = F.transform(F.split(candidate, ""), lambda c: F.instr(F.lit(ALPHABET), c))
    terms = F.lit(TERMS)
    at = lambda counts, code: F.element_at(counts, code)

    def run(codes: Column) -> Column:
        head = F.slice(codes, 1, WINDOW)
        counts = F.transform(F.sequence(F.lit(1), F.lit(len(ALPHABET))), lambda k: F.size(F.filter(head, lambda x: x == k)))
        total = F.aggregate(counts, F.lit(0).cast("bigint"), lambda acc, n: acc + F.element_at(terms, n + 1))
        start = F.struct(counts.alias("counts"), total.alias("sum"), F.lit(-1).alias("first"), F.lit(-1).alias("last"))

        def slide(acc: Column, i: Column) -> Column:
            # i is the 0-based window; window 0 is the start, and each next one loses a character and gains one.
            old, new = F.element_at(codes, F.greatest(i, F.lit(1))), F.element_at(codes, i + WINDOW)
            same = (i == 0) | (old == new)
            n_old, n_new = at(acc["counts"], old), at(acc["counts"], new)
            total = F.when(same, acc["sum"]).otherwise(
                acc["sum"] - F.element_at(terms, n_old + 1) + F.element_at(terms, n_old)
                - F.element_at(terms, n_new + 1) + F.element_at(terms, n_new + 2))
            counts = F.when(same, acc["counts"]).otherwise(F.transform(
                acc["counts"], lambda n, k: n - (k + 1 == old).cast("int") + (k + 1 == new).cast("int")))
            hit = total <= most
            return F.struct(
                counts.alias("counts"), total.alias("sum"),
                F.when(hit & (acc["first"] < 0), i).otherwise(acc["first"]).alias("first"),
                F.when(hit, i).otherwise(acc["last"]).alias("last"),
            )

        return F.aggregate(F.sequence(F.lit(0), F.size(codes) - WINDOW), start, slide, lambda acc: F.struct(acc["first"], acc["last"]))

    # A one-element array binds the codes, so that they are made once.
    return F.element_at(F.transform(F.array(codes), run), 1)


def entropy_limit(candidate: Column) -> Column:
    """Largest sum of terms for the class of ``candidate``; -1 for classes and strings that are never secrets."""
    out = None
    for _, pattern, bits in CLASSES:
        when = F.rlike(candidate, F.lit(pattern))
        out = F.when(when, F.lit(limit(bits))) if out is None else out.when(when, F.lit(limit(bits)))
    return F.when(F.rlike(candidate, F.lit(ALLOWED)), F.lit(-1)).otherwise(out)


def find_secrets(df: DataFrame, text: str = "text") -> DataFrame:
    """``df`` with ``_spans``, all spans of secrets as an array of (start, rank, stop) in this order.

    ``rank`` is 0 to 2 for the fixed kinds and 3 for entropy; ``stop`` is exclusive; both count code points.
    Fixed kinds are leftmost and don't overlap within a kind. An entropy span reaches from the first window with
    enough entropy of a candidate to the last; it is left out if it lies within a span of a fixed kind. Null and
    empty texts have no spans. Rows, their order of columns and repeated rows stay. A column _spans is replaced.
    """
    body = F.coalesce(F.col("_row")[text], F.lit(""))
    found = df.select(whole_row(df)).withColumns({
        **{f"_{k}": F.regexp_extract_all(body, F.lit(p), F.lit(0)) for k, (p, _, _) in KINDS.items()},
        "_candidate": F.regexp_extract_all(body, F.lit(CANDIDATE), F.lit(0)),
    })
    spans = [fixed_spans(body, F.col(f"_{kind}"), rank, *rule) for rank, (kind, rule) in enumerate(KINDS.items())]
    found = found.withColumn("_fixed", F.concat(*spans))
    tried = F.transform(located(body, CANDIDATE, F.col("_candidate")), lambda m: F.struct(
        m["start"].alias("start"), entropy_limit(m["text"]).alias("limit"), m["text"].alias("text")))
    windows = F.transform(F.filter(tried, lambda m: m["limit"] >= 0), lambda m: F.struct(
        m["start"].alias("start"), entropy_span(m["text"], m["limit"]).alias("w")))
    added = F.transform(F.filter(windows, lambda m: m["w"]["first"] >= 0), lambda m: F.struct(
        (m["start"] + m["w"]["first"]).alias("start"), F.lit(len(KINDS)).alias("rank"), (m["start"] + m["w"]["last"] + WINDOW).alias("stop")))
    found = found.withColumn("_added", F.when(F.size("_candidate") > 0, added).otherwise(F.array().cast(SPAN)))
    fresh = F.filter(F.col("_added"), lambda a: ~F.exists(F.col("_fixed"), lambda b: (b["start"] <= a["start"]) & (a["stop"] <= b["stop"])))
    kept = [F.col("_row")[c].alias(c) for c in df.columns if c.lower() != "_spans"]
    return found.select(*kept, F.array_sort(F.concat("_fixed", fresh)).alias("_spans"))


def labelled(spans: Column) -> Column:
    """kind:start:end of every span, comma-joined."""
    kinds = F.lit([*KINDS, "entropy"])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(
        ":", F.element_at(kinds, s["rank"] + 1), s["start"].cast("string"), s["stop"].cast("string"))), ",")


def secret_table(docs: DataFrame) -> DataFrame:
    """doc_id, counts of the fixed kinds, base_sha256 and spans of every document; see `find_secrets`."""
    found = find_secrets(docs.select("doc_id", "text"))
    count = lambda rank: F.size(F.filter("_spans", lambda s: s["rank"] == rank)).cast("long")
    return found.select(
        "doc_id", *[count(i).alias(f"n_{k}") for i, k in enumerate(KINDS)],
        F.sha2(labelled(F.filter("_spans", lambda s: s["rank"] < len(KINDS))), 256).alias("base_sha256"),
        labelled(F.col("_spans")).alias("spans"),
    )


def redact(docs: DataFrame) -> DataFrame:
    """``docs`` with every stretch of secrets in text replaced by ``MASK``; overlapping spans are one stretch."""
    found = find_secrets(docs.select(whole_row(docs), "text"))

    def join(acc: Column, s: Column) -> Column:
        last = F.element_at(acc, -1)
        meets = (F.size(acc) > 0) & (F.try_element_at(acc, F.lit(-1))["stop"] >= s["start"])
        grown = F.concat(
            F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0))),
            F.array(F.struct(last["start"].alias("start"), F.greatest(last["stop"], s["stop"]).alias("stop"))))
        return F.when(meets, grown).otherwise(F.concat(acc, F.array(F.struct(s["start"].alias("start"), s["stop"].alias("stop")))))

    merged = F.aggregate("_spans", F.array().cast("array<struct<start:bigint,stop:bigint>>"), join)
    found = found.withColumn("_merged", F.when(F.size("_spans") > 0, merged))
    text = F.col("text")
    cut = F.transform(F.col("_merged"), lambda s, i: F.concat(
        text.substr(
            F.when(i == 0, 1).otherwise(F.element_at("_merged", F.greatest(i, F.lit(1)))["stop"] + 1).cast("int"),
            (s["start"] - F.when(i == 0, 0).otherwise(F.element_at("_merged", F.greatest(i, F.lit(1)))["stop"])).cast("int")),
        F.lit(MASK)))
    tail = text.substr((F.element_at("_merged", -1)["stop"] + 1).cast("int"), F.char_length(text))
    clean = F.when(F.size("_spans") > 0, F.concat(F.array_join(cut, ""), tail)).otherwise(text)
    found = found.withColumn("_clean", clean)
    return found.select(*[F.col("_clean").alias(c) if c == "text" else F.col("_row")[c].alias(c) for c in docs.columns])
