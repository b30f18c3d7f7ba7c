"""Quality rules: fixed limits, and robust multivariate outliers for each language and source.

One pass over the texts gives whole-number statistics. Seven ratios of them, transformed and put on a grid, are a vector for
each document. For each language and source a minimum-covariance-determinant estimate is found by concentration
steps from three starts: take the half of the rows with the smallest distances, take their mean and covariance, and so
on; the smallest determinant wins. A step is one aggregation by group, start and distance bin; sums of whole numbers
don't depend on order, so reruns agree.

A distance is taken under the covariance plus what the document's own ratios vary by chance, which follows from its
length alone: one repeated line among ten may be chance, a hundred among a thousand are not. Rows whose Mahalanobis
distance is beyond ``CUTOFF`` are rejected.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from txnlake.llm.common import give_back, whole_row
from txnlake.plans.groups import durable

MIN_WORDS = 10
MAX_REPEAT_PERCENT = 20
SYMBOLS = "#*$%&|<>"
SPACES = " \t\n\r\x0b\x0c"

#: Vector components lie on a grid of 1 / GRID and within +-LIMIT.
GRID, LIMIT = 64, 16
FEATURES = ("word_length", "symbols", "capitals", "marks", "dup_lines", "repeats", "doubles")
P = len(FEATURES)
#: The 0.9999 quantile and the median of chi-squared with P degrees of freedom: squared distances of normal vectors.
CUTOFF, MEDIAN = 29.88, 6.346
#: Squares of the most that each component reaches; more repeated words fail the fixed rules.
REACH = (float(LIMIT) ** 2, 1.0, 1.0, 1.0, 1.0, MAX_REPEAT_PERCENT / 100, 1.0)
#: Concentration steps from each start; the spread that takes all rows into the first half.
STEPS, STARTS, WIDE = 5, range(3), 1e12
#: Groups with fewer rows are judged by the estimate of a wider group.
MIN_ROWS = 4 * (P + 1)
#: Groups up to this many are sent to all executors as parameters; more are joined, with hot groups split.
BROADCAST_GROUPS = 20_000
SALT = 64
BINS_PER_OCTAVE = 16

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_letters", "n_marks", "n_doubles")

_KIND = np.full(256, 0, dtype=np.uint8)  # 1 upper, 2 lower and other letters' bytes, 3 marks, 0 the rest
_KIND[65:91], _KIND[97:123], _KIND[128:] = 1, 2, 2
_KIND[[b for b in range(33, 127) if not chr(b).isalnum() and chr(b) not in SYMBOLS]] = 3


def counts(text: str | None) -> tuple[int, ...]:
    """The statistics COUNTS of a whole text; all 0 for null."""
    text = text or ""
    data = text.encode()
    words = data.split()
    lines = [x for x in text.split("\n") if x.strip(SPACES)]
    kinds = np.bincount(_KIND[np.frombuffer(data, dtype=np.uint8)], minlength=4)
    n = len(words)
    repeated = 0
    if n > 5:
        local: dict[bytes, int] = {}
        ids = np.array([local.setdefault(w, len(local)) for w in words], dtype=np.uint64)
        if len(local) < n:
            # Windows are compared by a 64-bit polynomial over well-mixed numbers of the words.
            ids = np.frombuffer(b"".join([xxhash.xxh3_64_digest(w) for w in local]), dtype=np.uint64)[ids.astype(np.int64)]
            mixed = np.zeros(n - 4, dtype=np.uint64)
            for i in range(5):
                mixed = mixed * np.uint64(0x9E3779B97F4A7C15) + ids[i:i + n - 4]
            _, place, often = np.unique(mixed, return_inverse=True, return_counts=True)
            twice = (often[place] > 1).astype(np.int64)
            change = np.zeros(n + 1, dtype=np.int64)
            change[:n - 4] += twice
            change[5:] -= twice
            repeated = int((np.cumsum(change)[:n] > 0).sum())
    return (
        n, len(text) - sum(text.count(c) for c in SPACES), sum(text.count(c) for c in SYMBOLS), len(lines) - len(set(lines)),
        repeated, len(lines), int(kinds[1]), int(kinds[1] + kinds[2]), int(kinds[3]),
        sum(a == b for a, b in zip(words, words[1:])),
    )


def _counter(keys: list[str], schema: pa.Schema):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        give_back()
        for batch in batches:
            found = [counts(t.as_py()) for t in batch.column("text")]
            columns = list(zip(*found, strict=True)) if found else [[] for _ in COUNTS]
            arrays = [batch.column(k) for k in keys] + [pa.array(c, pa.int64()) for c in columns]
            yield pa.RecordBatch.from_arrays([a.cast(f.type) for a, f in zip(arrays, schema, strict=True)], schema=schema)

    return work


def statistics(docs: DataFrame) -> DataFrame:
    """doc_id, lang, source, a hash of the row's verdict-relevant columns (``mark``), COUNTS, base_failed, x0 to x6."""
    keys = ["doc_id", "lang", "source", "mark"]
    kinds = [pa.int64(), pa.string(), pa.string(), pa.int64()]
    schema = pa.schema([*zip(keys, kinds, strict=True), *((c, pa.int64()) for c in COUNTS)])
    slim = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"), F.col("source").cast("string").alias("source"),
        F.xxhash64("text", "lang", "source").alias("mark"), "text")
    ddl = "doc_id long, lang string, source string, mark long, " + ", ".join(f"{c} long" for c in COUNTS)
    out = slim.mapInArrow(_counter(keys, schema), ddl)
    words = F.greatest("n_words", F.lit(1))
    ratio = lambda a, b: F.sqrt(F.col(a) / F.greatest(b, F.lit(1)))
    vector = [
        F.log2(F.greatest(F.col("word_chars"), F.lit(1)) / words), ratio("n_symbols", "n_words"), ratio("n_upper", "n_letters"),
        ratio("n_marks", "n_words"), ratio("n_dup_lines", "n_lines"), ratio("n_repeat_words", "n_words"),
        ratio("n_doubles", "n_words"),
    ]
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    place = lambda x: F.round(F.least(F.greatest(x, F.lit(-LIMIT)), F.lit(LIMIT)) * GRID).cast("long")
    return out.withColumn("base_failed", failed).withColumns({f"x{i}": place(x) for i, x in enumerate(vector)})


# Estimates travel as rows (key, start, n, center, cov, det): center and cov in grid units, cov row by row.
ESTIMATE = "key string, start int, n long, center array<double>, cov array<double>, det double"
ESTIMATE_COLUMNS = ["key", "start", "n", "center", "cov", "det"]


def noise(n_words: np.ndarray, n_lines: np.ndarray, n_letters: np.ndarray) -> np.ndarray:
    """Variances (in grid units) that the components of a text of this length have by chance, and by the grid.

    A share k / n has a root whose variance is near 1 / 4n, whatever the share. Repeated words come ten at a time, as two
    windows of five. Word lengths vary by half of their mean, and their logarithms so much less as there are more words.
    Chance is never so large that a share could not reach the cutoff by itself.
    """
    words, lines, letters = (np.maximum(x, 1).astype(float) for x in (n_words, n_lines, n_letters))
    by_chance = [0.5 / words, 0.25 / words, 0.25 / letters, 0.25 / words, 0.25 / lines, 2.5 / words, 0.25 / words]
    return GRID**2 * np.minimum(np.stack(by_chance, axis=1), 0.95 * np.array(REACH) / CUTOFF) + 1.0


def distances(x: np.ndarray, chance: np.ndarray, center: np.ndarray, cov: np.ndarray) -> np.ndarray:
    """Squared Mahalanobis distances, each under the covariance plus the row's own noise."""
    off = x - center
    own = cov[None] + chance[:, :, None] * np.eye(P)[None]
    return np.maximum(np.einsum("ni,ni->n", off, np.linalg.solve(own, off[:, :, None])[:, :, 0]), 0.0)


def _row(key: str, start: int, n: int, center: np.ndarray, cov: np.ndarray) -> tuple:
    # One grid step in each direction, so that a group without any spread has a determinant.
    return key, start, n, center.tolist(), cov.reshape(-1).tolist(), float(np.linalg.slogdet(cov + np.eye(P))[1])


def _weighted_median(values: np.ndarray, weights: np.ndarray) -> float:
    order = np.argsort(values, kind="stable")
    upto = np.cumsum(weights[order])
    return float(values[order][np.searchsorted(upto, (upto[-1] + 1) // 2)])


def _starts(rows: pd.DataFrame) -> pd.DataFrame:
    """Three starts from counts of grid values (k, value, n): medians with their deviations, medians without any spread
    but the noise, and medians with so much spread that the first half is all rows, hence their mean and covariance.
    """
    center, spread, n = [], [], int(rows.n[rows.k == 0].sum())
    for k in range(P):
        values, weights = rows.value[rows.k == k].to_numpy(float), rows.n[rows.k == k].to_numpy(np.int64)
        center.append(_weighted_median(values, weights))
        spread.append(1.4826 * _weighted_median(np.abs(values - center[-1]), weights))
    key, center = rows.key.iloc[0], np.array(center)
    covs = [np.diag(np.square(spread)), np.zeros((P, P)), np.eye(P) * WIDE]
    return pd.DataFrame([_row(key, i, n, center, c) for i, c in enumerate(covs)], columns=ESTIMATE_COLUMNS)


def _half(rows: pd.DataFrame) -> tuple[pd.DataFrame, int]:
    """The bins of smallest distance that hold at least (n + P + 1) / 2 rows."""
    rows = rows.sort_values("bin")
    n = int(rows.n.sum())
    upto = rows.n.cumsum()
    return rows[(upto - rows.n) < min(n, (n + P + 1) // 2)], n


def _step(rows: pd.DataFrame) -> pd.DataFrame:
    half, n = _half(rows)
    h = half.n.sum()
    center = np.array([half[f"s{i}"].sum() for i in range(P)]) / h
    cov = np.zeros((P, P))
    for i, j in PRODUCTS:
        cov[i, j] = cov[j, i] = half[f"s{i}_{j}"].sum() / h - center[i] * center[j]
    return pd.DataFrame([_row(rows.key.iloc[0], int(rows.start.iloc[0]), n, center, cov)], columns=ESTIMATE_COLUMNS)


def _scale(rows: pd.DataFrame) -> pd.DataFrame:
    """How far a covariance must be multiplied so that the median of distances is that of a normal vector; 1 at least."""
    half, n = _half(rows)
    median = 2 ** ((half.bin.max() + 1) / BINS_PER_OCTAVE) - 1
    return pd.DataFrame([(rows.key.iloc[0], max(1.0, median / MEDIAN))], columns=["key", "scale"])


PRODUCTS = [(i, j) for i in range(P) for j in range(i, P)]
_SUMS = ["n", *[f"s{i}" for i in range(P)], *[f"s{i}_{j}" for i, j in PRODUCTS]]
_BINS = pa.schema([("key", pa.string()), ("start", pa.int32()), ("bin", pa.int32()), *((c, pa.int64()) for c in _SUMS)])


def _arrays(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    x = np.stack([batch.column(f"x{i}").to_numpy().astype(float) for i in range(P)], axis=1)
    return x, noise(*[batch.column(c).to_numpy() for c in ("n_words", "n_lines", "n_letters")])


def _of_key(batch: pa.RecordBatch, keys: list, sent) -> Iterator[tuple[str, np.ndarray, list]]:
    """Each key of a batch with its rows and its estimates (start, center, cov), sent along or joined to the rows."""
    names, first, place = np.unique(np.array(keys, dtype=object), return_index=True, return_inverse=True)
    for k, name in enumerate(names.tolist()):
        rows = np.flatnonzero(place == k)
        found = sent.value[name] if sent is not None else batch.column("estimates")[int(first[k])].as_py()
        yield name, rows, [(e["start"], np.array(e["center"]), np.array(e["cov"]).reshape(P, P)) for e in found]


def _binner(sent):
    """Counts, sums and products of the rows of each key, start and bin of distances, batch by batch."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x, chance = _arrays(batch)
            out: list[list] = [[] for _ in _BINS]
            for key, rows, found in _of_key(batch, batch.column("key").to_pylist(), sent):
                mine, own = x[rows], chance[rows]
                weights = [np.ones(len(rows)), *mine.T, *[mine[:, i] * mine[:, j] for i, j in PRODUCTS]]
                for start, center, cov in found:
                    bins = np.floor(np.log2(1 + distances(mine, own, center, cov)) * BINS_PER_OCTAVE).astype(np.int32)
                    names, place = np.unique(bins, return_inverse=True)
                    # Sums of whole numbers far below 2 ** 53, so exact in any order.
                    sums = [np.bincount(place, w).astype(np.int64) for w in weights]
                    for column, values in zip(out, [[key] * len(names), [start] * len(names), names, *sums], strict=True):
                        column.extend(values)
            yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(out, _BINS, strict=True)], schema=_BINS)

    return work


_NEEDED = ["key", *[f"x{i}" for i in range(P)], "n_words", "n_lines", "n_letters"]


def _told(rows: DataFrame, found: DataFrame, columns: list[str]) -> tuple[DataFrame, object]:
    """``rows`` with estimates: sent to all tasks where there are few, else joined, with hot keys split."""
    if found.count() <= len(STARTS) * BROADCAST_GROUPS:
        of_key: dict[str, list[dict]] = {}
        for r in found.select("key", "start", "center", "cov").collect():
            of_key.setdefault(r["key"], []).append(r.asDict())
        return rows.select(*columns), rows.sparkSession.sparkContext.broadcast(of_key)
    one = found.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("start", "center", "cov"))).alias("estimates"))
    salted = rows.select(*columns).withColumn("_salt", F.pmod(F.xxhash64(*columns), F.lit(SALT)))
    spread = one.withColumn("_salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALT - 1).cast("long"))))
    return salted.withColumn("_salt", F.col("_salt").cast("long")).join(spread, ["key", "_salt"]).drop("_salt"), None


def _binned(members: DataFrame, found: DataFrame) -> DataFrame:
    rows, sent = _told(members, found, _NEEDED)
    ddl = "key string, start int, bin int, " + ", ".join(f"{c} long" for c in _SUMS)
    return rows.mapInArrow(_binner(sent), ddl).groupBy("key", "start", "bin").agg(*[F.sum(c).alias(c) for c in _SUMS])


def estimates(members: DataFrame) -> DataFrame:
    """The estimate of every key of ``members`` (key, x0 to x6, n_words, n_lines, n_letters), as ESTIMATE.

    From each of three starts, ``STEPS`` concentration steps; what has the smallest determinant stays.
    """
    cells = F.explode(F.array(*[F.struct(F.lit(k).alias("k"), F.col(f"x{k}").alias("value")) for k in range(P)])).alias("c")
    values = members.select("key", cells).groupBy("key", "c.k", "c.value").agg(F.count(F.lit(1)).alias("n"))
    # A key has at most P * (2 * LIMIT * GRID + 1) values, whatever its rows.
    found = durable(values.groupBy("key").applyInPandas(_starts, ESTIMATE))
    for _ in range(STEPS):
        found = durable(_binned(members, found).groupBy("key", "start").applyInPandas(_step, ESTIMATE))
    least = found.groupBy("key").agg(F.min(F.struct("det", "start")).alias("b")).select(F.col("key").alias("k"), F.col("b.start").alias("s"))
    best = durable(found.join(least, (F.col("key") == F.col("k")) & (F.col("start") == F.col("s"))).drop("k", "s"))
    scale = _binned(members, best).groupBy("key").applyInPandas(_scale, "key string, scale double").withColumnRenamed("key", "k")
    both = best.join(scale, F.col("key") == F.col("k")).drop("k")
    return durable(both.withColumn("cov", F.transform("cov", lambda c: c * F.col("scale"))).drop("scale"))


def _key(level: int, *parts: str) -> Column:
    """A text for a group; null and empty names differ."""
    named = [F.coalesce(F.concat(F.lit("="), F.col(p)), F.lit("-")) for p in parts]
    return F.concat_ws("\u0000", F.lit(str(level)), *named)


def keyed(good: DataFrame) -> DataFrame:
    """lang, source, key (the group whose estimate judges its rows) and members (the groups its rows count in).

    A language of a source with fewer than ``MIN_ROWS`` good rows is judged as its language, else as its source, else as
    all rows, so that every row has an estimate.
    """
    groups = good.groupBy("lang", "source").agg(F.count(F.lit(1)).alias("n"))
    # As many rows as languages in sources.
    of_lang = groups.groupBy(F.col("lang").alias("l")).agg(F.sum("n").alias("n_lang"))
    of_source = groups.groupBy(F.col("source").alias("s")).agg(F.sum("n").alias("n_source"))
    wide = groups.join(of_lang, groups["lang"].eqNullSafe(F.col("l"))).join(of_source, groups["source"].eqNullSafe(F.col("s")))
    keys = [_key(0, "lang", "source"), _key(1, "lang"), _key(2, "source"), F.lit("3")]
    enough = [F.col(c) >= MIN_ROWS for c in ("n", "n_lang", "n_source")]
    own = F.when(enough[0], keys[0]).when(enough[1], keys[1]).when(enough[2], keys[2]).otherwise(keys[3])
    placed = durable(wide.select("lang", "source", own.alias("key"), F.array(*keys).alias("all")))
    used = placed.select("key").distinct().withColumnRenamed("key", "member")
    each = placed.select("lang", "source", "key", F.explode("all").alias("member")).join(used, "member")
    return durable(each.groupBy("lang", "source", "key").agg(F.collect_list("member").alias("members")))


def _attach(rows: DataFrame, side: DataFrame) -> DataFrame:
    """``rows`` with the columns of ``side`` (one row for each lang and source); rows of a group without one get nulls."""
    named = side.withColumnRenamed("lang", "_lang").withColumnRenamed("source", "_source")
    if named.count() <= BROADCAST_GROUPS:
        same = rows["lang"].eqNullSafe(named["_lang"]) & rows["source"].eqNullSafe(named["_source"])
        return rows.join(F.broadcast(named), same, "left").drop("_lang", "_source")
    salted = rows.withColumn("_salt", F.pmod(F.xxhash64("doc_id", "mark"), F.lit(SALT)))
    spread = named.withColumn("_part", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))))
    same = salted["lang"].eqNullSafe(spread["_lang"]) & salted["source"].eqNullSafe(spread["_source"]) & (salted["_salt"] == spread["_part"])
    return salted.join(spread, same, "left").drop("_lang", "_source", "_salt", "_part")


_KEPT = ["doc_id", "lang", "source", "mark", *COUNTS, "base_failed"]
_JUDGED = pa.schema([
    ("doc_id", pa.int64()), ("lang", pa.string()), ("source", pa.string()), ("mark", pa.int64()), *((c, pa.int64()) for c in COUNTS),
    ("base_failed", pa.bool_()), ("distance", pa.float64()),
])


def _judge(sent):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x, chance = _arrays(batch)
            found = np.zeros(batch.num_rows)
            for _, rows, ((_, center, cov),) in _of_key(batch, batch.column("key").to_pylist(), sent):
                found[rows] = distances(x[rows], chance[rows], center, cov)
            columns = [batch.column(c) for c in _KEPT] + [pa.array(found)]
            yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(columns, _JUDGED, strict=True)], schema=_JUDGED)

    return work


def judge(docs: DataFrame) -> DataFrame:
    """Statistics of every row of ``docs`` (doc_id, text, lang, source), ``distance`` and ``kept``.

    Null and empty texts have no words and fail the base rules. Null languages and sources are groups like others. Every
    row that passes the base rules has a distance: groups of fewer than ``MIN_ROWS`` of them are judged by the estimate of
    their language, else of their source, else of all rows. Rows that fail have a null distance.
    """
    rows = durable(statistics(docs))
    good = rows.filter("not base_failed")
    placed = durable(_attach(good, keyed(good)))
    found = estimates(placed.select(F.explode("members").alias("key"), *_NEEDED[1:]))
    told, sent = _told(placed, found, ["key", *[f"x{i}" for i in range(P)], *_KEPT])
    ddl = "doc_id long, lang string, source string, mark long, " + ", ".join(f"{c} long" for c in COUNTS) + ", base_failed boolean, distance double"
    judged = told.mapInArrow(_judge(sent), ddl)
    failed = rows.filter("base_failed").select(*_KEPT, F.lit(None).cast("double").alias("distance"))
    kept = ~F.col("base_failed") & F.coalesce(F.col("distance") <= CUTOFF, F.lit(False))
    return judged.unionByName(failed).withColumn("kept", kept)


def quality_table(docs: DataFrame) -> DataFrame:
    """The counts and the verdict of every row, as `judge` gives them, without the hash of the row."""
    return judge(docs).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "distance")


def good_documents(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that `judge` keeps, with their columns."""
    bad = judge(docs).filter("not kept").select(F.col("doc_id").alias("bad_id"), F.col("mark").alias("bad_mark")).distinct()
    mark = F.xxhash64("text", F.col("lang").cast("string"), F.col("source").cast("string"))
    rows = docs.select(whole_row(docs), F.col("doc_id").cast("long").alias("id"), mark.alias("mark"))
    return rows.join(bad, F.col("id").eqNullSafe(F.col("bad_id")) & (F.col("mark") == F.col("bad_mark")), "left_anti").select("_row.*")
