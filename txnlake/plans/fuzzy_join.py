"""Names joined with similar names of another table, without comparing all with all.

Similarity is the ratio 200 * c / (a + b) of the longest common subsequence c of two names of a and b letters. Names
that reach a threshold have an indel distance of at most d = a + b - 2 * t, t being the least c that reaches it. From
that follow exact filters, which are equality joins on short strings (keys):

- d edits destroy at most 2 * d pairs of neighbouring letters. Of the 2 * d + 1 rarest pairs of one name, one is thus among
  the 2 * d + 1 rarest pairs of the other, at most d places away. Rare first is one order of all pairs, by how often they occur.
- Short names, that may lose all of their pairs, share t letters, so one of the a - t + 1 rarest letters of one is among
  the b - t + 1 rarest of the other (the second "a" of a name is another letter than the first).
- A name that is similar to a stretch of a longer name, cut into more pieces than the distance allows edits, has one piece
  in the longer name as it is.

What shares a key is a candidate, and only candidates are scored, in Arrow batches. Keys that too many names of the
right side have are dealt out to several tasks.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Names of the right side that one task may get for one key.
NAMES_PER_KEY = 10_000
#: Pairs that are scored at a time.
CHUNK = 4096
#: Letters of a piece that are compared.
PIECE = 4


def _codes(texts: Sequence[str], pad: int) -> np.ndarray:
    width = max(map(len, texts), default=0)
    out = np.full((len(texts), width), pad, dtype=np.int64)
    for i, t in enumerate(texts):
        out[i, :len(t)] = np.frombuffer(t.encode("utf-32-le"), dtype=np.uint32)
    return out


def common_lengths(left: Sequence[str], right: Sequence[str]) -> np.ndarray:
    """Lengths of the longest common subsequences of pairs of names, all pairs advancing together."""
    out = np.zeros(len(left), dtype=np.int64)
    order = np.argsort([len(a) + len(b) for a, b in zip(left, right, strict=True)], kind="stable")
    for at in range(0, len(order), CHUNK):
        mine = order[at:at + CHUNK].tolist()
        a, b = _codes([left[i] for i in mine], -1), _codes([right[i] for i in mine], -2)
        row = np.zeros((len(mine), a.shape[1] + 1), dtype=np.int32)
        for j in range(b.shape[1]):
            step = np.maximum(row[:, 1:], row[:, :-1] + (a == b[:, j:j + 1]))
            np.maximum.accumulate(step, axis=1, out=row[:, 1:])
        out[mine] = row[:, -1]
    return out


def _joined(left: DataFrame, right: DataFrame, on: Sequence[str], keep: Column, most: int) -> DataFrame:
    """Distinct (left, right) of the rows that share a key and meet ``keep``; ``right`` keys of many names are dealt out.

    ``left`` has column left, ``right`` column right, both the columns ``on``.
    """
    many = right.groupBy(*on).agg(F.ceil(F.count("*") / most).cast("int").alias("_shares")).filter("_shares > 1")
    shares = F.coalesce("_shares", F.lit(1))
    dealt = right.join(many, list(on), "left").withColumn("_share", F.pmod(F.xxhash64("right"), shares)).drop("_shares")
    copied = left.join(many, list(on), "left").withColumn("_share", F.explode(F.sequence(F.lit(0).cast("long"), (shares - 1).cast("long")))).drop("_shares")
    return copied.join(dealt, [*on, "_share"]).filter(keep).select("left", "right").distinct()


def _bound(threshold: float, a: str, b: str) -> tuple[Column, Column]:
    """The least common subsequence that reaches the threshold, and the distance that leaves."""
    total = F.col(a) + F.col(b)
    least = F.ceil(total * threshold / 200.0 - 1e-9)
    return least, total - 2 * least


def _keys(names: DataFrame, side: str, threshold: float) -> DataFrame:
    """Letter pairs and letters of each name: <side>, n_<side>, at_<side>, key."""
    n = F.char_length(side)
    least, most = F.ceil(n * threshold / (200.0 - threshold) - 1e-9), F.floor(n * (200.0 - threshold) / threshold + 1e-9)
    loss = 1 - threshold / 100.0
    # Whether some length of the other name lets all letter pairs be lost.
    short = (least - 1 < 2 * loss * (n + least) + 1 + 1e-6) | (n - 1 < 2 * loss * (n + most) + 1 + 1e-6) | F.lit(threshold <= 50)
    spots = F.sequence(F.lit(1), n)
    pairs = F.transform(F.filter(spots, lambda i: i < n), lambda i: F.struct(i.alias("at"), F.substring(side, i, F.lit(2)).alias("key")))
    # A letter's number among its likes makes a name's letters distinct; three characters tell them from pairs.
    letters = F.transform(spots, lambda i: F.struct(i.alias("at"), F.concat(
        F.substring(side, i, F.lit(1)), F.lit("\u0000#"),
        (F.char_length(F.substring(side, F.lit(1), i)) - F.char_length(F.replace(F.substring(side, F.lit(1), i), F.substring(side, i, F.lit(1))))).cast("string"),
    ).alias("key")))
    cells = F.explode(F.concat(pairs, F.when(short, letters).otherwise(F.array().cast("array<struct<at:int,key:string>>"))))
    return names.select(side, n.alias(f"n_{side}"), cells.alias("c")).select(side, f"n_{side}", F.col("c.at").alias(f"at_{side}"), F.col("c.key").alias("key"))


def similar_candidates(left: DataFrame, right: DataFrame, threshold: float, most: int = NAMES_PER_KEY) -> DataFrame:
    """Pairs (left, right) that hold all pairs of names whose ratio reaches the threshold; columns ``left`` and ``right`` hold distinct names."""
    mine, theirs = _keys(left, "left", threshold), _keys(right, "right", threshold)
    often = mine.select("key").unionAll(theirs.select("key")).groupBy("key").agg(F.count("*").alias("often"))

    def ranked(keys: DataFrame, side: str) -> DataFrame:
        pair = F.char_length("key") == 2
        by = Window.partitionBy(side, pair).orderBy("often", "key")
        out = keys.join(often, "key").withColumn(f"rank_{side}", F.rank().over(by)).drop("often")
        # More than any partner's length allows is never asked for.
        n = F.col(f"n_{side}")
        room = 2 * F.floor((1 - threshold / 100.0) * (n + F.floor(n * (200.0 - threshold) / threshold + 1e-9)) + 1e-9) + 1
        return out.filter(F.col(f"rank_{side}") <= F.when(pair, room).otherwise(n))

    least, distance = _bound(threshold, "n_left", "n_right")
    shorter = F.least("n_left", "n_right")
    whole = shorter - 1 >= 2 * distance + 1
    pair = F.char_length("key") == 2
    by_pair = whole & (F.greatest("rank_left", "rank_right") <= 2 * distance + 1) & (F.abs(F.col("at_left") - F.col("at_right")) <= distance)
    by_letter = ~whole & (F.col("rank_left") <= F.col("n_left") - least + 1) & (F.col("rank_right") <= F.col("n_right") - least + 1)
    keep = (least <= shorter) & F.when(pair, by_pair).otherwise(by_letter)
    return _joined(ranked(mine, "left"), ranked(theirs, "right"), ["key"], keep, most)


def _pieces(names: DataFrame, side: str, threshold: float) -> DataFrame:
    """Of each name, one piece more than edits; or all its letters, where there are more edits than letters."""
    n = F.char_length(side)
    parts = F.floor(2 * n * (1 - threshold / 100.0) + 1e-9).cast("int") + 1
    cuts = F.sequence(F.lit(0), F.least(parts, n) - 1)
    size = F.least(parts, n)
    pieces = F.transform(cuts, lambda i: F.substring(side, (F.floor(i * n / size) + 1).cast("int"), F.least(
        F.lit(PIECE), (F.floor((i + 1) * n / size) - F.floor(i * n / size)).cast("int"))))
    return names.select(side, n.alias(f"n_{side}"), F.explode(F.array_distinct(pieces)).alias("key"))


def _stretches(names: DataFrame, side: str) -> DataFrame:
    """All stretches of up to four letters of each name."""
    n = F.char_length(side)
    spots = F.sequence(F.lit(1), n)
    all_ = F.flatten(F.transform(F.sequence(F.lit(1), F.least(F.lit(PIECE), n)), lambda k: F.transform(
        F.filter(spots, lambda i: i <= n - k + 1), lambda i: F.substring(side, i, k))))
    return names.select(side, n.alias(f"n_{side}"), F.explode(F.array_distinct(all_)).alias("key"))


def partial_candidates(left: DataFrame, right: DataFrame, threshold: float, most: int = NAMES_PER_KEY) -> DataFrame:
    """Pairs that hold all in which the shorter name reaches the threshold against a stretch of the longer one."""
    inside = _joined(_pieces(left, "left", threshold), _stretches(right, "right"), ["key"], F.col("n_left") <= F.col("n_right"), most)
    around = _joined(_stretches(left, "left"), _pieces(right, "right", threshold), ["key"], F.col("n_left") >= F.col("n_right"), most)
    return inside.union(around).distinct()


def _words(name: str) -> Column:
    return F.filter(F.split(name, r"(?U)\s+"), lambda w: w != "")


def token_candidates(left: DataFrame, right: DataFrame, threshold: float, most: int = NAMES_PER_KEY) -> DataFrame:
    """Pairs that hold all that share a word, or whose words in order reach the threshold, each word as often as it stands or once."""
    mine = left.select("left", F.explode(F.array_distinct(_words("left"))).alias("key"))
    theirs = right.select("right", F.explode(F.array_distinct(_words("right"))).alias("key"))
    found = _joined(mine, theirs, ["key"], F.lit(True), most)
    for once in (False, True):
        def sides(names: DataFrame, side: str, once: bool = once) -> DataFrame:
            words = F.array_distinct(_words(side)) if once else _words(side)
            return names.select(F.col(side).alias(f"of_{side}"), F.concat_ws(" ", F.array_sort(words)).alias(side)).filter(F.col(side) != "")

        a, b = sides(left, "left"), sides(right, "right")
        near = similar_candidates(a.select("left").distinct(), b.select("right").distinct(), threshold, most)
        pairs = near.join(a, "left").join(b, "right").select(F.col("of_left").alias("left"), F.col("of_right").alias("right"))
        found = found.union(pairs)
    return found.distinct()


def scored(pairs: DataFrame, score: Callable[[list[str], list[str]], Sequence[float]], threshold: float) -> DataFrame:
    """The pairs whose score reaches the threshold, with the score."""
    schema = pa.schema([("left", pa.string()), ("right", pa.string()), ("score", pa.float64())])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = batch.column("left").to_pylist(), batch.column("right").to_pylist()
            found = np.asarray(score(a, b), dtype=float)
            rows = pa.RecordBatch.from_arrays([batch.column("left"), batch.column("right"), pa.array(found)], schema=schema)
            yield rows.filter(pa.array(found >= threshold))

    return pairs.select("left", "right").mapInArrow(work, "left string, right string, score double")


def ratios(left: list[str], right: list[str]) -> np.ndarray:
    total = np.array([len(a) + len(b) for a, b in zip(left, right, strict=True)], dtype=float)
    return np.where(total > 0, 200.0 * common_lengths(left, right) / np.maximum(total, 1), 100.0)


def similar_names(left: DataFrame, right: DataFrame, threshold: float, most: int = NAMES_PER_KEY) -> DataFrame:
    """All (left, right, score) whose ratio reaches the threshold (above 0); inputs are distinct names, none of them empty."""
    return scored(similar_candidates(left, right, threshold, most), ratios, threshold)
