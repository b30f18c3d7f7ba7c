"""Near-duplicates by SetSketch registers.

A document is the set of its distinct shingles. Its sketch has ``BANDS * ROWS`` registers: register i is the
minimum over the set of exponential variables, one for each shingle, put on an exponential scale with base ``BASE``
and truncated to 16 bits (a sketch of a union is the maximum of registers, so sketches merge). Registers of two
documents agree with a probability near their similarity.

1. Equal sets are one class; all that follows works on classes.
2. Classes that agree in all registers of a band share a bucket. A bucket of any size offers one pair for each
   member: with one of its members, the hub.
3. For each pair the similarity is estimated from all registers jointly, by maximum likelihood given the sizes;
   pairs far below the threshold go. The rest is verified on the full sets.
4. Components of the verified links. Buckets that still hold several components offer pairs with another hub, and
   so on for ``ROUNDS`` rounds; pairs within a component can't change the result and are never made.
5. What is then still open is compared in blocks of bounded size, between different components only: members that
   share a band are estimated from their registers, and those near the threshold are verified on the full sets in
   the same task. Only links become rows. Blocks are made of classes that buckets connect, not of buckets, so
   that a pair that shares several bands is compared once.

Every table here grows with the input, so joins are sorted and merged; only tables of few rows are sent whole.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from txnlake.llm.common import beside, give_back, merged, whole_row
from txnlake.llm.graph import components
from txnlake.plans.groups import durable

#: Two documents of similarity 0.8 share no bucket with probability (1 - 0.8 ** 6) ** 45, about one in a million.
BANDS, ROWS = 45, 6
REGISTERS = BANDS * ROWS
#: Parameters of the register scale.
BASE, RATE, TOP = 1.001, 20.0, 65_535
#: Estimates have a standard error of 0.024 at similarity 0.8; what is this far below the threshold, more than four
#: standard errors, goes unverified.
MARGIN = 0.1
#: Rounds of pairs with hubs, and classes in a block of what stays open.
ROUNDS, BLOCK = 2, 256
#: Pairs whose similarity is estimated at a time.
ESTIMATED = 1_000
#: Words whose hashes a task remembers at most.
REMEMBERED = 200_000

_RNG = np.random.default_rng(20_240_101)
_FACTORS = (_RNG.integers(1, 1 << 32, REGISTERS, dtype=np.uint64) | np.uint64(1)).astype(np.uint32)
_SHIFTS = _RNG.integers(0, 1 << 32, REGISTERS, dtype=np.uint64).astype(np.uint32)


class _Words(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= REMEMBERED:
            self.clear()
        self[word] = value = xxhash.xxh3_64_intdigest(word)
        return value


_WORDS = _Words()


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def shingles(text: str | None, k: int = 2) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the shingles of ``k`` words; with fewer words the whole sequence is one."""
    words = (text or "").encode().lower().split()  # of bytes: ASCII white space and A-Z alone
    if not words:
        return np.zeros(0, dtype=np.uint64)
    ids = np.array([_WORDS[w] for w in words], dtype=np.uint64)
    size = min(k, len(words))
    n = len(words) - size + 1
    out = np.full(n, size, dtype=np.uint64)
    for i in range(size):
        out = _mix(out * np.uint64(0x9E3779B97F4A7C15) + ids[i:i + n])
    return np.unique(out)


def registers(hashes: np.ndarray) -> np.ndarray:
    """The sketch of a set that isn't empty."""
    x = (hashes >> np.uint64(32)).astype(np.uint32)
    least = np.full(REGISTERS, 0xFFFFFFFF, dtype=np.uint32)
    for i in range(0, len(x), 2048):
        values = x[i:i + 2048][None, :] * _FACTORS[:, None]
        values += _SHIFTS[:, None]
        # One more round of mixing, so that the order of the values differs between registers.
        values ^= values >> np.uint32(15)
        values *= np.uint32(0x2C1B3C6D)
        np.minimum(least, values.min(axis=1), out=least)
    exponential = -np.log1p(-(least.astype(np.float64) + 0.5) / 2.0**32) / RATE
    return np.clip(np.floor(1 - np.log(exponential) / math.log(BASE)), 0, TOP).astype("<u2")


def estimate(left: np.ndarray, right: np.ndarray, n_left: np.ndarray, n_right: np.ndarray) -> np.ndarray:
    """Maximum-likelihood similarity of pairs of sketches (rows) of sets of known sizes.

    Given the sizes, counts of registers that are larger, smaller and equal are multinomial with probabilities
    that depend on the similarity alone; the likelihood is evaluated on a grid of step 0.01.
    """
    larger, smaller = (left > right).sum(axis=1)[:, None], (left < right).sum(axis=1)[:, None]
    equal = left.shape[1] - larger - smaller
    u = (n_left / (n_left + n_right))[:, None]
    v = 1 - u
    grid = np.arange(0, 1.0001, 0.01)[None, :]
    possible = grid <= np.minimum(u / v, v / u) + 0.005
    chance = lambda x: np.clip(-np.log1p(-np.clip(x, 0, 1) * (BASE - 1) / BASE) / math.log(BASE), 1e-12, 1)
    p, r = chance(u - v * grid), chance(v - u * grid)
    score = larger * np.log(p) + smaller * np.log(r) + equal * np.log(np.clip(1 - p - r, 1e-12, 1))
    return grid[0][np.argmax(np.where(possible, score, -np.inf), axis=1)]


def _sketcher(k: int, with_sketch: bool):
    schema = pa.schema([
        ("doc_id", pa.int64()), ("mark", pa.int64()), ("n_shingles", pa.int64()), ("sig", pa.binary()),
        ("sketch", pa.binary()) if with_sketch else ("members", pa.list_(pa.int64())),
    ])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        give_back()
        for batch in batches:
            rows = []
            for doc_id, mark, text in zip(batch.column("doc_id").to_pylist(), batch.column("mark").to_pylist(), batch.column("text"), strict=True):
                found = shingles(text.as_py(), k)
                data = found.astype("<u8").tobytes()
                extra = (registers(found).tobytes() if with_sketch else found.view(np.int64)) if len(found) else None
                rows.append((doc_id, mark, len(found), xxhash.xxh3_128_digest(data), extra))
                if len(rows) >= 500:
                    yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)
                    rows = []
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    return work


def _near(floor: float):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        give_back()
        for whole in batches:
            for at in range(0, whole.num_rows, ESTIMATED):
                batch = whole.slice(at, ESTIMATED)
                sketch = lambda c: np.frombuffer(b"".join(batch.column(c).to_pylist()), dtype="<u2").reshape(-1, REGISTERS)  # noqa: E731, B023
                size = lambda c: batch.column(c).to_numpy(zero_copy_only=False).astype(np.float64)  # noqa: E731, B023
                keep = pa.array(estimate(sketch("sketch_a"), sketch("sketch_b"), size("n_a"), size("n_b")) >= floor)
                yield batch.select(["a", "b"]).filter(keep)

    return work


def _both(pairs: DataFrame, side: DataFrame, *columns: str) -> DataFrame:
    """``pairs`` (a, b) with ``columns`` of ``side`` (by cid) for both, named with _a and _b."""
    for end in ("a", "b"):
        named = side.select(F.col("cid").alias(end), *[F.col(c).alias(f"{c}_{end}") for c in columns])
        pairs = pairs.join(merged(named), end)
    return pairs


def _estimated(pairs: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose estimate isn't far below the threshold."""
    sketched = _both(pairs, classes.select("cid", "n", "sketch"), "n", "sketch").select("a", "b", "n_a", "n_b", "sketch_a", "sketch_b")
    return durable(sketched.mapInArrow(_near(percent / 100 - MARGIN), "a long, b long"))


def _sets(wanted: DataFrame, classes: DataFrame, docs: DataFrame, k: int) -> DataFrame:
    """cid, rep and members (the full set) of the classes ``wanted`` (cid), made anew from their texts."""
    ends = durable(classes.select("cid", "sig", "rep").join(merged(wanted), "cid", "left_semi"))
    reps = beside(ends.select(F.col("rep").alias("doc_id")).distinct(), ends.count())  # if few, no text is shuffled
    members = docs.join(reps, "doc_id", "left_semi").mapInArrow(
        _sketcher(k, False), "doc_id long, mark long, n_shingles long, sig binary, members array<long>").filter("members is not null")
    # Repeated rows of an id may hold other sets; one row of each wanted set is enough.
    return durable(members.select("sig", "members").join(merged(ends), "sig").dropDuplicates(["cid"]).select("cid", "rep", "members"))


def _verified(near: DataFrame, classes: DataFrame, docs: DataFrame, k: int, percent: int) -> DataFrame:
    """The pairs (a, b) of classes that are links, as (a, b) of the classes' smallest ids."""
    wanted = near.select(F.col("a").alias("cid")).union(near.select("b")).distinct()
    full = _both(near, _sets(wanted, classes, docs, k), "rep", "members")
    common = F.size(F.array_intersect("members_a", "members_b")).cast("long")
    union = F.size("members_a") + F.size("members_b") - common
    return durable(full.filter(100 * common >= percent * union).select(F.col("rep_a").alias("a"), F.col("rep_b").alias("b")))


def _ordered(one: str, two: str) -> list[Column]:
    return [F.least(one, two).alias("a"), F.greatest(one, two).alias("b")]


def _with_hubs(members: DataFrame, turn: int) -> DataFrame:
    """Pairs (a, b) of every member (key, cid, label) with the hub of its bucket, if their labels differ."""
    hubs = members.groupBy(F.col("key").alias("of")).agg(
        F.min(F.struct(F.xxhash64("cid", F.lit(turn)).alias("draw"), "cid", "label")).alias("hub"))
    hubs = hubs.select("of", F.col("hub.cid").alias("hub"), F.col("hub.label").alias("hub_label"))
    paired = members.join(merged(hubs), F.col("key") == F.col("of")).filter("label <> hub_label")
    return paired.select(*_ordered("cid", "hub")).distinct()


def _open(shared: DataFrame, labels: DataFrame) -> DataFrame:
    """Rows (key, cid, label) of ``shared`` (key, cid) in buckets with several labels; ``labels``: cid, label."""
    placed = durable(shared.join(merged(labels), "cid"))
    mixed = placed.groupBy("key").agg(F.min("label").alias("low"), F.max("label").alias("high")).filter("low < high").select("key")
    return durable(placed.join(merged(mixed), "key", "left_semi"))


def _block_links(percent: int):
    floor = percent / 100 - MARGIN

    def work(rows: pd.DataFrame) -> pd.DataFrame:
        sketch = np.frombuffer(b"".join(rows.sketch), dtype="<u2").reshape(-1, REGISTERS)
        rep, label, n = rows.rep.to_numpy(), rows.label.to_numpy(), rows.members.map(len).to_numpy(np.float64)
        block, crossing = rows.block.to_numpy(), rows.i.iloc[0] != rows.j.iloc[0]
        # The sets as numbers of hashes, one after the other.
        place = np.unique(np.concatenate(rows.members.to_numpy()), return_inverse=True)[1]
        starts = np.concatenate([[0], np.cumsum(n)[:-1]]).astype(np.int64)
        values, counts = np.unique(label, return_counts=True)
        main = values[np.argmax(counts)]
        at, left, right = np.arange(len(rows)), [], []
        # Every pair of different labels has a member outside the most frequent one.
        for x in np.flatnonzero(label != main):
            others = (label != label[x]) & ((label == main) | (at > x))
            if crossing:
                others &= block != block[x]
            others = np.flatnonzero(others)
            equal = sketch[others] == sketch[x]
            # Registers agree about as often as the sets are similar; what is clearly below needs no estimate.
            often = np.count_nonzero(equal, axis=1) >= (floor - 0.05) * REGISTERS
            others, equal = others[often], equal[often]
            if not len(others):
                continue
            others = others[equal.reshape(len(others), BANDS, ROWS).all(axis=2).any(axis=1)]
            if not len(others):
                continue
            near = estimate(np.repeat(sketch[x][None], len(others), axis=0), sketch[others], np.full(len(others), n[x]), n[others])
            others = others[near >= floor]
            mine = np.zeros(place.max() + 1, dtype=bool)
            mine[place[starts[x]:starts[x] + int(n[x])]] = True
            for y in others:
                common = int(mine[place[starts[y]:starts[y] + int(n[y])]].sum())
                if 100 * common >= percent * (int(n[x]) + int(n[y]) - common):
                    left.append(rep[x]), right.append(rep[y])
        return pd.DataFrame({"a": np.array(left, dtype=np.int64), "b": np.array(right, dtype=np.int64)})

    return work


def _links_within(members: DataFrame, classes: DataFrame, docs: DataFrame, k: int, percent: int) -> DataFrame:
    """All links (a, b) between different labels in the buckets of ``members`` (key, cid, label), as ids of classes."""
    firsts = members.groupBy(F.col("key").alias("of")).agg(F.min("cid").alias("a"))
    ties = members.join(merged(firsts), F.col("key") == F.col("of")).select("a", F.col("cid").alias("b"))
    families = components(ties.filter("a <> b").distinct()).select(F.col("node").alias("cid"), F.col("label").alias("family"))
    placed = durable(members.select("cid", "label").distinct().join(merged(families), "cid"))
    sizes = placed.groupBy(F.col("family").alias("of")).agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("blocks"))
    # Small families share blocks: members of different ones have no band in common, so this adds no pair.
    shared = max(1, math.ceil(placed.count() / BLOCK))
    bin_ = F.when(F.col("blocks") > 1, F.col("family")).otherwise(-1 - F.pmod(F.xxhash64("family"), F.lit(shared)))
    spread = placed.join(merged(sizes), F.col("family") == F.col("of")).select(
        "cid", "label", bin_.alias("bin"), F.pmod(F.xxhash64("cid"), F.col("blocks")).cast("int").alias("block"),
        F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("with"))
    spread = spread.select("cid", "label", "bin", "block", F.least("block", "with").alias("i"), F.greatest("block", "with").alias("j"))
    sets = _sets(placed.select("cid"), classes, docs, k)
    fed = spread.join(merged(classes.select("cid", "sketch")), "cid").join(merged(sets), "cid")
    return durable(fed.groupBy("bin", "i", "j").applyInPandas(_block_links(percent), "a long, b long"))


def near_duplicates(docs: DataFrame, k: int = 2, percent: int = 80) -> DataFrame:
    """doc_id, mark (a hash of the text), n_shingles, component_id and kept of every row of ``docs`` (doc_id, text; other columns are left out).

    Words are runs without ASCII white space, with A-Z in lower case; a set holds the distinct shingles of ``k``
    words. Documents are linked if 100 * common >= percent * union; a text without words is linked with nothing.
    ``component_id`` is the smallest doc_id that links reach. Rows of an equal id are documents of their own that
    share their id. A row with a null id takes no part: its component is null, and it is kept.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("mark"), "text")
    rows = durable(docs.mapInArrow(_sketcher(k, True), "doc_id long, mark long, n_shingles long, sig binary, sketch binary"))
    filled = rows.filter("doc_id is not null and n_shingles > 0")
    # Numbers of classes are settled by writing them; which number a class gets doesn't matter.
    classes = durable(filled.groupBy("sig").agg(
        F.min("doc_id").alias("rep"), F.max("n_shingles").alias("n"), F.first("sketch").alias("sketch")
    ).withColumn("cid", F.monotonically_increasing_id()))

    def key(band: int) -> Column:
        return F.xxhash64(F.lit(band), F.substring("sketch", 2 * ROWS * band + 1, 2 * ROWS))

    banded = classes.select("cid", F.explode(F.array(*[key(b) for b in range(BANDS)])).alias("key"))
    several = banded.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("key")
    shared = durable(banded.join(merged(several), "key", "left_semi"))
    open_rows = shared.join(merged(classes.select("cid", F.col("rep").alias("label"))), "cid")
    tried = links = labels = None
    for turn in range(ROUNDS + 1):
        if turn < ROUNDS:
            pairs = _with_hubs(open_rows, turn)
            pairs = durable(pairs if tried is None else pairs.join(merged(tried), ["a", "b"], "left_anti"))
            tried = pairs if tried is None else tried.union(pairs)
            fresh = _verified(_estimated(pairs, classes, percent), classes, docs, k, percent)
        else:
            fresh = _links_within(open_rows, classes, docs, k, percent)
        links = fresh if links is None else links.union(fresh)
        if labels is None or not fresh.isEmpty():
            labels = components(links)
            if turn < ROUNDS:
                known = classes.select("cid", "rep").join(merged(labels.withColumnRenamed("node", "rep")), "rep", "left")
                open_rows = _open(shared, known.select("cid", F.coalesce("label", "rep").alias("label")))
        if open_rows.isEmpty():
            break

    found = classes.select("sig", "rep").join(merged(labels.withColumnRenamed("node", "rep")), "rep", "left").select("sig", F.coalesce("label", "rep").alias("label"))
    out = rows.select("doc_id", "mark", "n_shingles", "sig").join(merged(found), "sig", "left")
    part = F.col("doc_id").isNotNull()
    component = F.when(part, F.when(F.col("n_shingles") > 0, F.col("label")).otherwise(F.col("doc_id")))
    return out.select("doc_id", "mark", "n_shingles", component.alias("component_id")).withColumn(
        "kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def one_of_each(docs: DataFrame, k: int = 2, percent: int = 80) -> DataFrame:
    """``docs`` with its columns, one document of each group of near-duplicates; one row where an id is repeated.

    Rows with a null id stay. Of kept rows with an equal id, the one with the smallest hash of its text stays.
    """
    rows = docs.select(whole_row(docs), F.col("doc_id").cast("long").alias("id"), F.xxhash64("text").alias("mark"))
    kept = near_duplicates(docs, k, percent).filter("kept and doc_id is not null")
    kept = kept.groupBy("doc_id").agg(F.min(F.struct("mark")).alias("first"), F.count(F.lit(1)).alias("n"))
    kept = durable(kept.select(F.col("doc_id").alias("kept_id"), F.col("first.mark").alias("kept_mark"), "n"))
    found = rows.join(merged(kept), (F.col("id") == F.col("kept_id")) & (F.col("mark") == F.col("kept_mark")))
    once = found.filter("n = 1").select("_row.*")
    one = found.filter("n > 1").groupBy("id").agg(F.min_by("_row", F.xxhash64("_row")).alias("_row"))
    return once.unionByName(one.select("_row.*")).unionByName(rows.filter("id is null").select("_row.*"))
