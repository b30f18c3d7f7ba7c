"""Periodic runs of words: stretches that repeat with a smallest period q for at least four periods.

At a dyadic scale L = 2 ** s a document is cut into blocks of L words. A run of a period p
from (2L - 1) / 3 to (4L - 2) / 3 has at least 3p >= 2L - 1 words that come again p words later, so it holds a whole block
and its copy. The squared differences of a block and the words after it are summed for all these distances at once, by
convolution: sum (x - y) ** 2 = sum x ** 2 + sum y ** 2 - 2 sum xy. The sums are exact integers modulo a prime
(number-theoretic transform), so a distance with zero mismatches never has a sum other than zero. What has zero is a
seed; a seed is verified word by word while it is extended to the run around it.

A block in which some word doesn't come again within reach has no copy there, so it isn't transformed. The blocks of all
texts of a batch are transformed together. Every text is worked on in one task, without a shuffle.
"""

from __future__ import annotations

import hashlib
import zlib
from bisect import bisect_right
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

#: 3 * 2 ** 30 + 1, a prime below 2 ** 32 with roots of unity of order 2 ** 30; 5 generates its residues.
PRIME, GENERATOR = 3221225473, 5
LEAST_WORDS, LEAST_POWER = 6, 4
#: Words that are worked on at a time (a longer text on its own), and numbers that one call transforms.
BATCH_WORDS, CALL_NUMBERS = 1 << 20, 1 << 21
_ROOTS: dict[tuple[int, bool], np.ndarray] = {}


def roots(n: int, inverse: bool) -> np.ndarray:
    """The first n / 2 powers of an n-th root of unity."""
    if (n, inverse) not in _ROOTS:
        root = pow(GENERATOR, (PRIME - 1) // n, PRIME)
        root = pow(root, PRIME - 2, PRIME) if inverse else root
        powers = np.ones(max(1, n // 2), dtype=np.uint64)
        have = 1
        while have < len(powers):
            step = min(have, len(powers) - have)
            powers[have:have + step] = powers[:step] * np.uint64(pow(root, have, PRIME)) % PRIME
            have += step
        if n > 1 << 18:
            return powers
        _ROOTS[n, inverse] = powers
    return _ROOTS[n, inverse]


def transform(rows: np.ndarray, inverse: bool = False) -> np.ndarray:
    """The number-theoretic transform of every row (a power of two long), in bit-reversed order; or back from it.

    Neither way permutes: products of two transforms are element by element, so the order doesn't matter in between.
    """
    x, prime = rows.astype(np.uint64), np.uint64(PRIME)
    count, n = x.shape
    sizes = [n >> i for i in range(n.bit_length() - 1)]
    for size in (reversed(sizes) if inverse else sizes):
        pairs = x.reshape(count, n // size, 2, size // 2)
        low, high = pairs[:, :, 0], pairs[:, :, 1]
        w = roots(size, inverse)
        if inverse:
            turned = high * w % prime
            low, high = low + turned, low + (prime - turned)
        else:
            low, high = low + high, (low + (prime - high)) % prime * w
        out = np.empty_like(pairs)
        np.remainder(low, prime, out=out[:, :, 0])
        np.remainder(high, prime, out=out[:, :, 1])
        x = out.reshape(count, n)
    return x * np.uint64(pow(n, PRIME - 2, PRIME)) % prime if inverse else x


def mismatches(blocks: np.ndarray, windows: np.ndarray) -> np.ndarray:
    """Sums of squared differences (modulo the prime) of each block with its window from each start that holds it.

    ``blocks`` is (n, L) and ``windows`` (n, 2L), non-negative numbers below 2 ** 31; the result is (n, L + 1).
    """
    prime = np.uint64(PRIME)
    count, size = blocks.shape
    blocks, windows = blocks.astype(np.uint64), windows.astype(np.uint64)
    # The block backwards turns the convolution into sums of products; starts up to L don't wrap around.
    back = np.zeros((count, 2 * size), dtype=np.uint64)
    back[:, :size] = blocks[:, ::-1]
    both = transform(transform(back) * transform(windows) % prime, inverse=True)
    # A start s lies at s + L - 1 of the cyclic convolution; the last one wraps to 2L - 1.
    products = both[:, size - 1:]
    squares = np.zeros((count, 2 * size + 1), dtype=np.uint64)
    # Below 2 ** 32 each, so that sums of fewer than 2 ** 32 of them are exact.
    np.cumsum(windows * windows % prime, axis=1, out=squares[:, 1:])
    window = (squares[:, size:] - squares[:, :size + 1]) % prime
    block = (blocks * blocks % prime).sum(axis=1, dtype=np.uint64) % prime
    return (block[:, None] + window + 2 * (prime - products)) % prime


def reach(size: int) -> tuple[int, int]:
    """Least and greatest period that blocks of ``size`` words are for."""
    return -(-(2 * size - 1) // 3), -(-(4 * size - 1) // 3) - 1


def _next_same(ids: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Distance to the next equal word of the same text; a large number where there is none."""
    far = np.iinfo(np.int64).max
    out = np.full(len(ids), far)
    order = np.lexsort((ids, doc))
    same = (ids[order[1:]] == ids[order[:-1]]) & (doc[order[1:]] == doc[order[:-1]])
    out[order[:-1][same]] = (order[1:] - order[:-1])[same]
    return out


def _seeds(ids: np.ndarray, starts: np.ndarray, lengths: np.ndarray, gap: np.ndarray, size: int) -> np.ndarray:
    """Blocks with a copy in reach: rows of (text, word number of the block in ``ids``, distance)."""
    low, high = reach(size)
    blocks = np.where(lengths >= LEAST_POWER * low, lengths // size, 0)
    doc = np.repeat(np.arange(len(starts)), blocks)
    at = starts[doc] + size * (np.arange(len(doc)) - np.repeat(np.cumsum(blocks) - blocks, blocks))
    if not len(at):
        return np.zeros((0, 3), dtype=np.int64)
    # Every word of the block must come again within reach.
    most = np.maximum.reduceat(gap, np.column_stack([at, np.minimum(at + size, len(gap) - 1)]).reshape(-1))[::2]
    # A block at the very end of the words has no stop to reduce up to.
    last = at + size >= len(gap)
    most[last] = [gap[a:].max() for a in at[last].tolist()]
    keep = most <= high
    doc, at = doc[keep], at[keep]
    found = []
    step = max(1, CALL_NUMBERS // (2 * size))
    for k in range(0, len(at), step):
        d, a = doc[k:k + step], at[k:k + step]
        spots = (a + low)[:, None] + np.arange(2 * size)
        stop = (starts + lengths)[d][:, None]
        # Words after the end of the text are equal to none.
        windows = np.where(spots < stop, ids[np.minimum(spots, len(ids) - 1)] + 1, 0)
        blocks = ids[a[:, None] + np.arange(size)] + 1
        row, shift = np.nonzero(mismatches(blocks, windows)[:, :high - low + 1] == 0)
        found.append(np.column_stack([d[row], a[row], shift + low]))
    return np.concatenate(found) if found else np.zeros((0, 3), dtype=np.int64)


def _same_from(ids: np.ndarray, at: int, period: int, stop: int) -> int:
    """The first word number from ``at`` on that differs from the one ``period`` words later; ``stop - period`` if none."""
    step, last = 64, stop - period
    while at < last:
        end = min(at + step, last)
        same = ids[at:end] == ids[at + period:end + period]
        if not same.all():
            return at + int(np.argmin(same))
        at, step = end, 2 * step
    return last


def _same_before(ids: np.ndarray, at: int, period: int, start: int) -> int:
    """The least word number from which all up to ``at`` equal the ones ``period`` words later."""
    step = 64
    while at > start:
        low = max(at - step, start)
        same = ids[low:at] == ids[low + period:at + period]
        if not same.all():
            return at - int(np.argmin(same[::-1]))
        at, step = low, 2 * step
    return at


class Runs:
    """The runs of one text that are known so far: starts and ends of each period, ascending."""

    def __init__(self):
        self.of: dict[int, tuple[list[int], list[int]]] = {}

    def add(self, start: int, end: int, period: int) -> None:
        starts, ends = self.of.setdefault(period, ([], []))
        starts.append(start)
        ends.append(end)

    def around(self, low: int, high: int, period: int) -> int | None:
        """The end of a run that holds [low, high) and has a period that divides ``period``."""
        for q, (starts, ends) in self.of.items():
            if period % q == 0:
                k = bisect_right(starts, low) - 1
                if k >= 0 and ends[k] >= high:
                    return ends[k]
        return None


def _settle(ids: np.ndarray, start: int, stop: int, seeds: np.ndarray, size: int, runs: Runs) -> None:
    """Add the runs around the seeds (word number, distance) of one text at one scale.

    A seed whose block and copy lie in a run of a period that divides their distance leads to that run again, and one in
    a stretch that was followed leads there again, so every stretch is followed once.
    """
    seeds = seeds[np.lexsort((seeds[:, 0], seeds[:, 1]))]
    periods, first = np.unique(seeds[:, 1], return_index=True)
    for p, x, y in zip(periods.tolist(), first.tolist(), [*first.tolist()[1:], len(seeds)]):
        spots, k = seeds[x:y, 0], 0
        while k < len(spots):
            at = int(spots[k])
            end = runs.around(at, at + size + p, p)
            if end is None:
                low, end = _same_before(ids, at, p, start), _same_from(ids, at, p, stop) + p
                if end - at < size + p:
                    # Zero only modulo the prime.
                    k += 1
                    continue
                if end - low >= max(LEAST_WORDS, LEAST_POWER * p):
                    runs.add(low, end, p)
            k = int(np.searchsorted(spots, end - size - p, side="right"))


def find_runs(ids: np.ndarray, lengths: np.ndarray) -> list[list[tuple[int, int, int]]]:
    """Runs (start, length, period) by start and period of each text; ``ids`` are the texts' words, one text after another."""
    starts = np.cumsum(lengths) - lengths
    doc = np.repeat(np.arange(len(lengths)), lengths)
    found = [Runs() for _ in range(len(lengths))]
    if not len(ids):
        return [[] for _ in found]
    gap = _next_same(ids, doc)
    size = 2
    while LEAST_POWER * reach(size)[0] <= lengths.max():
        seeds = _seeds(ids, starts, lengths, gap, size)
        seeds = seeds[np.argsort(seeds[:, 0], kind="stable")]
        docs, first = np.unique(seeds[:, 0], return_index=True)
        for d, x, y in zip(docs.tolist(), first.tolist(), [*first.tolist()[1:], len(seeds)]):
            _settle(ids, int(starts[d]), int(starts[d] + lengths[d]), seeds[x:y, 1:], size, found[d])
        size *= 2
    return [
        sorted((s - int(starts[d]), e - s, q) for q, (lows, ends) in runs.of.items() for s, e in zip(lows, ends)) for d, runs in enumerate(found)
    ]


def kept_words(n: int, runs: list[tuple[int, int, int]]) -> np.ndarray:
    """True for words that stay: no run holds them after its first period."""
    change = np.zeros(n + 1, dtype=np.int64)
    for start, length, period in runs:
        change[start + period] += 1
        change[start + length] -= 1
    return np.cumsum(change[:-1]) == 0


def repeated_words(doc_id: int | None, words: list[bytes]) -> list[bytes]:
    """The words of the query contract: of one document in ten a tail repeats its first words."""
    n = len(words)
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + [words[a + (i - a) % p] for i in range(a, n)]


_OUT = pa.schema([
    ("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_runs", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64()),
    ("exponent_milli", pa.int64()), ("runs", pa.list_(pa.list_(pa.int64()))), ("runs_sha256", pa.string()), ("collapsed", pa.string()),
    ("collapsed_sha256", pa.string()),
])
_OUT_SQL = (
    "doc_id long, n_words long, n_runs long, start long, length long, period long, exponent_milli long, runs array<array<long>>, "
    "runs_sha256 string, collapsed string, collapsed_sha256 string"
)


def _sha(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()


def _rows(doc_ids: list[int | None], texts: list[list[bytes]], full: bool) -> pa.RecordBatch:
    lengths = np.array([len(w) for w in texts], dtype=np.int64)
    flat = pa.array([w for words in texts for w in words], type=pa.large_binary())
    ids = flat.dictionary_encode().indices.to_numpy().astype(np.int64)
    rows = []
    for doc_id, words, runs in zip(doc_ids, texts, find_runs(ids, lengths), strict=True):
        best = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=(None, None, None))
        kept = [w for w, stays in zip(words, kept_words(len(words), runs).tolist(), strict=True) if stays] if runs else words
        collapsed = b" ".join(kept)
        rows.append(dict(
            doc_id=doc_id, n_words=len(words), n_runs=len(runs), start=best[0], length=best[1], period=best[2],
            exponent_milli=1000 * best[1] // best[2] if runs else None, runs=runs if full else None,
            runs_sha256=_sha("".join([f"{s},{n},{q}\n" for s, n, q in runs]).encode()),
            collapsed=collapsed.decode() if full else None, collapsed_sha256=_sha(collapsed),
        ))
    return pa.RecordBatch.from_pylist(rows, schema=_OUT)


def _worker(full: bool, planted: bool, batch_words: int):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts, held = [], [], 0
            column = pc.fill_null(batch.column("text").cast(pa.large_string()), "").cast(pa.large_binary())
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), column):
                # Of bytes, split() cuts at ASCII white space and nothing else.
                words = text.as_py().split()
                ids.append(doc_id)
                texts.append(repeated_words(doc_id, words) if planted else words)
                held += len(words)
                if held >= batch_words:
                    yield _rows(ids, texts, full)
                    ids, texts, held = [], [], 0
            if ids:
                yield _rows(ids, texts, full)

    return work


def word_runs(docs: DataFrame, full: bool = True, planted: bool = False, batch_words: int = BATCH_WORDS) -> DataFrame:
    """Runs of every row of ``docs`` (doc_id, text), and the text without their repetitions.

    Columns: doc_id, n_words, n_runs, start, length, period and exponent_milli of the run of the greatest exponent (ties:
    smallest start, then period), runs (start, length, period of each), runs_sha256, collapsed, collapsed_sha256; ``full=False``
    leaves runs and collapsed null. Null and empty texts have no words and no runs: four nulls and the digests of nothing.
    Rows are judged one by one, so repeated and null ids, ties and equal texts need no rule; other columns are not read.
    ``planted`` makes the tails of some documents periodic first, as the query contract says (a null id: never).
    """
    slim = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text"))
    return slim.mapInArrow(_worker(full, planted, batch_words), _OUT_SQL)


def run_table(docs: DataFrame) -> DataFrame:
    """The digest columns of ``word_runs`` after the planting of the query contract."""
    return word_runs(docs, full=False, planted=True).drop("n_words", "runs", "collapsed")
