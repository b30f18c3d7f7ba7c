"""String similarity on a 0-100 scale, as Arrow UDFs over short names and rule lists.

All scores rest on the longest common subsequence, found with one machine word per pattern.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import functions as F


def common_length(a: str, b: str) -> int:
    """Length of the longest common subsequence, bit-parallel over ``a``."""
    where: dict[str, int] = {}
    for i, ch in enumerate(a):
        where[ch] = where.get(ch, 0) | (1 << i)
    full = (1 << len(a)) - 1
    free = full
    for ch in b:
        hit = free & where.get(ch, 0)
        free = ((free + hit) | (free - hit)) & full
    return len(a) - free.bit_count()


def indel_ratio(a: str, b: str) -> float:
    total = len(a) + len(b)
    return 100.0 if total == 0 else 200.0 * common_length(a, b) / total


def token_sort_ratio(a: str, b: str) -> float:
    return indel_ratio(" ".join(sorted(a.split())), " ".join(sorted(b.split())))


def token_set_ratio(a: str, b: str) -> float:
    left, right = set(a.split()), set(b.split())
    if not left or not right:
        return 0.0
    shared = " ".join(sorted(left & right))
    only_left, only_right = " ".join(sorted(left - right)), " ".join(sorted(right - left))
    if shared and (not only_left or not only_right):
        return 100.0
    with_left, with_right = f"{shared} {only_left}".strip(), f"{shared} {only_right}".strip()
    best = indel_ratio(with_left, with_right)
    if shared:
        best = max(best, indel_ratio(shared, with_left), indel_ratio(shared, with_right))
    return best


def partial_ratio(a: str, b: str) -> float:
    """Best ratio of the shorter text against any stretch of the longer one, its ends included.

    All stretches advance together, one character of the stretch per step.
    """
    short, long = (a, b) if len(a) <= len(b) else (b, a)
    m, n = len(short), len(long)
    if m == 0:
        return 100.0 if n == 0 else 0.0
    if short in long:
        return 100.0
    if m > 64:
        stretches = [long[max(0, i):min(n, i + m)] for i in range(1 - m, n)]
        return max(indel_ratio(short, s) for s in stretches)
    codes = np.zeros(n + 2 * (m - 1), dtype=np.int64)
    codes[m - 1:m - 1 + n] = np.frombuffer(long.encode("utf-32-le"), dtype=np.uint32)
    hits = np.zeros(len(codes), dtype=np.uint64)
    for i, ch in enumerate(short):
        hits[codes == ord(ch)] |= np.uint64(1 << i)
    starts = n + m - 1
    free = np.full(starts, (1 << m) - 1, dtype=np.uint64)
    full = np.uint64((1 << m) - 1)
    for step in range(m):
        hit = free & hits[step:step + starts]
        free = ((free + hit) | (free - hit)) & full
    common = m - np.bitwise_count(free).astype(np.int64)
    first = np.arange(starts) - (m - 1)
    inside = np.minimum(first + m, n) - np.maximum(first, 0)
    return float((200.0 * common / (m + inside)).max())


def name_score(name: str, pattern: str) -> float:
    """Best of the token and partial ratios; a pattern inside the name counts at least 90."""
    score = max(token_sort_ratio(name, pattern), token_set_ratio(name, pattern), partial_ratio(name, pattern))
    return max(score, 90.0) if pattern in name else score


def _memo(texts: pd.Series, choose: Callable[[str], tuple]) -> pd.DataFrame:
    """``choose`` once per distinct text of the batch."""
    found = {t: choose(t) for t in texts.dropna().unique()}
    rows = [found.get(t, (None, None)) if t is not None else (None, None) for t in texts]
    return pd.DataFrame({
        "idx": pd.array([r[0] for r in rows], dtype="Int32"),
        "score": pd.Series([r[1] for r in rows], dtype="float64"),
    })


def best_ratio_udf(candidates: Sequence[str], threshold: float):
    """UDF: (idx, score) of the closest candidate at or above ``threshold``; the first wins ties."""
    listed = list(candidates)

    def choose(text: str) -> tuple:
        best = (None, None)
        floor = threshold
        for i, candidate in enumerate(listed):
            total = len(text) + len(candidate)
            if total == 0 or 200.0 * min(len(text), len(candidate)) / total < floor:
                continue
            score = indel_ratio(text, candidate)
            if score >= floor and (best[1] is None or score > best[1]):
                best, floor = (i, score), score
        return best

    @F.pandas_udf("idx int, score double")
    def best_ratio(texts: pd.Series) -> pd.DataFrame:
        return _memo(texts, choose)

    return best_ratio


def best_name_udf(patterns: Sequence[tuple[int, str]], threshold: float):
    """UDF: (rule idx, score) of the best fuzzy name pattern; the first wins ties."""
    listed = list(patterns)

    def choose(text: str) -> tuple:
        best = (None, None)
        for rule, pattern in listed:
            score = name_score(text, pattern)
            if score >= threshold and (best[1] is None or score > best[1]):
                best = (rule, score)
        return best

    @F.pandas_udf("idx int, score double")
    def best_name(texts: pd.Series) -> pd.DataFrame:
        return _memo(texts, choose)

    return best_name


class TextBatch:
    """Texts laid end to end with room between them, so that one pass scores a pattern on all."""

    def __init__(self, texts: Sequence[str], gap: int):
        self.texts = texts
        self.lengths = np.array([len(t) for t in texts], dtype=np.int64)
        self.starts = gap + np.concatenate(([0], np.cumsum(self.lengths + gap)[:-1])).astype(np.int64)
        codes = np.zeros(int((self.lengths + gap).sum()) + gap, dtype=np.uint32)
        for start, t in zip(self.starts, texts):
            codes[start:start + len(t)] = np.frombuffer(t.encode("utf-32-le"), dtype=np.uint32)
        there = np.bincount(codes) > 0
        self.letters, self.places = np.flatnonzero(there), (np.cumsum(there) - 1)[codes]

    def partial_ratios(self, pattern: str) -> np.ndarray:
        """Partial ratio of a pattern, no longer than the room between texts, against every text of the batch."""
        m = len(pattern)
        if not 0 < m <= 64:
            return np.array([partial_ratio(pattern, t) for t in self.texts])
        kind = np.uint8 if m <= 8 else np.uint16 if m <= 16 else np.uint32 if m <= 32 else np.uint64
        full = kind((1 << m) - 1)
        table = np.zeros(len(self.letters), dtype=kind)
        for i, ch in enumerate(pattern):
            table[self.letters == ord(ch)] |= kind(1 << i)
        hits = table[self.places]
        n = len(hits) - m + 1
        free = np.full(n, full, dtype=kind)
        hit, rest = np.empty_like(free), np.empty_like(free)
        for step in range(m):
            np.bitwise_and(free, hits[step:step + n], out=hit)
            np.subtract(free, hit, out=rest)
            np.add(free, hit, out=free)
            np.bitwise_or(free, rest, out=free)
            np.bitwise_and(free, full, out=free)
        common = m - np.bitwise_count(free)
        # Stretch i of a text starts at start + i, for i from 1 - m up to its length - 1; whole ones lie in its body.
        body = np.stack([self.starts, self.starts + np.maximum(self.lengths - m, 0) + 1], axis=1).ravel()
        best = 200.0 * np.maximum.reduceat(common, body)[::2] / (2 * m)
        if m > 1:
            ends = np.arange(1, m)
            for at in (self.starts[:, None] - m + ends, (self.starts + self.lengths)[:, None] - ends):
                best = np.maximum(best, (200.0 * common[at] / (m + ends)).max(axis=1))
        for j in np.flatnonzero(self.lengths < m):
            best[j] = partial_ratio(pattern, self.texts[j])
        return best


#: Letters that a batch is scored at a time: as many as stay in a core's cache.
LETTERS_AT_ONCE = 1 << 17


def _batches(texts: Sequence[str], gap: int) -> Iterator[TextBatch]:
    some, letters = [], 0
    for t in texts:
        some.append(t)
        letters += len(t) + gap
        if letters >= LETTERS_AT_ONCE:
            yield TextBatch(some, gap)
            some, letters = [], 0
    if some:
        yield TextBatch(some, gap)


def best_groups(texts: Sequence[str], groups: Sequence[Sequence[str]], threshold: float) -> list[tuple]:
    """(group idx, score) of each text: a group scores by its first pattern over ``threshold``, the first group wins ties."""
    found: list[tuple] = []
    for batch in _batches(texts, max((len(p) for g in groups for p in g), default=1) or 1):
        idx, score = np.full(len(batch.texts), -1), np.zeros(len(batch.texts))
        for g, patterns in enumerate(groups):
            first = np.full(len(batch.texts), -1.0)
            for p in patterns:
                ratio = batch.partial_ratios(p)
                first = np.where((first < 0) & (ratio >= threshold), ratio, first)
            better = first > score
            idx[better], score[better] = g, first[better]
        found += [(int(i), float(s)) if i >= 0 else (None, None) for i, s in zip(idx, score)]
    return found


def best_group_udf(groups: Sequence[Sequence[str]], threshold: float):
    """UDF: (group idx, score) of `best_groups`, without regard to case."""
    listed = [[p.lower() for p in g] for g in groups]

    @F.pandas_udf("idx int, score double")
    def best_group(texts: pd.Series) -> pd.DataFrame:
        distinct = list(texts.dropna().unique())
        found = dict(zip(distinct, best_groups([t.lower() for t in distinct], listed, threshold)))
        return _memo(texts, lambda t: found[t])

    return best_group


def ratio_udf(score: Callable[[str, str], float]):
    """UDF form of one of the ratios above over two columns."""

    @F.pandas_udf("double")
    def ratio(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([None if x is None or y is None else score(x, y) for x, y in zip(a, b)], dtype="float64")

    return ratio
