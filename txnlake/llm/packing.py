"""Best-fit decreasing packing of tokenized documents into fixed windows.

Overlong documents are first cut into full windows. What is left of each document goes, longest first, into the
tightest open window that still takes it, found in a segment tree over remaining capacities. A task packs the
documents of its partition in buffers of bounded size; windows of a buffer that are not nearly full are opened
again for the next. So nothing is shuffled, and padding is a few windows for each partition.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from txnlake.llm import tokens

WINDOW = 2048
END_ID = 1
#: Ids that a task holds back before it packs them.
BUFFER_IDS = 4_000_000
#: Windows of a buffer with at least this share filled are closed; the others' pieces join the next buffer.
FULL_ENOUGH = 0.995
#: Ids that an output batch carries.
BATCH_IDS = 500_000


class Capacities:
    """Segment tree over remaining capacities 0 to ``most``: how many open windows have each."""

    def __init__(self, most: int):
        self.size = 1 << most.bit_length()
        self.count = [0] * (2 * self.size)
        self.windows: dict[int, list[int]] = {}

    def add(self, capacity: int, window: int) -> None:
        self.windows.setdefault(capacity, []).append(window)
        self._change(capacity, 1)

    def _change(self, capacity: int, by: int) -> None:
        node = self.size + capacity
        while node:
            self.count[node] += by
            node >>= 1

    def take(self, least: int) -> tuple[int, int] | None:
        """Remove and return (capacity, window) with the smallest capacity of at least ``least``; None if there is none."""
        node = self.size + least
        while not self.count[node]:
            while node & 1:  # a right child: nothing larger below this parent
                node >>= 1
                if node <= 1:
                    return None
            node += 1
        while node < self.size:
            node = 2 * node if self.count[2 * node] else 2 * node + 1
        capacity = node - self.size
        window = self.windows[capacity].pop()
        self._change(capacity, -1)
        return capacity, window


def best_fit_decreasing(lengths: list[int], window: int) -> list[list[int]]:
    """Indexes of ``lengths`` (each at most ``window``) by window, in the order in which they lie there."""
    out: list[list[int]] = []
    tree = Capacities(window)
    for i in sorted(range(len(lengths)), key=lambda i: (-lengths[i], i)):
        found = tree.take(lengths[i])
        if found is None:
            out.append([i])
            left = window - lengths[i]
            place = len(out) - 1
        else:
            capacity, place = found
            out[place].append(i)
            left = capacity - lengths[i]
        if left:
            tree.add(left, place)
    return out


SCHEMA = "sequence_id long, offset long, doc_id long, start long, length long, doc_tokens long, ids binary"


def _packer(path: str, window: int, end_id: int, buffer_ids: int):
    tail = np.array([end_id], dtype="<u4").tobytes()
    schema = pa.schema([(c, pa.int64()) for c in ("sequence_id", "offset", "doc_id", "start", "length", "doc_tokens")] + [("ids", pa.binary())])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = tokens.encoder(path)
        context = TaskContext.get()
        sequence = (context.partitionId() if context else 0) << 40
        ready: list[tuple] = []
        held: list[tuple] = []  # (doc_id, start, doc_tokens, ids)
        ready_ids = held_ids = 0

        def emit(pieces: list[tuple]) -> None:
            nonlocal sequence, ready_ids
            offset = 0
            for doc_id, start, total, ids in pieces:
                n = len(ids) // 4
                ready.append((sequence, offset, doc_id, start, n, total, ids))
                offset += n
            ready_ids += offset
            sequence += 1

        def flush(last: bool) -> None:
            nonlocal held, held_ids
            lengths = [len(p[3]) // 4 for p in held]
            kept: list[tuple] = []
            for places in best_fit_decreasing(lengths, window):
                pieces = [held[i] for i in places]
                if last or sum(lengths[i] for i in places) >= FULL_ENOUGH * window:
                    emit(pieces)
                else:
                    kept += pieces
            held, held_ids = kept, sum(len(p[3]) // 4 for p in kept)

        def batch() -> pa.RecordBatch:
            nonlocal ready_ids
            columns = list(zip(*ready, strict=True))
            out = pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)
            ready.clear()
            ready_ids = 0
            return out

        limit = buffer_ids
        for part in batches:
            ids_of, texts = part.column("doc_id").to_pylist(), part.column("text")
            for doc_id, ids in zip(ids_of, encoder.encode(texts), strict=True):
                ids += tail
                total = len(ids) // 4
                full = total // window * window
                for start in range(0, full, window):
                    emit([(doc_id, start, total, ids[4 * start:4 * (start + window)])])
                if full < total:
                    held.append((doc_id, full, total, ids[4 * full:]))
                    held_ids += total - full
                if held_ids >= limit:
                    flush(False)
                    limit = held_ids + buffer_ids
                if ready_ids >= BATCH_IDS:
                    yield batch()
        flush(True)
        encoder.rest()
        if ready:
            yield batch()

    return work


def pack(docs: DataFrame, path: str | None = None, window: int = WINDOW, end_id: int = END_ID, buffer_ids: int = BUFFER_IDS) -> DataFrame:
    """Pieces of all documents in sequences of at most ``window`` ids: sequence_id, offset, doc_id, start, length, doc_tokens, ids.

    ``docs`` needs doc_id and text; other columns are left out. A document is the ids of its whole text (null:
    none) and ``end_id``; it lies in pieces that don't overlap, each a part of one sequence, gapless from offset
    0. ``ids`` are little-endian unsigned 32-bit numbers. Repeated rows and null ids are documents of their own.
    An empty table gives no piece.
    """
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return slim.mapInArrow(_packer(path or tokens.default_path(), window, end_id, buffer_ids), SCHEMA)


def pack_table(docs: DataFrame, path: str | None = None) -> DataFrame:
    """Pieces of `pack` with a checksum of their ids instead of the ids."""
    return pack(docs, path).select(
        "doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
