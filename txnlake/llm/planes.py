"""Token ids in files of shuffled planes.

A segment holds whole documents in ascending order of their ids. Its token ids are cut into blocks of fixed size;
a block is transposed into byte planes (or bit planes), and each plane is compressed with zstandard on its own.
The head of a segment is its chunk index: for each block the number of ids and the length of every plane. Spark
writes the segments as rows of a Parquet table, so files appear whole or not at all, wherever the folder is.

    segment: b"IDP1", unit (8 bits for byte planes, 1 for bit planes), ids in a block, ids, blocks
             for each block: ids, planes, compressed length of each plane
             the compressed planes, block after block
"""

from __future__ import annotations

import os
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from txnlake.llm import tokens
from txnlake.llm.common import scratch_name
from txnlake.plans.groups import work_dir

MAGIC = b"IDP1"
END_ID = 0
BLOCK_IDS = 65_536
#: A segment ends with the document that reaches this many ids.
SEGMENT_IDS = 524_288
LEVEL = 3


def to_planes(ids: np.ndarray, unit: int) -> list[bytes]:
    """Planes of ``ids`` from the lowest; as many as the largest id needs, one at least."""
    top = max(1, int(ids.max()).bit_length()) if len(ids) else 1
    if unit == 8:
        columns = ids.astype("<u4").view(np.uint8).reshape(-1, 4)
        return [columns[:, i].tobytes() for i in range(-(-top // 8))]
    return [np.packbits(((ids >> np.uint32(i)) & np.uint32(1)).astype(np.uint8)).tobytes() for i in range(top)]


def from_planes(planes: list[bytes], n: int, unit: int) -> np.ndarray:
    if unit == 8:
        out = np.zeros((n, 4), dtype=np.uint8)
        for i, plane in enumerate(planes):
            out[:, i] = np.frombuffer(plane, dtype=np.uint8)
        return out.reshape(-1).view("<u4")
    out = np.zeros(n, dtype="<u4")
    for i, plane in enumerate(planes):
        out |= np.unpackbits(np.frombuffer(plane, dtype=np.uint8), count=n).astype("<u4") << np.uint32(i)
    return out


def write_segment(ids: np.ndarray, unit: int = 8, block_ids: int = BLOCK_IDS, level: int = LEVEL) -> bytes:
    packer = zstandard.ZstdCompressor(level=level)
    index, body = [], []
    blocks = [ids[i:i + block_ids] for i in range(0, len(ids), block_ids)]
    for block in blocks:
        planes = [packer.compress(p) for p in to_planes(block, unit)]
        index.append(struct.pack(f"<IB{len(planes)}I", len(block), len(planes), *map(len, planes)))
        body += planes
    return b"".join([MAGIC, struct.pack("<BIQI", unit, block_ids, len(ids), len(blocks)), *index, *body])


def read_segment(data: bytes) -> np.ndarray:
    if data[:4] != MAGIC:
        raise ValueError("not a segment of token ids")
    unit, _, total, blocks = struct.unpack_from("<BIQI", data, 4)
    at, index = 4 + struct.calcsize("<BIQI"), []
    for _ in range(blocks):
        n, count = struct.unpack_from("<IB", data, at)
        index.append((n, struct.unpack_from(f"<{count}I", data, at + 5)))
        at += 5 + 4 * count
    opener, out = zstandard.ZstdDecompressor(), [np.zeros(0, dtype="<u4")]
    for n, lengths in index:
        planes = []
        for length in lengths:
            planes.append(opener.decompress(data[at:at + length]))
            at += length
        out.append(from_planes(planes, n, unit))
    ids = np.concatenate(out)
    if len(ids) != total:
        raise ValueError(f"a segment of {total} ids holds {len(ids)}")
    return ids


SEGMENTS = "part int, segment long, first long, n_ids long, doc_ids array<long>, lengths array<long>, data binary"


def _writer(path: str, end_id: int, unit: int, segment_ids: int):
    tail = np.array([end_id], dtype="<u4").tobytes()
    schema = pa.schema([
        ("part", pa.int32()), ("segment", pa.int64()), ("first", pa.int64()), ("n_ids", pa.int64()),
        ("doc_ids", pa.list_(pa.int64())), ("lengths", pa.list_(pa.int64())), ("data", pa.binary()),
    ])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = tokens.encoder(path)
        context = TaskContext.get()
        part = context.partitionId() if context else 0
        docs, lengths, held, n, first, segment = [], [], [], 0, 0, 0

        def close() -> pa.RecordBatch:
            nonlocal n, first, segment
            data = write_segment(np.frombuffer(b"".join(held), dtype="<u4"), unit)
            row = [[part], [segment], [first], [n], [list(docs)], [list(lengths)], [data]]
            docs.clear(), lengths.clear(), held.clear()
            first, segment, n = first + n, segment + 1, 0
            return pa.RecordBatch.from_arrays([pa.array(v, type=f.type) for v, f in zip(row, schema, strict=True)], schema=schema)

        for batch in batches:
            texts = batch.column("text")
            for doc_id, ids in zip(batch.column("doc_id").to_pylist(), encoder.encode(texts), strict=True):
                ids += tail
                docs.append(doc_id)
                lengths.append(len(ids) // 4)
                held.append(ids)
                n += lengths[-1]
                if n >= segment_ids:
                    yield close()
        encoder.rest()
        if docs:
            yield close()

    return work


def write_ids(docs: DataFrame, folder: str, path: str | None = None, end_id: int = END_ID, unit: int = 8, segment_ids: int = SEGMENT_IDS) -> None:
    """Write the ids of all documents, ``end_id`` after each, to ``folder`` in ascending order of doc_id (null first).

    Rows of one id lie in the order of a hash of their texts. Null texts are empty. An empty table writes no row.
    """
    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("tie"))
    ordered = slim.repartitionByRange(parts, "doc_id", "tie").sortWithinPartitions("doc_id", "tie")
    segments = ordered.select("doc_id", "text").mapInArrow(_writer(path or tokens.default_path(), end_id, unit, segment_ids), SEGMENTS)
    segments.write.option("compression", "uncompressed").parquet(folder)


def _reader(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("part", pa.int32()), ("doc_id", pa.int64()), ("at", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.binary())])
    for batch in batches:
        for row in batch.to_pylist():
            data = read_segment(row["data"]).astype("<u4").tobytes()
            ends = np.cumsum([0, *row["lengths"]]).tolist()
            columns = [
                [row["part"]] * len(row["doc_ids"]), row["doc_ids"], [row["first"] + e for e in ends[:-1]], row["lengths"],
                [data[4 * a:4 * b] for a, b in zip(ends, ends[1:])],
            ]
            yield pa.RecordBatch.from_arrays([pa.array(v, type=f.type) for v, f in zip(columns, schema, strict=True)], schema=schema)


def read_ids(spark: SparkSession, folder: str) -> DataFrame:
    """Documents of ``folder``: doc_id, start (ids of all documents before it), n_tokens, ids (little-endian unsigned 32-bit)."""
    stored = spark.read.schema(SEGMENTS).parquet(folder)
    # One row for each partition that wrote: bounded by their number, whatever the data.
    parts = stored.groupBy("part").agg(F.sum("n_ids").alias("n"))
    parts = parts.select(F.col("part").alias("of"), F.coalesce(F.sum("n").over(
        Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    rows = stored.select("part", "first", "doc_ids", "lengths", "data").mapInArrow(
        _reader, "part int, doc_id long, at long, n_tokens long, ids binary")
    return rows.join(F.broadcast(parts), F.col("part") == F.col("of")).select(
        "doc_id", (F.col("before") + F.col("at")).alias("start"), "n_tokens", "ids")


def id_table(docs: DataFrame, path: str | None = None) -> DataFrame:
    """Write the ids of ``docs``, read them back, and return doc_id, start, n_tokens, ids_crc32 of every document."""
    folder = os.path.join(work_dir(docs.sparkSession), f"ids-{scratch_name()}")
    write_ids(docs, folder, path)
    return read_ids(docs.sparkSession, folder).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))
