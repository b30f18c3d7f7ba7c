"""Alignment of two tokenizers' ids by the bytes they cover.

Both tokenizers cut the same bytes into tokens; where tokens of both end, a group ends. A stretch of bytes gives a
fragment: tokens before its first common end (open prefix), closed groups, tokens after its last common end (open
suffix). Fragments compose: the suffix of one and the prefix of the next become a group, or stay open if neither stretch
has a common end. Composition is associative, so a long document is cut into byte ranges that are encoded by different
tasks and composed in a tree, a few fragments to a task and round. A short document is one stretch.

The tokenizers are asked only for parts: neither merges across a blank that begins a run of white space, so a text is
cut there. Tasks work on blocks of texts. A block writes how often each unit has each group, which id pairs the groups
link, and how many of its documents have a pair linked; corpus counts of the pairs come back to the blocks that have
them by a join, so that nothing is broadcast and no (document, pair) row is shuffled for a document in one block.
"""

from __future__ import annotations

import hashlib
import os
import re
from array import array
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from txnlake.llm.tokens import byte_letters
from txnlake.plans.groups import durable

#: Texts of more bytes are cut into ranges of so many.
RANGE_BYTES = 65_536
#: Bytes of text that make a block, and parts that a worker remembers between blocks.
BLOCK_BYTES, REMEMBERED = 8 << 20, 250_000
#: Fragments that one step of the tree composes.
FAN = 16
#: New parts that go through a tokenizer in one call, and that are entered at a time.
CALL_PARTS, LEARNED = 500, 20_000
_SPLIT = re.compile(r"(?<=\S) ")


class Fragment(NamedTuple):
    """A stretch of bytes. Without ``cut`` (no common end) all of its tokens are in ``pa`` and ``pb``."""

    cut: bool = False
    pa: tuple = ()
    pb: tuple = ()
    closed: str = ""
    sa: tuple = ()
    sb: tuple = ()
    n_a: int = 0
    n_b: int = 0
    n_groups: int = 0
    n_links: int = 0
    #: Groups made by composing, which no block has counted.
    seams: tuple = ()
    bad: bool = False


def _group(a: tuple, b: tuple) -> str:
    return ",".join(map(str, a)) + "|" + ",".join(map(str, b))


def compose(f: Fragment, g: Fragment) -> Fragment:
    """The fragment of two adjacent stretches; associative, with ``Fragment()`` as its identity."""
    bad = f.bad or g.bad
    if not f.cut and not g.cut:
        return Fragment(False, f.pa + g.pa, f.pb + g.pb, seams=f.seams + g.seams, bad=bad)
    if not f.cut:
        return g._replace(pa=f.pa + g.pa, pb=f.pb + g.pb, seams=f.seams + g.seams, bad=bad)
    if not g.cut:
        return f._replace(sa=f.sa + g.pa, sb=f.sb + g.pb, seams=f.seams + g.seams, bad=bad)
    a, b = f.sa + g.pa, f.sb + g.pb
    middle = [_group(a, b)] if a or b else []
    return Fragment(
        True, f.pa, f.pb, ";".join([x for x in (f.closed, *middle, g.closed) if x]), g.sa, g.sb,
        f.n_a + g.n_a + len(a), f.n_b + g.n_b + len(b), f.n_groups + g.n_groups + len(middle), f.n_links + g.n_links + len(a) * len(b),
        f.seams + tuple(middle) + g.seams, bad,
    )


def whole_document(f: Fragment) -> Fragment:
    """The fragment of a whole document: its start and its end are common ends."""
    edge = Fragment(cut=True)
    return compose(compose(edge, f), edge)


def fragment(ids_a: list[int], ends_a: np.ndarray, ids_b: list[int], ends_b: np.ndarray, low: int, high: int) -> Fragment:
    """The fragment of the tokens that end in (low, high]."""
    i, j = np.searchsorted(ends_a, [low, high], side="right")
    u, v = np.searchsorted(ends_b, [low, high], side="right")
    a, b, ends_a, ends_b = ids_a[i:j], ids_b[u:v], ends_a[i:j], ends_b[u:v]
    common = np.intersect1d(ends_a, ends_b)
    cuts_a = np.searchsorted(ends_a, common, side="right").tolist()
    cuts_b = np.searchsorted(ends_b, common, side="right").tolist()
    if not cuts_a:
        return Fragment(False, tuple(a), tuple(b))
    f = Fragment(True, tuple(a[:cuts_a[0]]), tuple(b[:cuts_b[0]]))
    for x, y, s, t in zip(cuts_a, cuts_a[1:], cuts_b, cuts_b[1:]):
        f = compose(f, Fragment(True, tuple(a[x:y]), tuple(b[s:t])))
    return compose(f, Fragment(False, tuple(a[cuts_a[-1]:]), tuple(b[cuts_b[-1]:])))


def default_paths() -> tuple[str, str]:
    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def _ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indices of the stretches [start, start + length), one after another."""
    ends = np.cumsum(lengths)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - (ends - lengths), lengths)


class Parts:
    """Parts that a worker has encoded: their groups, and the id pairs of each group."""

    def __init__(self, path_a: str, path_b: str):
        os.environ.setdefault("RAYON_NUM_THREADS", "1")
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(path_a)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        letters = {c: i for i, c in byte_letters().items()}
        vocabulary = self.a.get_vocab()
        self.bytes_a = [b""] * (max(vocabulary.values()) + 1)
        for entry, i in vocabulary.items():
            self.bytes_a[i] = bytes(letters[c] for c in entry) if all(c in letters for c in entry) else entry.encode()
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.bytes_b = [
            bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)
        ]
        # A piece with a blank inside would make cuts at blanks unsafe.
        self.cuts = not any(re.search("[^▁]▁", p) for p in pieces)
        self.size_a = np.array([len(x) for x in self.bytes_a])
        self.size_b = np.array([len(x) for x in self.bytes_b])
        self.blank = [self.b.piece_to_id("▁")]
        self.text_a, self.text_b = [str(i) for i in range(len(self.bytes_a))], [str(i) for i in range(len(self.bytes_b))]
        self.forget()

    def forget(self) -> None:
        self.index: dict[str, int] = {}
        self.string: list[str] = []
        self.bad: set[int] = set()
        self.groups, self.groups_at = array("i"), array("q", [0])
        self.group_index: dict[str, int] = {}
        self.group_a, self.group_b = array("i"), array("i")
        self.pairs, self.pairs_at = array("q"), array("q", [0])

    def encode(self, parts: list[str]) -> tuple[list[int], np.ndarray, list[int], np.ndarray]:
        """Ids and byte ends of blank-led parts, given without the blank, as if they stood one after another."""
        calls, held = [], []
        for p in parts:
            held += " ", p
            # White space at the end of a part would run on into the next one.
            if len(held) >= 2 * CALL_PARTS or not p or p[-1].isspace():
                calls.append("".join(held))
                held = []
        calls.append("".join(held))
        ids_a = [i for e in self.a.encode_batch_fast(calls, add_special_tokens=False) for i in e.ids]
        # A lone blank is a token, which the model leaves out when it is given no more than that.
        ids_b = [i for ids in self.b.encode(parts, num_threads=1) for i in ids or self.blank]
        return ids_a, np.cumsum(self.size_a[ids_a]), ids_b, np.cumsum(self.size_b[ids_b])

    def true_bytes(self, part: str) -> bool:
        """True when the bytes of both tokenizers' tokens are those of the part."""
        ids_a, _, ids_b, _ = self.encode([part])
        want = (" " + part).encode()
        return b"".join(self.bytes_a[i] for i in ids_a) == want == b"".join(self.bytes_b[i] for i in ids_b)

    def learn(self, parts: list[str]) -> None:
        """Enter parts that are not in the index yet."""
        ids_a, ends_a, ids_b, ends_b = self.encode(parts)
        want = "".join([" " + p for p in parts]).encode()
        wrong = set()
        if b"".join([self.bytes_a[i] for i in ids_a]) != want or b"".join([self.bytes_b[i] for i in ids_b]) != want:
            wrong = {p for p in parts if not self.true_bytes(p)}
            ids_a, ends_a, ids_b, ends_b = self.encode([p for p in parts if p not in wrong])
        common = np.intersect1d(ends_a, ends_b, assume_unique=True)
        cuts_a = np.searchsorted(ends_a, common, side="right").tolist()
        cuts_b = np.searchsorted(ends_b, common, side="right").tolist()
        a, b = [self.text_a[i] for i in ids_a], [self.text_b[i] for i in ids_b]
        names, x, s = [], 0, 0
        for y, t in zip(cuts_a, cuts_b, strict=True):
            names.append((a[x] if y == x + 1 else ",".join(a[x:y])) + "|" + (b[s] if t == s + 1 else ",".join(b[s:t])))
            x, s = y, t
        known, numbers = self.group_index, []
        for k, name in enumerate(names):
            number = known.get(name)
            if number is None:
                number = known[name] = len(known)
                left, right = ids_a[cuts_a[k - 1] if k else 0:cuts_a[k]], ids_b[cuts_b[k - 1] if k else 0:cuts_b[k]]
                self.group_a.append(len(left))
                self.group_b.append(len(right))
                self.pairs.extend([(i << 32) | j for i in left for j in right])
                self.pairs_at.append(len(self.pairs))
            numbers.append(number)
        last = np.cumsum([0 if p in wrong else 1 + len(p.encode()) for p in parts])
        stops, at = np.searchsorted(common, last, side="right").tolist(), 0
        for p, stop in zip(parts, stops, strict=True):
            if p in wrong:
                self.bad.add(len(self.string))
            self.index[p] = len(self.string)
            self.string.append(";".join(names[at:stop]))
            self.groups.extend(numbers[at:stop])
            self.groups_at.append(len(self.groups))
            at = stop

    def split(self, text: str) -> list[str]:
        """The parts of a blank and ``text``, each without its leading blank."""
        first, *rest = _SPLIT.split(" " + text) if self.cuts else [" " + text]
        return [first[1:], *rest]

    def numbers(self, texts: pa.Array) -> list[np.ndarray]:
        """The numbers of each text's parts."""
        pieces = pc.split_pattern(texts, " ")
        offsets = pieces.offsets.to_numpy() - pieces.offsets.to_numpy()[0]
        coded = pieces.flatten().dictionary_encode()
        codes, values = coded.indices.to_numpy(), coded.dictionary.to_pylist()
        # Where a blank may not begin its run, the text is split on its own.
        odd = np.fromiter((v == "" or v[-1].isspace() for v in values), bool, len(values))
        alone = set((np.searchsorted(offsets, np.flatnonzero(odd[codes]), side="right") - 1).tolist())
        if not self.cuts:
            alone = set(range(len(texts)))
        apart = {i: self.split(texts[i].as_py()) for i in sorted(alone)}
        new = dict.fromkeys(v for v, o in zip(values, odd.tolist(), strict=True) if not o) if self.cuts else {}
        for parts in apart.values():
            new.update(dict.fromkeys(parts))
        new = [v for v in new if v not in self.index]
        for i in range(0, len(new), LEARNED):
            self.learn(new[i:i + LEARNED])
        place = np.fromiter((self.index.get(v, -1) for v in values), np.int64, len(values))
        out = []
        for i, (x, y) in enumerate(zip(offsets.tolist(), offsets.tolist()[1:])):
            out.append(np.array([self.index[p] for p in apart[i]], dtype=np.int64) if i in apart else place[codes[x:y]])
        return out


def _safe(data: bytes, i: int) -> bool:
    """True when the blank at ``i`` begins a run of white space."""
    start = i - 1
    while start > 0 and data[start] & 0xC0 == 0x80:
        start -= 1
    return i > 0 and not data[start:i].decode().isspace()


def byte_ranges(text: str, size: int) -> list[tuple[int, int, int, int]]:
    """Cut a blank and ``text`` into ranges: (start, end of the context to encode, low, high within the context).

    Ranges have ``size`` bytes wherever they end; a context goes from the last safe blank before to the first one after.
    A range that would end in a run of bytes without a safe blank that began before it goes on to the end of that run,
    so no run is encoded more than twice.
    """
    data = (" " + text).encode()

    def before(i: int) -> int:
        while i > 0 and not (data[i:i + 1] == b" " and _safe(data, i)):
            i = data.rfind(b" ", 0, i)
        return max(i, 0)

    def after(i: int) -> int:
        while 0 <= i < len(data) and not (data[i:i + 1] == b" " and _safe(data, i)):
            i = data.find(b" ", i + 1)
        return i if 0 <= i < len(data) else len(data)

    out, low = [], 0
    while low < len(data):
        high = min(low + size, len(data))
        if high < len(data) and before(high) <= low:
            high = after(high)
        start, end = before(low), after(high)
        out.append((start, end, low - start, high - start))
        low = high
    return out


CHUNKS = "owner long, doc_id long, seq int, text string, low int, high int"


def _chunker(size: int):
    schema = pa.schema([("owner", pa.int64()), ("doc_id", pa.int64()), ("seq", pa.int32()), ("text", pa.string()), ("low", pa.int32()), ("high", pa.int32())])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for owner, doc_id, text in zip(*(batch.column(c).to_pylist() for c in ("owner", "doc_id", "text"))):
                data = (" " + text).encode()
                for seq, (start, end, low, high) in enumerate(byte_ranges(text, size)):
                    # The context begins with a blank, which is left out as in whole texts.
                    row = (owner, doc_id, seq, data[start + 1:end].decode(), low, high)
                    yield pa.RecordBatch.from_arrays([pa.array([v], type=f.type) for v, f in zip(row, schema, strict=True)], schema=schema)

    return work


_IDS = pa.list_(pa.int32())
_UNIT = pa.struct([
    ("owner", pa.int64()), ("doc_id", pa.int64()), ("seq", pa.int32()), ("bad", pa.bool_()), ("n_a", pa.int64()), ("n_b", pa.int64()),
    ("n_groups", pa.int64()), ("n_links", pa.int64()), ("sha", pa.string()), ("cut", pa.bool_()), ("closed", pa.string()), ("pa", _IDS),
    ("pb", _IDS), ("sa", _IDS), ("sb", _IDS), ("seams", pa.list_(pa.string())), ("pairs", pa.list_(pa.int64())),
])
_BLOCK = pa.schema([
    ("block", pa.int64()), ("units", pa.list_(_UNIT)), ("pairs", pa.list_(pa.int64())), ("docs_in", pa.list_(pa.int32())), ("data", pa.binary()),
])
_FRAGMENT_SQL = (
    "n_a long, n_b long, n_groups long, n_links long, sha string, cut boolean, closed string, pa array<int>, pb array<int>, "
    "sa array<int>, sb array<int>, seams array<string>"
)
BLOCKS = (
    "block long, units array<struct<owner: long, doc_id: long, seq: int, bad: boolean, " + _FRAGMENT_SQL.replace(" long", ": long")
    .replace(" string", ": string").replace(" boolean", ": boolean").replace(" array", ": array")
    + ", pairs: array<long>>>, pairs array<long>, docs_in array<int>, data binary"
)


def _pack(arrays: list[np.ndarray]) -> bytes:
    """Arrays of small numbers as compressed byte planes."""
    out = [np.array([len(x) for x in arrays], dtype="<u8").tobytes()]
    out += [np.ascontiguousarray(x.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes() for x in arrays]
    return zstandard.ZstdCompressor(level=3).compress(b"".join(out))


def _unpack(data: bytes, n: int) -> list[np.ndarray]:
    data = zstandard.ZstdDecompressor().decompress(data)
    out, at = [], 8 * n
    for size in np.frombuffer(data, dtype="<u8", count=n).tolist():
        planes = np.frombuffer(data, dtype=np.uint8, count=4 * size, offset=at).reshape(4, size)
        out.append(np.ascontiguousarray(planes.T).view("<u4").reshape(-1).astype(np.int64))
        at += 4 * size
    return out


def _edge(parts: Parts, part: str, low: int, high: int) -> Fragment:
    """The fragment of the tokens of one part that end in (low, high]."""
    ids_a, ends_a, ids_b, ends_b = parts.encode([part])
    return fragment(ids_a, ends_a, ids_b, ends_b, low, high)


def _block(parts: Parts, block: int, rows: list[tuple], texts: pa.Array) -> pa.RecordBatch:
    """One block from (owner, doc_id, seq, low, high) and texts; whole texts have no owner."""
    if len(parts.index) > REMEMBERED:
        parts.forget()
    numbers = parts.numbers(texts)
    groups, groups_at = np.array(parts.groups, dtype=np.int64), np.array(parts.groups_at)
    group_a, group_b = np.array(parts.group_a, dtype=np.int64), np.array(parts.group_b, dtype=np.int64)
    filled = pc.binary_length(texts).to_pylist()
    units, owned, times = [], [], []
    for k, ((owner, doc_id, seq, low, high), mine) in enumerate(zip(rows, numbers, strict=True)):
        bad = bool(parts.bad) and not parts.bad.isdisjoint(mine.tolist())
        unit = dict(owner=owner, doc_id=doc_id, seq=seq, bad=bad)
        edges = [Fragment(), Fragment()]
        if bad or (owner is None and not filled[k]):
            mine = mine[:0]
        elif owner is not None:
            # Only the first and the last part of a range can lie in it in part.
            names = parts.split(texts[k].as_py())
            sizes = [1 + len(n.encode()) for n in names]
            total = sum(sizes)
            if len(names) == 1:
                edges[0], mine = _edge(parts, names[0], low, high), mine[:0]
            else:
                edges[0] = _edge(parts, names[0], low, sizes[0])
                edges[1] = _edge(parts, names[-1], 0, high - (total - sizes[-1]))
                mine = mine[1:-1]
        sequence = groups[_ranges(groups_at[mine], groups_at[mine + 1] - groups_at[mine])]
        a, b = group_a[sequence], group_b[sequence]
        string = ";".join([parts.string[i] for i in mine.tolist()])
        inner = Fragment(len(mine) > 0, closed=string, n_a=int(a.sum()), n_b=int(b.sum()), n_groups=len(sequence), n_links=int((a * b).sum()))
        f = inner if owner is None else compose(compose(edges[0], inner), edges[1])
        unit |= dict(n_a=f.n_a, n_b=f.n_b, n_groups=f.n_groups, n_links=f.n_links)
        if owner is None:
            unit["sha"] = hashlib.sha256(string.encode()).hexdigest() if string else ""
        else:
            unit |= dict(cut=f.cut, closed=f.closed, pa=f.pa, pb=f.pb, sa=f.sa, sb=f.sb, seams=f.seams)
        own, n = np.unique(sequence, return_counts=True)
        units.append(unit)
        owned.append(own)
        times.append(n)
    have = np.unique(np.concatenate([np.zeros(0, dtype=np.int64), *owned]))
    pairs, pairs_at = np.array(parts.pairs, dtype=np.int64), np.array(parts.pairs_at)
    sizes = (pairs_at[1:] - pairs_at[:-1])[have]
    codes, place = np.unique(pairs[_ranges(pairs_at[have], sizes)], return_inverse=True)
    del pairs
    starts = np.cumsum(sizes) - sizes
    docs_in, stamp = np.zeros(len(codes), dtype=np.int32), np.zeros(len(codes), dtype=np.int64)
    local = [np.searchsorted(have, own) for own in owned]
    for unit, mine in zip(units, local, strict=True):
        links = place[_ranges(starts[mine], sizes[mine])]
        order = np.arange(len(links))
        stamp[links] = order
        first = links[stamp[links] == order]
        if unit["owner"] is None:
            docs_in[first] += 1
        else:
            unit["pairs"] = codes[first]
    data = _pack([np.array([len(x) for x in local]), np.concatenate([have[:0], *local]), np.concatenate([have[:0], *times]), sizes, place])
    row = [[block], [units], [codes], [docs_in], [data]]
    return pa.RecordBatch.from_arrays([pa.array(v, type=f.type) for v, f in zip(row, _BLOCK, strict=True)], schema=_BLOCK)


def _blocker(paths: tuple[str, str], block_bytes: int):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = Parts(*paths)
        context = TaskContext.get()
        block = (context.partitionId() if context else 0) << 32
        for batch in batches:
            texts = pc.fill_null(batch.column("text").cast(pa.large_string()), "")
            names = ("owner", "doc_id", "seq", "low", "high")
            rows = list(zip(*(batch.column(c).to_pylist() for c in names)))
            sizes, at = np.cumsum(pc.binary_length(texts).to_numpy()), 0
            while at < len(texts):
                end = max(at + 1, int(np.searchsorted(sizes, (sizes[at - 1] if at else 0) + block_bytes)))
                yield _block(parts, block, rows[at:end], texts.slice(at, end - at))
                at, block = end, block + 1

    return work


def _tree(fragments: DataFrame) -> DataFrame:
    """One fragment for each owner, composed in rounds of ``FAN``."""
    schema = f"owner long, doc_id long, seq int, bad boolean, {_FRAGMENT_SQL}"
    names = [f.name for f in fragments.schema]

    def step(table: pa.Table) -> pa.Table:
        rows = sorted(table.to_pylist(), key=lambda r: r["seq"])
        whole = Fragment()
        for r in rows:
            values = {k: tuple(r[k] or ()) if k in ("pa", "pb", "sa", "sb", "seams") else r[k] for k in Fragment._fields}
            whole = compose(whole, Fragment(**values))
        out = rows[0] | whole._asdict() | {"seq": rows[0]["seq"] // FAN}
        return pa.Table.from_pylist([{k: out[k] for k in names}], schema=table.schema)

    while not fragments.filter("seq > 0").isEmpty():
        fragments = durable(fragments.groupBy("owner", F.floor(F.col("seq") / FAN).alias("to")).applyInArrow(
            lambda table: step(table.select(names)), schema))
    return fragments


def _end(fragments: DataFrame) -> DataFrame:
    """Numbers, digest and seams of the documents that were cut into ranges."""
    schema = "owner long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, seams array<string>"
    shape = pa.schema([("owner", pa.int64()), ("doc_id", pa.int64()), *((c, pa.int64()) for c in ("n_a", "n_b", "n_groups", "n_links")),
                       ("groups_sha256", pa.string()), ("seams", pa.list_(pa.string()))])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for r in batch.to_pylist():
                values = {k: tuple(r[k] or ()) if k in ("pa", "pb", "sa", "sb", "seams") else r[k] for k in Fragment._fields}
                f = Fragment() if r["bad"] else whole_document(Fragment(**values))
                sha = hashlib.sha256(f.closed.encode()).hexdigest() if f.closed else ""
                rows.append(dict(owner=r["owner"], doc_id=r["doc_id"], n_a=f.n_a, n_b=f.n_b, n_groups=f.n_groups, n_links=f.n_links,
                                 groups_sha256=sha, seams=f.seams))
            yield pa.RecordBatch.from_pylist(rows, schema=shape)

    return fragments.mapInArrow(work, schema)


def _scores(_key, left: pa.Table, right: pa.Table) -> pa.Table:
    """Links with the highest count of their A id, and sums of counts, of the units of one block."""
    out = []
    pair, total, best = (right.column(c).to_numpy() for c in ("pair", "docs", "best"))
    order = np.argsort(pair, kind="stable")
    total, best = total[order], best[order].astype(np.int64)
    for row in left.to_pylist():
        lengths, groups, times, sizes, place = _unpack(row["data"], 5)
        ends = np.concatenate([[0], np.cumsum(sizes)])
        of_group = [np.diff(np.concatenate([[0], np.cumsum(x[place])])[ends]) for x in (total, best)]
        bounds = np.concatenate([[0], np.cumsum(lengths)])
        sums = [np.diff(np.concatenate([[0], np.cumsum(times * x[groups])])[bounds]).tolist() for x in of_group]
        for unit, count_sum, n_best in zip(row["units"], *sums, strict=True):
            out.append({k: unit[k] for k in ("owner", "doc_id", "n_a", "n_b", "n_groups", "n_links")} | dict(
                groups_sha256=unit["sha"], n_best=n_best, count_sum=count_sum))
    return pa.Table.from_pylist(out, schema=_SCORES)


_SCORES = pa.schema([
    ("owner", pa.int64()), ("doc_id", pa.int64()), ("n_a", pa.int64()), ("n_b", pa.int64()), ("n_groups", pa.int64()),
    ("n_links", pa.int64()), ("groups_sha256", pa.string()), ("n_best", pa.int64()), ("count_sum", pa.int64()),
])
_SCORES_SQL = "owner long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, n_best long, count_sum long"
COLUMNS = ("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


def _seam_pairs(ends: DataFrame) -> DataFrame:
    """Linked pairs of the groups that no block counted: owner, pair, n (how often)."""
    group = F.explode("seams").alias("g")
    ids = ends.select("owner", group).select("owner", *[
        F.transform(F.split(F.split_part("g", F.lit("|"), F.lit(i)), ","), lambda x: x.cast("long")).alias(c) for i, c in ((1, "a"), (2, "b"))])
    links = ids.select("owner", F.explode("a").alias("a"), "b").select("owner", "a", F.explode("b").alias("b"))
    return links.groupBy("owner", (F.shiftleft("a", 32) + F.col("b")).alias("pair")).agg(F.count("*").alias("n"))


def align_table(
    docs: DataFrame, paths: tuple[str, str] | None = None, range_bytes: int = RANGE_BYTES, block_bytes: int = BLOCK_BYTES
) -> DataFrame:
    """Groups and links of every row of ``docs`` (doc_id, text): doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256.

    Tokens of a blank and the text by A (a byte-level BPE file) and of the text by B (a sentencepiece model that adds the
    blank); special strings are plain text. Null and empty texts, and texts that either tokenizer changes, get zeros and an
    empty digest, and count for no pair. Rows are told apart whatever their ids: null and repeated ids are documents of
    their own, and equal texts count once each. An empty table gives an empty one; other columns are not read.
    """
    paths = paths or default_paths()
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    long = F.coalesce(F.octet_length("text"), F.lit(0)) > range_bytes
    nothing = F.lit(None)
    whole = slim.filter(~long).select(
        nothing.cast("long").alias("owner"), "doc_id", nothing.cast("int").alias("seq"), "text", F.lit(0).alias("low"), F.lit(0).alias("high"))
    numbered = durable(slim.filter(long).withColumn("owner", F.monotonically_increasing_id()))
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranges = numbered.mapInArrow(_chunker(range_bytes), CHUNKS).repartition(parts, "owner", "seq")
    work = _blocker(paths, block_bytes)
    blocks = durable(whole.mapInArrow(work, BLOCKS).unionByName(
        ranges.mapInArrow(work, BLOCKS).withColumn("block", -1 - F.col("block"))))

    units = blocks.select(F.explode("units").alias("u")).select("u.*").filter("owner IS NOT NULL")
    ends = durable(_end(_tree(durable(units.drop("pairs")))))
    seams = durable(_seam_pairs(ends))
    alive = ends.filter("n_groups > 0").select("owner")
    inside = units.select("owner", F.explode("pairs").alias("pair")).join(alive, "owner", "left_semi")
    of_long = inside.union(seams.select("owner", "pair")).distinct().select("pair", F.lit(1).alias("docs"))
    in_blocks = blocks.select("block", F.explode(F.arrays_zip("pairs", "docs_in")).alias("p")).select(
        "block", F.col("p.pairs").alias("pair"), F.col("p.docs_in").alias("docs"))
    counts = in_blocks.filter("docs > 0").select("pair", "docs").union(of_long).groupBy("pair").agg(F.sum("docs").alias("docs"))
    # One A id has at most as many pairs as B has ids.
    top = F.max("docs").over(Window.partitionBy(F.shiftright("pair", 32)))
    counts = durable(counts.select("pair", "docs", (F.col("docs") == top).cast("int").alias("best")))

    known = in_blocks.select(F.col("block").alias("of"), "pair").join(counts, "pair", "left").select(
        "of", "pair", F.coalesce("docs", F.lit(0)).alias("docs"), F.coalesce("best", F.lit(0)).alias("best"))
    slimmer = blocks.select("block", F.transform("units", lambda u: F.struct(*[
        u[c].alias(c) for c in ("owner", "doc_id", "n_a", "n_b", "n_groups", "n_links", "sha")])).alias("units"), "data")
    scored = durable(slimmer.groupBy("block").cogroup(known.groupBy("of")).applyInArrow(_scores, _SCORES_SQL))
    edges = seams.join(counts, "pair").groupBy("owner").agg(
        F.sum(F.col("n") * F.col("docs")).alias("e_sum"), F.sum(F.col("n") * F.col("best")).alias("e_best"))
    sums = scored.filter("owner IS NOT NULL").groupBy("owner").agg(F.sum("count_sum").alias("i_sum"), F.sum("n_best").alias("i_best"))
    of_ends = ends.drop("seams").join(sums, "owner", "left").join(edges, "owner", "left")
    zero, alive = F.lit(0).cast("long"), F.col("n_groups") > 0
    long_rows = of_ends.select(*[
        {"n_best": F.when(alive, F.coalesce("i_best", zero) + F.coalesce("e_best", zero)).otherwise(zero).alias("n_best"),
         "count_sum": F.when(alive, F.coalesce("i_sum", zero) + F.coalesce("e_sum", zero)).otherwise(zero).alias("count_sum")}.get(c, F.col(c))
        for c in COLUMNS])
    return scored.filter("owner IS NULL").select(*COLUMNS).unionByName(long_rows)
