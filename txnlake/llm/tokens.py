"""Token ids of whole texts with a public tokenizer, on the workers.

A text with one of the vocabulary's special strings is encoded as it is. Of the others: a byte-level BPE never
merges across a pre-token, and a run of white space that begins with a blank always begins a pre-token. So a text
may be cut before such runs, and the ids of the parts, put together, are the ids of the text. Parts repeat a lot,
so their ids are remembered; only new ones go through the tokenizer.
"""

from __future__ import annotations

import os
import re
from array import array
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc

from txnlake.llm.common import give_back

#: Parts that a task remembers in each of two generations; those met again outlive their generation.
REMEMBERED = 500_000
_LOADED: dict[str, "Encoder"] = {}
#: Closing characters, which are pre-tokens of their own after a letter.
CLOSERS = (",", ".")
#: Latin letters, and ASCII marks without the apostrophe (which begins contractions). In a body of these and single line
#: ends before one of them, each run is a pre-token, the first with the blank before it.
_LETTERS, _MARKS = r"A-Za-z\u00C0-\u00D6\u00D8-\u00F6\u00F8-\u024F", r"!-&(-/:-@\[-`{-~"
SIMPLE = re.compile(f"(?!\n)(?:[{_LETTERS}{_MARKS}]|\n(?=[{_LETTERS}{_MARKS}]))+")
RUNS = re.compile(f" ?[{_LETTERS}]+| ?[{_MARKS}]+|\n")
#: Bytes of text that are worked on at a time.
SLICE_BYTES = 8 << 20


def default_path() -> str:
    return public_tokenizers.path("byte_bpe_50k.json")


def byte_letters() -> dict[int, str]:
    """The letter that a byte-level vocabulary has for each byte: printable ones themselves, the others from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(0x100 + i) for i, b in enumerate(rest)}


def _bytes(ids: list[int]) -> bytes:
    return array("I", ids).tobytes()


class _Known(dict):
    """Ids of parts by the part without its leading blank; what isn't here is in the older generation, or new."""

    def __init__(self, owner: "Encoder", old: dict[str, bytes]):
        self.owner, self.old = owner, old

    def __missing__(self, p: str) -> bytes:
        ids = self.old.get(p)
        if ids is None:
            if p[-1:] in CLOSERS and p[-2:-1].isalpha():
                # "word," is "word" and "," whenever a letter stands before the closing character.
                ids = self[p[:-1]] + self.owner.closers[p[-1]]
            else:
                ids = self.owner.part(p)
        self[p] = ids
        return ids


class Encoder:
    """Ids of whole texts as little-endian unsigned 32-bit bytes; equal to the tokenizer's own, special strings included."""

    def __init__(self, path: str):
        os.environ.setdefault("RAYON_NUM_THREADS", "1")
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.letters = byte_letters()
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.closers = {c: self.whole(c) for c in CLOSERS}
        self.known = _Known(self, {})
        #: Ids of runs that come without a blank, or are marks.
        self.bare: dict[str, bytes] = {}

    def whole(self, text: str) -> bytes:
        return _bytes(self.tokenizer.encode(text, add_special_tokens=False).ids)

    def run(self, run: str) -> bytes:
        """Ids of one pre-token, which goes to the merges at once."""
        letters = run.encode().decode("latin-1").translate(self.letters)
        return _bytes([t.id for t in self.model.tokenize(letters)])

    def part(self, body: str) -> bytes:
        """Ids of a blank and ``body``."""
        if not SIMPLE.fullmatch(body):
            return self.whole(" " + body)
        runs = RUNS.findall(" " + body)
        if len(runs) == 1:
            return self.run(runs[0])
        bare = self.bare
        if len(bare) > REMEMBERED // 4:
            bare.clear()
        out = []
        for r in runs:
            if r[0] == " " and r[1:].isalpha():
                out.append(self.known[r[1:]])
            else:
                ids = bare.get(r)
                if ids is None:
                    ids = bare[r] = self.run(r)
                out.append(ids)
        return b"".join(out)

    def cut(self, text: str) -> list[str]:
        """``text`` cut at the blanks that begin a run of white space; these blanks are left out."""
        pieces = text.split(" ")
        parts = [pieces[0]]
        for piece in pieces[1:]:
            # A blank at the very start begins a run; one after other white space doesn't.
            if parts[-1][-1:].isspace() or (not parts[-1] and len(parts) > 1):
                parts[-1] += " " + piece
            else:
                parts.append(piece)
        return parts

    def one(self, text: str) -> bytes:
        """Ids of a text with any white space."""
        if not text:
            return b""
        if any(s in text for s in self.special):
            return self.whole(text)
        head, *parts = self.cut(text)
        return (self.whole(head) if head else b"") + b"".join([self.part(p) for p in parts])

    def _slice(self, texts: pa.Array) -> Iterator[bytes]:
        pieces = pc.split_pattern(texts, " ")
        offsets = pieces.offsets.to_numpy()
        offsets = offsets - offsets[0]
        coded = pieces.flatten().dictionary_encode()
        codes, values = coded.indices.to_numpy().copy(), coded.dictionary.to_pylist()
        # Texts in which a blank may not begin its run, and those with special strings, are encoded on their own.
        odd = np.fromiter((v == "" or v[-1].isspace() for v in values), bool, len(values))
        alone = np.searchsorted(offsets, np.flatnonzero(odd[codes]), side="right") - 1
        alone = set(alone.tolist())
        for s in self.special:
            alone.update(np.flatnonzero(pc.match_substring(texts, s).to_numpy(zero_copy_only=False)).tolist())
        known = self.known
        table = [b"" if o else known[v] for v, o in zip(values, odd.tolist(), strict=True)]
        # The first piece of a text has no blank before it.
        heads, place = np.unique(codes[offsets[:-1]], return_inverse=True)
        codes[offsets[:-1]] = len(table) + place
        table += [self.whole(values[h]) if values[h] else b"" for h in heads.tolist()]
        lengths = np.fromiter(map(len, table), np.int32, len(table)) // 4
        stock = np.frombuffer(b"".join(table), dtype="<u4")
        del table
        starts = np.cumsum(lengths, dtype=np.int32) - lengths
        n = lengths[codes]
        ends = np.cumsum(n)
        # Where each id of the texts lies in the stock; a slice has far fewer than 2 ** 31 ids.
        at = np.repeat(starts[codes] - (ends - n).astype(np.int32), n)
        at += np.arange(len(at), dtype=np.int32)
        out = stock[at].tobytes()
        del at
        bounds = (4 * np.concatenate([[0], ends])[offsets]).tolist()
        for i, (a, b) in enumerate(zip(bounds, bounds[1:])):
            yield self.one(texts[i].as_py()) if i in alone else out[a:b]

    def encode(self, texts: pa.Array) -> Iterator[bytes]:
        """Ids of every text of a column of strings, in order; null is empty."""
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        sizes = np.cumsum(pc.binary_length(texts).to_numpy())
        at = 0
        while at < len(texts):
            done = sizes[at - 1] if at else 0
            end = max(at + 1, int(np.searchsorted(sizes, done + SLICE_BYTES)))
            if len(self.known) > REMEMBERED:
                full = dict(self.known)
                self.known = _Known(self, full)
            yield from self._slice(texts.slice(at, end - at))
            at = end

    def rest(self) -> None:
        """Forget all parts at the end of a task, as the next one loads an encoder of its own."""
        self.known.clear()
        self.known.old = {}
        self.bare.clear()


def encoder(path: str) -> Encoder:
    """The encoder of a task, loaded once."""
    if path not in _LOADED:
        give_back()
        _LOADED[path] = Encoder(path)
    return _LOADED[path]
