"""Aligned tokenizers, periodic runs and toxicity against brute force, and on odd tables."""

import collections
import functools
import hashlib
import random
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from txnlake.llm import align, runs, toxicity
from txnlake.llm import queries as llm

SCHEMA = "doc_id long, text string, lang string, owner string, seq int, block string, row long, fold int, toxic string, full string, n int, `a.b` string"


def table(spark, rows, parts=3):
    """Documents from (doc_id, text), with extra columns whose names the operators use themselves."""
    return spark.createDataFrame([(*r, "en", "o", 1, "b", 2, 1, "x", "f", 3, "ab") for r in rows], SCHEMA).repartition(parts)


ODD = [
    (None, None), (None, "x y"), (1, ""), (1, ""), (2, " "), (2, "Hello "), (3, "  lead\n two  blanks \n\n x  y "), (4, "a ▁ b"),
    (5, "<|endoftext|> <s> </s>"), (6, "日本語のテキスト " * 50), (7, "q" * 3000 + " end " + "é" * 2000), (8, "x y"), (8, "x y"),
    (9, "\n\nfoo\t bar"), (10, "word, " * 400), (11, "a ▁ " + "word, " * 400), (12, " \x00   z"), (-13, "the the the the the the the"),
]


def same(left, right):
    def key(r):
        return tuple((x is None, x if x is not None else 0) for x in r)

    assert sorted(map(tuple, left), key=key) == sorted(map(tuple, right), key=key)


# --- aligned tokenizers ------------------------------------------------------------------------


@functools.cache
def loaded_parts():
    return align.Parts(*align.default_paths())


def brute_alignment(rows):
    parts = loaded_parts()
    found, docs_with = [], collections.Counter()
    for _, text in rows:
        a = parts.a.encode(" " + (text or ""), add_special_tokens=False).ids
        b = parts.b.encode(text or "")
        want = (" " + (text or "")).encode()
        if not text or any(b"".join(names[i] for i in ids) != want for names, ids in ((parts.bytes_a, a), (parts.bytes_b, b))):
            found.append(None)
            continue
        ends = [np.cumsum([len(names[i]) for i in ids]).tolist() for names, ids in ((parts.bytes_a, a), (parts.bytes_b, b))]
        groups, left, right, shared = [], [], [], set(ends[0]) & set(ends[1])
        todo = iter(zip(b, ends[1]))
        for i, e in zip(a, ends[0]):
            left.append(i)
            if e in shared:
                for j, f in todo:
                    right.append(j)
                    if f == e:
                        break
                groups.append((left, right))
                left, right = [], []
        links = [(x, y) for left, right in groups for x in left for y in right]
        docs_with.update(set(links))
        found.append((len(a), len(b), groups, links))
    top = collections.Counter()
    for (x, _), n in docs_with.items():
        top[x] = max(top[x], n)
    for (doc_id, _), f in zip(rows, found):
        if f is None:
            yield (doc_id, 0, 0, 0, 0, 0, 0, "")
            continue
        n_a, n_b, groups, links = f
        said = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)
        yield (doc_id, n_a, n_b, len(groups), len(links), sum(docs_with[p] == top[p[0]] for p in links),
               sum(docs_with[p] for p in links), hashlib.sha256(said.encode()).hexdigest())


@pytest.mark.parametrize("range_bytes, block_bytes", [(65_536, 8 << 20), (64, 500), (7, 100)])
def test_alignment_of_odd_texts(spark, range_bytes, block_bytes):
    got = align.align_table(table(spark, ODD), range_bytes=range_bytes, block_bytes=block_bytes)
    assert tuple(got.columns) == align.COLUMNS
    same(got.collect(), list(brute_alignment(ODD)))


def test_alignment_of_documents(spark):
    sf = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    same(llm.QUERIES["op11_align_tokenizers"](spark, sf).collect(), list(brute_alignment(rows)))


def test_alignment_of_no_documents(spark):
    assert align.align_table(table(spark, [], 1)).collect() == []


FRAGMENTS = st.builds(
    lambda cut, p, s: align.Fragment(cut, *map(tuple, p), sa=tuple(s[0]) if cut else (), sb=tuple(s[1]) if cut else ()),
    st.booleans(), st.tuples(st.lists(st.integers(0, 9), max_size=2), st.lists(st.integers(0, 9), max_size=2)),
    st.tuples(st.lists(st.integers(0, 9), max_size=2), st.lists(st.integers(0, 9), max_size=2)),
)


@settings(max_examples=300, deadline=None)
@given(FRAGMENTS, FRAGMENTS, FRAGMENTS)
def test_fragments_are_a_monoid(f, g, h):
    left, right = align.compose(align.compose(f, g), h), align.compose(f, align.compose(g, h))
    assert left._replace(seams=sorted(left.seams)) == right._replace(seams=sorted(right.seams))
    assert align.compose(f, align.Fragment()) == f == align.compose(align.Fragment(), f)


@settings(max_examples=200, deadline=None)
@given(st.text("ab é　\n ", max_size=60), st.integers(1, 20))
def test_byte_ranges_cover_a_text_once(text, size):
    data, upto = (" " + text).encode(), 0
    for start, end, low, high in align.byte_ranges(text, size):
        assert start + low == upto and start <= upto < start + high <= end
        upto = start + high
    assert upto == len(data)


def test_long_runs_are_encoded_at_most_twice():
    text = "x" * 10_000 + " y " + "z" * 10_000
    assert sum(end - start for start, end, _, _ in align.byte_ranges(text, 64)) <= 2 * len(text) + 200


# --- periodic runs -----------------------------------------------------------------------------


def brute_runs(words):
    n, out = len(words), []
    for p in range(1, n // 4 + 1):
        i = 0
        while i + p < n:
            j = i
            while j + p < n and words[j] == words[j + p]:
                j += 1
            length = j + p - i
            smaller = any(all(words[x] == words[x + q] for x in range(i, j + p - q)) for q in range(1, p))
            if j > i and length >= max(6, 4 * p) and not smaller:
                out.append((i, length, p))
            i = max(j, i + 1)
    return sorted(out)


def brute_row(doc_id, text):
    words = (text or "").encode().split()
    n, h = len(words), zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    found = brute_runs(words)
    best = None
    for s, length, q in found:
        if best is None or length * best[2] > best[1] * q:
            best = (s, length, q)
    kept = [w for i, w in enumerate(words) if not any(s + q <= i < s + length for s, length, q in found)]
    start, length, period = best or (None, None, None)
    return (doc_id, len(found), start, length, period, 1000 * length // period if best else None,
            hashlib.sha256("".join(f"{s},{k},{q}\n" for s, k, q in found).encode()).hexdigest(), hashlib.sha256(b" ".join(kept)).hexdigest())


def periodic_words(r):
    n, letters = r.choice([0, 1, 5, 6, 7, 20, 50, 130, 260]), r.choice([1, 2, 2, 3, 5, 50])
    words = [r.randrange(letters) for _ in range(n)]
    for _ in range(r.randrange(3) if n else 0):
        a = r.randrange(n)
        p = 1 + r.randrange(max(1, (n - a) // 3))
        for i in range(a + p, min(n, a + r.randrange(3, 9) * p)):
            words[i] = words[i - p]
    return words


@pytest.mark.parametrize("seed", range(12))
def test_runs_of_random_words(seed):
    r = random.Random(seed)
    texts = [periodic_words(r) for _ in range(20)]
    found = runs.find_runs(np.array([w for t in texts for w in t], dtype=np.int64), np.array([len(t) for t in texts]))
    assert found == [brute_runs(t) for t in texts]


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 6), st.integers(0, 2**30))
def test_mismatches_are_exact(scale, seed):
    r = np.random.default_rng(seed)
    size = 2**scale
    blocks, windows = r.integers(0, 50, (3, size)), r.integers(0, 50, (3, 2 * size))
    want = [[int(((blocks[i] - windows[i, s:s + size]) ** 2).sum()) for s in range(size + 1)] for i in range(3)]
    assert runs.mismatches(blocks, windows).tolist() == want


def test_run_rows(spark):
    r = random.Random(5)
    rows = ODD + [(i, " \n".join(f"w{x}" for x in periodic_words(r))) for i in range(100, 220)]
    got = runs.run_table(table(spark, rows))
    assert got.columns == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    same(got.collect(), [brute_row(*x) for x in rows])


def test_runs_of_documents(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet").filter("length(text) < 900").select("doc_id", "text")
    want = [brute_row(*r) for r in docs.collect()]
    ids = {r[0] for r in want}
    same([r for r in llm.QUERIES["op12_word_runs"](spark, sf).collect() if r["doc_id"] in ids], want)


def test_runs_and_collapsed_texts_are_given(spark):
    rows = [(1, "a b " * 5 + "c c c c c c d"), (2, None), (3, "x y z")]
    got = {r["doc_id"]: r for r in runs.word_runs(table(spark, rows)).collect()}
    assert got[1]["runs"] == [[0, 10, 2], [10, 6, 1]] and got[1]["collapsed"] == "a b c d"
    assert (got[1]["start"], got[1]["length"], got[1]["period"], got[1]["exponent_milli"]) == (10, 6, 1, 6000)
    assert got[2]["n_runs"] == 0 and got[2]["start"] is None and got[2]["collapsed"] == "" and got[3]["collapsed"] == "x y z"
    assert runs.word_runs(table(spark, [], 1)).collect() == []


@pytest.mark.parametrize("words", [[0] * 60_000, [0, 1] * 30_000, [0] * 30_000 + [1] + [0] * 30_000])
def test_long_periodic_texts_take_few_steps(words):
    found = runs.find_runs(np.array(words), np.array([len(words)]))[0]
    assert len(found) == (2 if words[30_000] == 1 and words[1] == 0 else 1)


# --- toxicity ----------------------------------------------------------------------------------


def brute_evidence(counted, order):
    """The three models from {word: (n, t0, o0, t2, o2)}, by dictionaries."""
    top = collections.defaultdict(lambda: np.zeros(5))
    for w, c in counted.items():
        p = " " * (order - 1) + w + " "
        for k in range(len(w) + 1):
            top[p[k:k + order]] += c
    chain = [{g: c[0] for g, c in top.items()}]
    for _ in range(order - 1):
        chain.append(collections.Counter(g[1:] for g in chain[-1]))
    chain = chain[::-1]

    def discount(counts):
        ones, twos = sum(v == 1 for v in counts.values()), sum(v == 2 for v in counts.values())
        return ones / (ones + 2 * twos) if ones and twos else 0.5

    def discounted(counts, d, back):
        total, mass = collections.Counter(), collections.Counter()
        for g, v in counts.items():
            total[g[:-1]] += v
            mass[g[:-1]] += min(v, d)
        return {g: (max(v - d, 0) + mass[g[:-1]] * back(g)) / total[g[:-1]] if total[g[:-1]] else back(g) for g, v in counts.items()}

    d = discount(chain[0])
    shared = {g: (max(v - d, 0) + d) / sum(chain[0].values()) for g, v in chain[0].items()}
    for counts in chain[1:]:
        shared = discounted(counts, discount(counts), lambda g, s=shared: s[g[1:]])
    out = {}
    for name, (toxic, ordinary) in {"full": ((1, 3), (2, 4)), "of0": ((1,), (2,)), "of2": ((3,), (4,))}.items():
        p, q = (discounted({g: sum(c[i] for i in cols) for g, c in top.items()}, 0.9, shared.get) for cols in (toxic, ordinary))
        out[name] = {g: np.log(p[g] / q[g]) for g in top}
    return out


def test_evidence_against_dictionaries(spark):
    r = random.Random(2)
    counted = {}
    for _ in range(300):
        word = "".join(r.choice("abcdé") for _ in range(r.randrange(1, 7)))
        classes = [r.randrange(3) for _ in range(4)]
        counted[word] = np.array([sum(classes) + r.randrange(1, 3), *classes], dtype=float)
    rows = [(w, *map(int, c)) for w, c in counted.items()]
    words = spark.createDataFrame(rows, "word string, n long, t0 long, o0 long, t2 long, o2 long")
    got = {x["g"]: x for x in toxicity.evidence(toxicity._expressions(words, 4), 4).collect()}
    for name, logs in brute_evidence(counted, 4).items():
        assert max(abs((got[g][name] if g in got else 0.0) - v) for g, v in logs.items()) < 1e-9


def toxic_rows(n, seed=3):
    r = random.Random(seed)
    stock = ["".join(r.choice("abcdefgh") for _ in range(r.randrange(3, 8))) for _ in range(400)]
    docs, labels = [], []
    for i in range(n):
        words = [r.choice(stock) for _ in range(r.randrange(30, 90))]
        toxic = i % 4 == 0
        for _ in range(5 if toxic else 0):
            words[r.randrange(len(words))] = "zorx" + r.choice(["", "ish", "ing"])
        docs.append((i, " ".join(words)))
        labels.append((i, int(toxic), "extra"))
    return docs, labels


def label_table(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, toxic int, score string")


@pytest.fixture(scope="module")
def scored(spark):
    docs, labels = toxic_rows(400)
    odd = [(None, None), (None, "zorx"), (900, ""), (900, ""), (901, "1 2 3 !"), (902, "zorxing " * 20_000), (0, docs[0][1]), (1, docs[1][1])]
    odd_labels = [(None, 1, "e"), (900, None, "e"), (0, 1, "e"), (1, 0, "e")]
    return docs, labels, odd, odd_labels, toxicity.toxicity(table(spark, docs + odd), label_table(spark, labels + odd_labels)).collect()


def test_toxicity_on_held_out_rows(scored):
    docs, labels, odd, _, rows = scored
    assert len(rows) == len(docs) + len(odd) and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.7) for r in rows)
    assert all(r["held_out"] == (r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in rows)
    truth = {i: t for i, t, _ in labels}
    held = [(truth[r["doc_id"]], r["predicted"]) for r in rows if r["held_out"] and r["doc_id"] in truth]
    assert sum(t for t, _ in held) > 20
    assert sum(p for t, p in held if t) >= 0.95 * sum(t for t, _ in held) and sum(p for t, p in held if not t) <= 1


def test_toxicity_of_odd_rows(scored):
    rows = scored[-1]
    by = collections.defaultdict(list)
    for r in rows:
        by[r["doc_id"]].append(r)
    assert [r["predicted"] for r in by[900]] == [0, 0] and by[900][0]["score"] == by[901][0]["score"] and by[902][0]["predicted"] == 1
    assert all(len({x["score"] for x in by[i]}) == 1 for i in (0, 1))
    assert all(not r["held_out"] for r in by[None])


def test_labels_of_the_held_out_fold_change_nothing(spark):
    docs, labels = toxic_rows(120)
    turned = [(i, 1 - t if zlib.crc32(str(i).encode()) % 3 == 1 else t, "x") for i, t, _ in labels]
    got = [sorted(map(tuple, toxicity.toxicity(table(spark, docs), label_table(spark, x)).collect())) for x in (labels, turned)]
    assert all(a[:2] == b[:2] and abs(a[2] - b[2]) < 1e-9 for a, b in zip(*got, strict=True))


def test_toxicity_without_sending_anything(spark):
    docs, labels = toxic_rows(90)
    docs += [(None, None), (500, ""), (500, "zorx")]
    sent = toxicity.toxicity(table(spark, docs), label_table(spark, labels))
    joined = toxicity.toxicity(table(spark, docs), label_table(spark, labels), most_labels=0, most_expressions=0)

    def key(r):
        return (r["doc_id"] is None, r["doc_id"] or 0, r["score"])

    for a, b in zip(sorted(sent.collect(), key=key), sorted(joined.collect(), key=key), strict=True):
        assert a["doc_id"] == b["doc_id"] and abs(a["score"] - b["score"]) < 1e-6


def test_toxicity_without_classes_or_rows(spark):
    docs, labels = toxic_rows(20)
    none = toxicity.toxicity(table(spark, docs), label_table(spark, []))
    assert {r["score"] for r in none.collect()} == {0.5}
    clean = toxicity.toxicity(table(spark, docs), label_table(spark, [(i, 0, "x") for i, _ in docs]))
    assert {r["predicted"] for r in clean.collect()} == {0}
    assert toxicity.toxicity(table(spark, [], 1), label_table(spark, labels)).collect() == []


def test_toxicity_of_documents(spark):
    sf = "/root/testdata/sf0.1"
    truth = spark.read.parquet(f"{sf}/labels.parquet").select("doc_id", "toxic")
    rows = llm.QUERIES["op13_toxicity"](spark, sf).join(truth, "doc_id").filter("held_out").groupBy("toxic").agg(
        F.avg("predicted").alias("share"), F.sum("predicted").alias("n")).collect()
    found = {r["toxic"]: r for r in rows}
    assert found[1]["share"] > 0.88 and found[0]["share"] < 0.005
