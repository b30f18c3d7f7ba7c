"""Top-k search, page templates and quotation links against brute force, and on odd tables."""

import collections
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from txnlake.llm import html_text, quotes, topk

# --- top-k -------------------------------------------------------------------------------------


def brute_top(rows, k=5, step=50):
    usable = []
    for i, v in rows:
        if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v):
            usable.append((i, [math.floor(256 * x) for x in v]))
    queries = {}
    for i, v in sorted(usable):
        if i % step == 0:
            queries.setdefault(i, v)
    out = []
    for i, q in queries.items():
        scored = sorted((-sum(a * b for a, b in zip(q, v)), j) for j, v in usable if j != i)
        out += [(i, rank + 1, j, max(-(2**63), min(2**63 - 1, -s))) for rank, (s, j) in enumerate(scored[:k])]
    return sorted(out)


def vectors(seed, n=600, dims=8):
    r = random.Random(seed)
    rows = [(i, [r.choice([-1.0, -0.25, 0.0, 0.25, 0.5, 1.0]) for _ in range(dims)]) for i in range(n)]
    rows += [(1000 + i, [0.5] * dims) for i in range(120)]  # ties
    rows += [(50, [0.1] * dims), (7, rows[7][1]), (-50, [0.3] * dims), (3000, [0.0] * dims), (3001, [0.25] * (dims - 3)), (3050, [])]
    rows += [(None, [1.0] * dims), (4000, None), (4001, [None] * dims), (4050, [float("nan")] * dims), (4002, [float("inf")] + [0.0] * (dims - 1))]
    return rows


@pytest.mark.parametrize("block", [10_000, 64])
def test_top_k_equals_brute_force(spark, block, monkeypatch):
    monkeypatch.setattr(topk, "QUERIES", 7)
    rows = vectors(3)
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "vec_id long, embedding array<double>, block string, v int")
    got = topk.top_k(df, F.col("vec_id") % 50 == 0, block=block).collect()
    assert sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in got) == brute_top(rows)


class Counted:
    """An array that counts the rows taken from it."""

    def __init__(self, rows):
        self.rows, self.shape, self.taken = rows, rows.shape, 0

    def __getitem__(self, at):
        self.taken += len(at)
        return self.rows[at]


def test_walks_stop_early_and_are_exact():
    r = np.random.default_rng(1)
    block = np.floor(r.normal(size=(3_000, 4)) * 256)
    block[:8] = 4_000
    lists = topk.Lists(np.arange(3_000), block)
    lists.vectors = Counted(block)
    for q in (np.array([3.0, 1, 2, 1]), np.array([-5.0, 0, 2, 0]), np.zeros(4)):
        scores, ids = lists.best(q, 17, 5, -math.inf)
        want = sorted((-float(block[i] @ q), i) for i in range(3_000) if i != 17)[:5]
        assert [(-s, i) for s, i in zip(scores, ids)] == want
    lists.vectors.taken = 0
    lists.best(np.array([3.0, 1, 2, 1]), None, 5, -math.inf)
    assert 5 <= lists.vectors.taken < 600


def test_large_numbers_and_empty_tables(spark):
    rows = [(0, [1e30, 2.0]), (1, [1e30, 1.0]), (2, [-1e30, 0.0]), (3, [2.0**40, 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = topk.top_k(df, F.col("vec_id") % 50 == 0).collect()
    assert sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in got) == brute_top(rows)
    assert topk.top_k(df.limit(0), F.col("vec_id") % 50 == 0).count() == 0
    assert topk.top_k(df.filter("vec_id = 0"), F.col("vec_id") % 50 == 0).count() == 0


# --- pages -------------------------------------------------------------------------------------

LAYOUT = (
    '<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style><script>if (a < b) "</p>";</script></head><body class="has-sidebar">'
    '<header><h1>Site</h1></header><nav><ul><li><a href="/a">Home</a></li></ul></nav><div class="cookie-notice">We use cookies</div>'
    '{body}<aside>More</aside><section id="comments"><p>Nice post</p><article class="comment">Me too</article></section>'
    '<form><label>Mail</label><input name="x"><button>Send</button></form><footer>&copy; us</footer></body></html>'
)


def extract(spark, pages):
    df = spark.createDataFrame([(i, u, h, "x", "y") for i, (u, h) in enumerate(pages)], "page_id long, url string, html string, host string, text string")
    return [r["text"] for r in html_text.main_texts(df).orderBy("page_id").collect()]


CASES = [
    ("<article><h1>A &amp; B</h1><p>one<b>two</b>\n three<br>four</p><p>five</article>", "A & B onetwo three four five"),
    ("<article><p>x<div class='ad'>Buy</div>y<p>z <!-- hidden <p>no</p> -->w</article>", "x y z w"),
    ("<main><div><p>1 &lt; 2 and a < b</p><ul><li>i<li>j</ul></div></main>", "1 < 2 and a < b i j"),
    ("<article><p><b>open<br><p>next&nbsp;one</p></article>", "open next one"),
    ("<article><table><tr><td>c1<td>c2<tr><td>d</table><textarea>no</textarea><noscript>no</noscript></article>", "c1 c2 d"),
    ("<article><p hidden>no</p><p style='display: none'>no</p><p title='a>b'>yes</p></article>", "yes"),
    ("<article><div class='share social-links'>Share</div><div role='navigation'>menu</div>text</article>", "text"),
    ("<article>" + "<p>same line</p>" * 3 + "</article>", "same line same line same line"),
]


def test_main_text_of_layouts(spark):
    pages = [(f"https://a.example.org/{i}", LAYOUT.format(body=b)) for i, (b, _) in enumerate(CASES)]
    assert extract(spark, pages) == [t for _, t in CASES]


def test_template_finds_the_slot_without_named_elements(spark):
    body = "<div class='wrap'><div class='story'><h2>Head {i}</h2><p>Body of page {i} with words enough to weigh.</p></div><div class='links'><a href='x'>Other {i} and other pages</a></div></div>"
    pages = [(f"https://b.example.org/{i}", LAYOUT.format(body=body.format(i=i))) for i in range(6)]
    assert extract(spark, pages) == [f"Head {i} Body of page {i} with words enough to weigh." for i in range(6)]


def test_template_decides_where_names_are(spark):
    notice = "<div class='box'><p>Subscribers read more of this every day.</p></div>"
    body = "<main><h1>Head {i}</h1><p>Body of page {i} with words enough to weigh.</p>" + notice + "<article class='teaser'>See {i}</article></main>"
    pages = [(f"https://d.example.org/{i}", LAYOUT.format(body=body.format(i=i))) for i in range(6)]
    assert extract(spark, pages) == [f"Head {i} Body of page {i} with words enough to weigh. See {i}" for i in range(6)]
    # Pages whose text isn't in the named element.
    body = "<div class='story'><p>Body of page {i} with words enough to weigh.</p></div><article>Top {i}</article>"
    pages = [(f"https://e.example.org/{i}", LAYOUT.format(body=body.format(i=i))) for i in range(6)]
    assert extract(spark, pages) == [f"Body of page {i} with words enough to weigh." for i in range(6)]


def test_templates_of_layouts_within_a_host(spark):
    story = "<div id='post-{i}' class='entry-{i}'><p>Body of page {i} with words enough to weigh.</p></div><div id='box-{i}'><p>Mark {i}</p></div>"
    rare = "<section class='column'><p>Column of page {i} with words enough to weigh.</p><p>Columns come out on each Monday.</p></section><div class='tail'>Tail</div>"
    pages = [(f"https://f.example.org/{i}", LAYOUT.format(body=(story if i % 10 else rare).format(i=i))) for i in range(40)]
    assert extract(spark, pages) == [f"{'Body' if i % 10 else 'Column'} of page {i} with words enough to weigh." for i in range(40)]
    rows = spark.createDataFrame([("h", h) for _, h in pages], "host string, html string")
    found = html_text.templates(rows).first()
    assert len(found["template"]) < 40 and any(x.endswith("/div.entry-0") for x in found["slots"])


def test_template_classes(spark):
    pages = [(str(i), "h", LAYOUT.format(body="<article>" + "<p>x</p>" * i + "</article>")) for i in range(1, 6)]
    found = html_text.templates(spark.createDataFrame(pages, "page string, host string, html string")).first()
    assert "/html.has-sidebar" not in found["template"] and any(t.endswith("/article") for t in found["template"])
    assert any(t.endswith("/nav/ul/li/a") for t in found["template"])


def test_odd_pages(spark):
    whole = LAYOUT.format(body="<article><h1>Title</h1><p>Some text</p></article>")
    cut = [whole[:n] for n in range(0, len(whole), 7)]
    pages = [(None, None), ("nonsense", ""), ("http://x.org", "plain text &amp; more"), ("http://x.org/", "<"), ("http://y.org", "<p>" * 3_000 + "deep"), *[(f"https://c.org/{i}", h) for i, h in enumerate(cut)]]
    got = extract(spark, pages)
    assert len(got) == len(pages) and got[:5] == ["", "", "plain text & more", "<", "deep"]
    assert got[-1].startswith("Title Some text") and None not in got
    long = "<article>" + "".join(f"<p>w{i}</p>" for i in range(20_000)) + "</article>"
    assert extract(spark, [("http://z.org/", long)] * 2) == [" ".join(f"w{i}" for i in range(20_000))] * 2
    df = spark.createDataFrame([], "page_id long, url string, html string")
    assert html_text.page_table(df).count() == 0


# --- quotations --------------------------------------------------------------------------------


def brute_links(messages):
    """turn -> answered turn and whether a quotation says so, for one conversation of distinct turns."""
    def level(line):
        n = 0
        while True:
            bare = line.lstrip(" \t")
            if len(line) - len(bare) > 3 or not bare.startswith(">"):
                return n, line
            n, line = n + 1, bare[1:]

    norm = lambda line: " ".join(line.lower().split())
    own, out, last = {}, {}, None
    for turn, text in messages:
        lines = [level(x) for x in text.split("\n")]
        votes = collections.Counter()
        for n, body in {(n, norm(b)) for n, b in lines if n and norm(b)}:
            sources = [t for t in own if body in own[t]]
            if sources:
                votes[n, max(sources)] += 1
        best = min(((n, -c, -t) for (n, t), c in votes.items()), default=None)
        out[turn] = (-best[2], True) if best else (last, False)
        own[turn] = {norm(b) for n, b in lines if not n and norm(b)}
        last = turn
    return out


def test_links_equal_brute_force(spark):
    r = random.Random(6)
    rows = []
    for conv in range(12):
        lines = []
        for turn in range(r.randrange(1, 12)):
            parts = [r.choice(["> ", ">", ">> ", " > > "]) + r.choice(lines).upper() for _ in range(r.randrange(3)) if lines]
            fresh = [f"line {r.randrange(30)}  of talk" for _ in range(r.randrange(1, 3))]
            rows.append((conv, turn, "u", "\n".join(parts + fresh)))
            lines += fresh
    df = spark.createDataFrame([(*x, 1, "c") for x in rows], "conv_id long, turn long, role string, text string, pos int, conv string")
    got = {(x["conv_id"], x["turn"]): x for x in quotes.link_quotations(df).collect()}
    assert len(got) == len(rows)
    for conv in range(12):
        want = brute_links([(t, x) for c, t, _, x in rows if c == conv])
        for turn, (answers, linked) in want.items():
            x = got[conv, turn]
            assert (x["answers"], x["linked"]) == (answers, linked) and ">" not in x["text"]
        mine = sorted((x for (c, _), x in got.items() if c == conv), key=lambda x: x["place"])
        assert [x["place"] for x in mine] == list(range(len(mine)))
        seen = set()
        for x in mine:  # in reply order every message follows what it answers
            assert x["answers"] is None or x["answers"] in seen
            seen.add(x["turn"])
        for x in mine:  # a branch is a chain: its first answer continues it
            eldest = min((t for t, (a, _) in want.items() if a == x["answers"]), default=None) if x["answers"] is not None else None
            assert (x["branch"] == x["turn"]) == (x["turn"] != eldest)


def test_nested_levels_and_odd_tables(spark):
    rows = [
        (1, 0, "user", "Hello there\nhow are  you?"), (1, 1, "assistant", "> how are you?\nFine\n\nAnd you?"),
        (1, 2, "user", "On Monday X wrote:\n> Fine\n>> how are you?\nGood"), (1, 3, "user", ">> HELLO there\nalso this"),
        (1, 4, "user", "no quotes"), (1, 4, "user", "no quotes"), (2, 0, "u", None), (2, None, "u", ""), (None, None, None, "x"), (None, 3, None, "> x"),
        (3, 0, "u", "\n".join(f"l{i}" for i in range(5_000))), (3, 1, "u", "\n".join(f"> l{i}" for i in range(5_000))),
    ]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = quotes.link_quotations(df).orderBy("conv_id", "place").collect()
    one = [(x["turn"], x["text"], x["level"], x["answers"], x["linked"], x["branch"]) for x in got if x["conv_id"] == 1]
    assert one == [
        (0, "Hello there\nhow are  you?", 0, None, False, 0), (1, "Fine\n\nAnd you?", 1, 0, True, 0), (2, "Good", 2, 1, True, 0),
        (3, "also this", 2, 0, True, 3), (4, "no quotes", 0, 3, False, 3), (4, "no quotes", 0, 4, False, 3)]
    assert len(got) == len(rows) and [x["n_quoted"] for x in got if x["conv_id"] == 3] == [0, 5_000]
    assert [(x["text"], x["linked"]) for x in got if x["conv_id"] is None] == [("x", False), ("", True)]
    assert quotes.link_quotations(df.limit(0)).count() == 0
