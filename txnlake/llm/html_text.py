"""Main text of web pages by templates deduced from pages of the same host.

Tokens are element starts and ends, told apart by their path, and texts of blocks with their path. A token's occurrence vector says how often each page
of the host has it; tokens with equal vectors are an equivalence class. Vectors are never written out: a class is
told by the XOR of hashes of (page, count), which adds up before any shuffle. A class is valid if it is frequent
enough and its tokens come in the same order on all of its pages. Paths of valid classes, nested by their
prefixes, are the host's template, and so are frequent texts; its slots hold what differs from page to page. The
slot with the mass of the unlinked text (names tell between nested ones) is the page's main text, without texts of
the template and what is nested in it under the names of menus, notices, comments and the like.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from txnlake.llm.common import q
from txnlake.plans.groups import durable

# Fixed values of HTML.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style textarea title iframe xmp noembed noframes".split())
BLOCK = set(
    "address article aside blockquote body br caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 head header hr html li main menu nav ol option p pre section summary table tbody td tfoot th thead title tr ul".split())
CLOSES_P = BLOCK - {"br", "caption", "option", "td", "th", "tr", "tbody", "thead", "tfoot"}
#: An open element of the value ends where one of the key starts, up to the nearest of the fences.
ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
FENCES = set("table ul ol dl div section article body select".split())

#: Elements that are never main text, and words of class, id or role that say so.
OTHER_ELEMENTS = set(
    "nav header footer aside form script style noscript template iframe object svg canvas button select textarea dialog menu head".split())
OTHER_NAMES = set(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion sidebar comment comments disqus replies cookie "
    "cookies consent gdpr notice notices alert newsletter subscribe subscription signup share sharing social related recommended "
    "breadcrumb breadcrumbs menu nav navbar navigation footer header masthead popup modal overlay toolbar widget pagination pager login "
    "search banner contentinfo complementary".split())
MAIN_NAMES = set("article main".split())
#: Elements whose names decide alone, whatever their classes say, but for these words.
FIRM, FIRM_WORDS = {"html", "body", "main", "article"}, {"comment", "comments", "ad", "ads", "advert", "related", "promo"}

#: A class of elements belongs to the template if it is on this share of its host's pages, and on two at least; a text
#: if it is on the second share of the pages that have its path. Layouts of few pages have templates so.
LAYOUT, SUPPORT = 0.01, 0.2
#: A slot is a container with this share of the unlinked text of the pages that have it; the second one counts for
#: containers on less than SUPPORT of the host's pages, which are layouts of few pages or only parts of some pages.
MASS, RARE_MASS = 0.7, 0.9
#: Texts belong to the template from this many pages on: two pages with a common text may be copies.
TEXT_PAGES = 3
CONTAINERS = set("body div section table tbody tr td center main article".split())
#: Copies of a host's template, so that pages of one host are worked on by many tasks.
SALT = 32

_TOKEN = re.compile(
    r"<!--.*?(?:-->|$)|<[!?][^>]*+(?:>|$)|<(/?)([a-zA-Z][^\s/>]*+)((?:=\s*+(?:\"[^\"]*+\"|'[^']*+')|[^>=]|=)*+)(?:>|$)", re.S)
_ATTRIBUTE = re.compile(r"([^\s\"'>/=]+)\s*(?:=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|[0-9]+")


def _names(attributes: str) -> tuple[str, set[str], bool]:
    """First class or role (numbers in it as 0), the words of class, id and role, and whether the element is hidden."""
    label, words, hidden = "", set(), False
    for m in _ATTRIBUTE.finditer(attributes):
        name, value = m[1].lower(), html.unescape(m[2] or m[3] or m[4] or "")
        if name == "hidden" or name == "aria-hidden" and value.lower() == "true" or name == "style" and re.search(r"display\s*:\s*none", value, re.I):
            hidden = True
        if name in ("class", "id", "role"):
            for item in value.split():
                # Ids, and numbers in classes, often belong to one page; paths are of the layout.
                if name != "id":
                    label = label or re.sub(r"[0-9]+", "0", re.sub(r"[/.#]", "_", item.lower()))
                if not item.lower().startswith(("has-", "no-", "with-")):
                    words.update(w.lower() for w in _WORD.findall(item))
    return label, words, hidden


class Page:
    """Paths of a page's elements in order, and its blocks: (path, is other, in a main element, text, linked characters)."""

    def __init__(self, source: str):
        self.tokens: list[str] = []
        self.blocks: list[tuple[str, bool, bool, str, int]] = []
        self.mains: set[str] = set()
        self._stack: list[tuple[str, str, bool, bool]] = [("", "", False, False)]  # name, path, other, main
        self._text: list[tuple[str, bool]] = []
        at = 0
        while True:
            m = _TOKEN.search(source, at)
            self._text.append((source[at:m.start() if m else len(source)], any(x[0] == "a" for x in self._stack[-4:])))
            if not m:
                break
            at = m.end()
            if not m[2]:
                continue
            name = m[2].lower()
            if name in BLOCK:
                self._end_block()
            if m[1]:
                self._close(name)
                continue
            self._open(name, m[3])
            if name in VOID or m[3].endswith("/") and name in ("path", "circle", "rect", "use"):
                self._stack.pop()
                self.tokens.pop()
            elif name in RAW:
                end = re.compile(f"</{re.escape(name)}", re.I).search(source, at)
                at = end.start() if end else len(source)
        self._end_block()

    def _end_block(self) -> None:
        if self._text:
            whole = " ".join(html.unescape("".join(t for t, _ in self._text)).split())
            if whole:
                linked = sum(len(" ".join(t.split())) for t, is_link in self._text if is_link)
                _, path, other, main = self._stack[-1]
                self.blocks.append((path, other, main, whole, linked))
            self._text = []

    def _open(self, name: str, attributes: str) -> None:
        if name in CLOSES_P:
            self._end_open({"p"}, FENCES)
        if name in ENDS:
            self._end_open(ENDS[name], FENCES - {name})
        label, words, hidden = _names(attributes)
        _, path, other, main = self._stack[-1]
        named = words & (FIRM_WORDS if name in FIRM else OTHER_NAMES)
        path = f"{path}/{name}" + (f".{label}" if label else "")
        other = other or name in OTHER_ELEMENTS or bool(named) or hidden and name not in ("html", "body")
        if not other and (name in MAIN_NAMES or "main" in words and name not in ("html", "body")):
            main = True
            self.mains.add(path)
        self._stack.append((name, path, other, main))
        self.tokens.append(path)

    def _end_open(self, names: set[str], fences: set[str]) -> None:
        for i in range(len(self._stack) - 1, 0, -1):
            if self._stack[i][0] in names:
                self._drop(i)
                return
            if self._stack[i][0] in fences:
                return

    def _close(self, name: str) -> None:
        for i in range(len(self._stack) - 1, 0, -1):
            if self._stack[i][0] == name:
                self._drop(i)
                return

    def _drop(self, to: int) -> None:
        if to < len(self._stack):
            self._end_block()
        self.tokens += ["/" + x[1] for x in reversed(self._stack[to:])]
        del self._stack[to:]


def text_token(path: str, text: str) -> str:
    """The token of a block: its path and a hash of its text."""
    return f"{path}#{xxhash.xxh3_64_hexdigest(text)}"


def main_text(page: Page, slots: list[str] | None, texts: list[str] | None) -> str:
    """Blocks of the page's slot, else all that aren't mostly links; without ``texts`` of the template and what has other names.

    Of nested slots the deepest with a main element's name counts, else the deepest. A page with more text of the
    template than of its own (without links) is a copy of others, and keeps it.
    """
    wanted = [b for b in page.blocks if not b[1]]
    shared = set(texts or ())
    own = [b for b in wanted if text_token(b[0], b[3]) not in shared] if shared else wanted
    unlinked = lambda blocks: sum(len(b[3]) - b[4] for b in blocks)
    if not own or 2 * unlinked(own) < unlinked(wanted):
        own = wanted
    held = {s: sum(len(b[3]) for b in own if b[0] == s or b[0].startswith(s + "/")) for s in slots or ()}
    # What holds little of the page is a slot of other layouts.
    fit = [s for s, n in held.items() if n and 2 * n >= max(held.values())]
    if fit:
        root = max(fit, key=lambda s: (s in page.mains, s.count("/"), held[s], s))
        return " ".join(b[3] for b in own if b[0] == root or b[0].startswith(root + "/"))
    # Without a template what is mostly links is a menu.
    return " ".join(b[3] for b in own if 2 * b[4] <= len(b[3]))


TOKENS = "page string, host string, token string, n long, first long, mass long, total long"


def _tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Tokens of pages; ``mass`` is the unlinked text in the element and all that is nested in it, ``total`` that of the page."""
    numbers = ("n", "first", "mass", "total")
    schema = pa.schema([*((c, pa.string()) for c in ("page", "host", "token")), *((c, pa.int64()) for c in numbers)])
    for batch in batches:
        rows = []
        for key, host, source in zip(*(batch.column(c).to_pylist() for c in ("page", "host", "html")), strict=True):
            page = Page(source or "")
            mass: Counter[str] = Counter()
            texts: Counter[str] = Counter()
            total = 0
            for path, other, _, text, linked in page.blocks:
                if not other:
                    texts[text_token(path, text)] += 1
                    total += len(text) - linked
                    while path:
                        mass[path] += len(text) - linked
                        path = path.rpartition("/")[0]
            first: dict[str, int] = {}
            for i, token in enumerate(page.tokens):
                first.setdefault(token, i)
            rows += [(key, host, t, n, first[t], mass[t], total) for t, n in Counter(page.tokens).items()]
            rows += [(key, host, t, n, None, 0, 0) for t, n in texts.items()]
        columns = list(zip(*rows, strict=True)) if rows else [[]] * len(schema)
        yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def templates(pages: DataFrame) -> DataFrame:
    """host, template (paths), slots (paths) and texts (tokens) of every host of ``pages`` (page, host, html).

    A slot is a container in the template with ``MASS`` of the unlinked text of the pages that have it, so each layout
    of a host has slots of its own. Equal pages of a host count once.
    """
    told = pages.select("host", "html", F.xxhash64("html").cast("string").alias("page"))
    tokens = durable(told.mapInArrow(_tokens, TOKENS).dropDuplicates(["host", "page", "token"]))
    by_token = tokens.groupBy("host", "token").agg(
        F.bit_xor(F.xxhash64("page", "n")).alias("vector"), F.count(F.lit(1)).alias("support"), F.sum("mass").alias("mass"), F.sum("total").alias("total"),
        F.first("first").isNull().alias("is_text"))
    by_token = by_token.filter(~F.col("is_text") | (F.col("support") >= TEXT_PAGES))
    sizes = told.select("host", "page").distinct().groupBy(F.col("host").alias("_host")).agg(F.count(F.lit(1)).alias("pages"))
    by_token = by_token.join(sizes, F.col("host").eqNullSafe(F.col("_host"))).drop("_host")
    by_token = durable(by_token)
    elements = by_token.filter(~F.col("is_text") & ((F.col("support") >= F.greatest(F.lit(2), F.col("pages") * LAYOUT)) | (F.col("pages") == 1)))
    paths = by_token.filter("not is_text").select(F.col("host").alias("_host"), F.col("token").alias("_token"), F.col("support").alias("having"))
    texts = by_token.filter("is_text").withColumn("path", F.substring_index("token", "#", 1))
    texts = texts.join(paths, F.col("host").eqNullSafe(F.col("_host")) & (F.col("path") == F.col("_token")), "left")
    texts = texts.filter(F.col("support") >= F.coalesce("having", "pages") * SUPPORT).select(by_token.columns)
    by_token = elements.unionByName(texts)
    # The order of a class's tokens on each of its pages; valid classes have one order. A text's place is told by its path.
    named = by_token.filter("not is_text").select(F.col("host").alias("_host"), F.col("token").alias("_token"), "vector", "support")
    placed = tokens.join(named, F.col("host").eqNullSafe(F.col("_host")) & (F.col("token") == F.col("_token")))
    orders = placed.groupBy("host", "vector", "support", "page").agg(
        F.xxhash64(F.transform(F.array_sort(F.collect_list(F.struct("first", "token"))), lambda x: x["token"])).alias("order"), F.count(F.lit(1)).alias("size"))
    classes = orders.groupBy(F.col("host").alias("_h"), F.col("vector").alias("_v"), F.col("support").alias("_s")).agg(
        (F.min("order") == F.max("order")).alias("ordered"), F.max("size").alias("size"))
    same = F.col("host").eqNullSafe(F.col("_h")) & (F.col("vector") == F.col("_v")) & (F.col("support") == F.col("_s"))
    valid = by_token.join(classes, same, "left").filter(~F.col("token").startswith("//") & (F.col("is_text") | F.col("ordered") & (F.col("size") > 1)))
    container = F.regexp_extract("token", r"/([^/.]*)[^/]*$", 1).isin(*CONTAINERS)
    is_slot = ~F.col("is_text") & container & (F.col("mass") > 0) & (
        F.col("mass") >= F.col("total") * F.when(F.col("support") >= F.col("pages") * SUPPORT, F.lit(MASS)).otherwise(F.lit(RARE_MASS)))
    # A host's frequent tokens are bounded by its layouts: at most 1 / LAYOUT times those of a mean page.
    listed = lambda c: F.array_sort(F.collect_list(F.when(c, F.col("token"))))
    return durable(valid.groupBy("host").agg(listed(~F.col("is_text")).alias("template"), listed(is_slot).alias("slots"), listed(F.col("is_text")).alias("texts")))


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = [main_text(Page(h or ""), s, t) for h, s, t in zip(*(batch.column(c).to_pylist() for c in ("html", "slots", "texts")), strict=True)]
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("page_id", "url")), pa.array(texts, pa.string())], names=["page_id", "url", "text"])


def main_texts(pages: DataFrame, key: str = "page_id") -> DataFrame:
    """page_id, url and main text of every row of ``pages`` (page_id, url, html; other columns are left out).

    Null and empty html give an empty text. Pages with a null url, or one without a host, share a host. A host with
    one page takes its template from that page alone. Unclosed, overlapping and cut-off markup is read as browsers
    do: a tag that doesn't end is dropped, and so is an unended comment or script. Repeated rows stay.
    """
    slim = pages.select(
        F.col(q(key)).cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"),
        F.lower(F.regexp_extract(F.coalesce(F.col("url").cast("string"), F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)).alias("host"))
    found = templates(slim.select("host", "html"))
    spread = found.select(F.col("host").alias("_host"), "slots", "texts", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))).alias("_part"))
    salted = slim.withColumn("_salt", F.pmod(F.xxhash64("page_id", "url"), F.lit(SALT)).cast("int"))
    joined = salted.join(spread, (F.col("host") == F.col("_host")) & (F.col("_salt") == F.col("_part")), "left")
    return joined.select("page_id", "url", "html", "slots", "texts").mapInArrow(_extract, "page_id long, url string, text string")


def page_table(pages: DataFrame) -> DataFrame:
    return main_texts(pages).select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"))
