"""Toxicity by class-conditional Kneser-Ney models of words.

Two models, of toxic and of ordinary training documents, give the letters of a word one after another. Counts are of
documents that have a word, so that one text that says a word a thousand times counts once. A model discounts its counts
of five-letter expressions and gives the mass to a backoff that both share: an interpolated Kneser-Ney chain over all
documents, labelled or not, whose lower orders count continuations. What a class has hardly seen is thus judged by what
both have seen, and speaks for neither.

A word's evidence is the difference of its log-likelihoods. A document is judged by the shares of its words (so its
length is out) whose evidence exceeds that of its middle word by some nats: the middle word carries what the document's
language and subject say about the class. A logistic regression over these shares gives the score; the shares it is
fitted on are those of models that haven't seen the document's fold.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from txnlake.plans.groups import durable

#: Letters of an expression; the discount of a class; nats above the middle word.
ORDER, CLASS_DISCOUNT, STEPS = 5, 0.9, (1.0, 2.0, 3.0, 4.0)
#: Most that the middle word's evidence takes from the others': a text of nothing but toxic words is no language.
MOST_MIDDLE = 1.0
#: Shares are smoothed as if a document had so many more words, so many of them with evidence.
MORE_WORDS, MORE_HITS = 30.0, 0.3
THRESHOLD = 0.7
#: Labels, and expressions of the model, that are sent to all tasks; beyond these bounds both are joined.
BROADCAST_LABELS, BROADCAST_EXPRESSIONS = 2_000_000, 2_000_000
SLICE_BYTES = 8 << 20
CLASSES = ("t0", "o0", "t2", "o2")
#: Counts of the toxic and of the ordinary model: from both training folds, and from one of them for rows of the other.
MODELS = {"full": (("t0", "t2"), ("o0", "o2")), "of0": (("t0",), ("o0",)), "of2": (("t2",), ("o2",))}


def fold_of(doc_id: Column) -> Column:
    """0, 1 or 2; fold 1 is held out. A null id belongs to fold 0 and has no label."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 3, F.lit(0)).cast("int")


def _lists(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """Words (runs of letters in lower case): numbers of all words, where each text begins, and the distinct words."""
    plain = pc.replace_substring_regex(pc.utf8_lower(texts), pattern=r"\P{L}+", replacement=" ")
    pieces = pc.split_pattern(pc.utf8_trim(plain, characters=" "), " ")
    offsets = pieces.offsets.to_numpy() - pieces.offsets.to_numpy()[0]
    coded = pieces.flatten().dictionary_encode()
    return coded.indices.to_numpy(), offsets, coded.dictionary.to_pylist()


def _slices(batch: pa.RecordBatch) -> Iterator[tuple[pa.RecordBatch, pa.Array]]:
    texts = pc.fill_null(batch.column("text").cast(pa.large_string()), "")
    sizes, at = np.cumsum(pc.binary_length(texts).to_numpy()), 0
    while at < len(texts):
        end = max(at + 1, int(np.searchsorted(sizes, (sizes[at - 1] if at else 0) + SLICE_BYTES)))
        yield batch.slice(at, end - at), texts.slice(at, end - at)
        at = end


_COUNTS = pa.schema([("word", pa.string()), ("n", pa.int64()), *((c, pa.int64()) for c in CLASSES)])


def _counter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each word of a slice the number of documents, and of those of each class and fold, that have it."""
    for batch in batches:
        for rows, texts in _slices(batch):
            codes, offsets, words = _lists(texts)
            counts = np.zeros((len(words), 5), dtype=np.int64)
            toxic, fold = rows.column("toxic").to_pylist(), rows.column("fold").to_pylist()
            for x, y, label, f in zip(offsets.tolist(), offsets.tolist()[1:], toxic, fold):
                own = np.unique(codes[x:y])
                counts[own, 0] += 1
                if label is not None and f != 1:
                    counts[own, 1 + f + (0 if label else 1)] += 1
            columns = [pa.array(words, pa.string()), *(pa.array(counts[:, i]) for i in range(5))]
            yield pa.RecordBatch.from_arrays(columns, schema=_COUNTS)


def word_counts(labelled: DataFrame) -> DataFrame:
    """Documents that have each word, of all and of each class and fold, from (text, toxic, fold)."""
    counted = labelled.select("text", "toxic", "fold").mapInArrow(_counter, "word string, n long, t0 long, o0 long, t2 long, o2 long")
    return counted.filter("word <> ''").groupBy("word").agg(*[F.sum(c).alias(c) for c in ("n", *CLASSES)])


def _expressions(words: DataFrame, order: int) -> DataFrame:
    """Counts of the expressions of ``order`` letters; a word has blanks before it and one behind."""
    padded = F.concat(F.lit(" " * (order - 1)), "word", F.lit(" "))
    spots = F.explode(F.sequence(F.lit(1), F.char_length("word") + 1)).alias("i")
    cut = words.select(padded.alias("p"), "n", *CLASSES, spots)
    return cut.groupBy(F.expr(f"substring(p, i, {order})").alias("g")).agg(*[F.sum(c).alias(c) for c in ("n", *CLASSES)])


def _interpolated(counts: DataFrame, count: str, discount: float, backoff: Column, order: int) -> Column:
    """Discounted share among the expressions with the same beginning, plus the discounted mass times ``backoff``."""
    # As many rows as there are letters that can follow.
    same = Window.partitionBy(F.substring("g", 1, order - 1))
    mass = F.sum(F.least(F.col(count).cast("double"), F.lit(discount))).over(same)
    return (F.greatest(F.col(count) - discount, F.lit(0.0)) + mass * backoff) / F.sum(count).over(same)


def evidence(counts: DataFrame, order: int = ORDER) -> DataFrame:
    """Log of toxic over ordinary probability of each expression's last letter: g, full, of0, of2."""
    counts = durable(counts)
    chain = [counts.select("g", "n")]
    for k in range(order - 1, 0, -1):
        chain.append(durable(chain[-1].groupBy(F.expr(f"substring(g, 2, {k})").alias("g")).agg(F.count("*").alias("n"))))
    numbers = [c.agg(
        F.lit(order - i).alias("k"), F.count_if(F.col("n") == 1).alias("ones"), F.count_if(F.col("n") == 2).alias("twos"),
        F.sum("n").alias("total"), F.count("*").alias("types")) for i, c in enumerate(chain)]
    stats = numbers[0]
    for row in numbers[1:]:
        stats = stats.union(row)
    stats = {r["k"]: r for r in stats.collect()}
    discounts = {k: r["ones"] / (r["ones"] + 2 * r["twos"]) if r["ones"] and r["twos"] else 0.5 for k, r in stats.items()}
    letters, total = stats[1]["types"] or 1, stats[1]["total"] or 1
    d = discounts[1]
    shared = chain[-1].select("g", ((F.greatest(F.col("n") - d, F.lit(0.0)) + d) / total).alias("p")) if letters else chain[-1]
    for k in range(2, order + 1):
        mine = counts if k == order else chain[order - k]
        lower = shared.select(F.col("g").alias("rest"), F.col("p").alias("back"))
        joined = mine.join(lower, F.expr(f"substring(g, 2, {k - 1})") == F.col("rest"))
        kept = mine.columns
        shared = joined.select(*kept, _interpolated(joined, "n", discounts[k], F.col("back"), k).alias("p"))
        shared = durable(shared if k == order else shared.select("g", "p"))

    def probability(columns: tuple[str, ...]) -> Column:
        count = sum((F.col(c) for c in columns), F.lit(0))
        same = Window.partitionBy(F.substring("g", 1, order - 1))
        total = F.sum(count).over(same)
        mass = F.sum(F.least(count.cast("double"), F.lit(CLASS_DISCOUNT))).over(same)
        return F.when(total > 0, (F.greatest(count - CLASS_DISCOUNT, F.lit(0.0)) + mass * F.col("p")) / total).otherwise(F.col("p"))

    logs = shared.select("g", *[F.ln(probability(t) / probability(o)).alias(m) for m, (t, o) in MODELS.items()])
    # An expression that both classes leave to the backoff says nothing.
    return logs.filter(" OR ".join(f"{m} <> 0" for m in MODELS))


def _hashes(points: np.ndarray, order: int) -> np.ndarray:
    """64-bit hashes of the expressions that begin at each code point."""
    n = len(points) - order + 1
    h = np.zeros(max(n, 0), dtype=np.uint64)
    for k in range(order if n > 0 else 0):
        h = (h ^ points[k:k + n]) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(31)
    return h


def _points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le"), dtype=np.uint32).astype(np.uint64)


def _word_evidence(words: list[str], keys: np.ndarray, logs: np.ndarray, order: int) -> np.ndarray:
    """Sums of the evidence of every word's expressions, one column for each model."""
    out = np.zeros((len(words), logs.shape[1]))
    if not words or not len(keys):
        return out
    lead = " " * (order - 1)
    h = _hashes(_points("".join([lead + w + " " for w in words])), order)
    n = np.fromiter(map(len, words), np.int64, len(words)) + 1
    begins = np.cumsum(n + order - 1) - (n + order - 1)
    stops = np.cumsum(n)
    mine = h[np.arange(stops[-1]) + np.repeat(begins - (stops - n), n)]
    at = np.minimum(np.searchsorted(keys, mine), len(keys) - 1)
    found = np.where((keys[at] == mine)[:, None], logs[at], 0.0)
    return np.add.reduceat(found, stops - n, axis=0)


def shares(logs: np.ndarray, times: np.ndarray) -> list[float]:
    """Features of a document from the evidence of its distinct words and how often it has them."""
    weight = 1.0 + np.log(times)
    total = float(weight.sum())
    if len(logs):
        order = np.argsort(logs, kind="stable")
        upto = np.cumsum(times[order])
        above = logs - min(float(logs[order][np.searchsorted(upto, upto[-1] / 2)]), MOST_MIDDLE)
        hits = [float(weight[above > s].sum()) for s in STEPS]
    else:
        hits = [0.0] * len(STEPS)
    return [float(np.log((MORE_HITS + h) / (MORE_WORDS + total))) for h in hits] + [float(np.log1p(total))]


_FEATURES = "doc_id long, fold int, full array<double>, crossed array<double>"
_FEATURES_ARROW = pa.schema([("doc_id", pa.int64()), ("fold", pa.int32()), ("full", pa.list_(pa.float64())), ("crossed", pa.list_(pa.float64()))])


def _crossed(fold: int) -> int:
    """The column of the model that hasn't seen a fold."""
    return list(MODELS).index({0: "of2", 2: "of0"}.get(fold, "full"))


def _scorer(model, order: int) -> Callable:
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, logs = model.value
        for batch in batches:
            for rows, texts in _slices(batch):
                codes, offsets, words = _lists(texts)
                found = _word_evidence(words, keys, logs, order)
                full, crossed, folds = [], [], rows.column("fold").to_pylist()
                for x, y, fold in zip(offsets.tolist(), offsets.tolist()[1:], folds):
                    own, times = np.unique(codes[x:y], return_counts=True)
                    if len(own) and words[own[0]] == "":
                        own, times = own[1:], times[1:]
                    full.append(shares(found[own, 0], times))
                    crossed.append(shares(found[own, _crossed(fold)], times) if fold != 1 else full[-1])
                yield pa.RecordBatch.from_arrays(
                    [rows.column("doc_id"), rows.column("fold"), pa.array(full, _FEATURES_ARROW.field(2).type), pa.array(crossed, _FEATURES_ARROW.field(3).type)],
                    schema=_FEATURES_ARROW)

    return work


_TIMES = pa.schema([("row", pa.int64()), ("word", pa.string()), ("times", pa.int64())])


def _times(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for rows, texts in _slices(batch):
            codes, offsets, words = _lists(texts)
            for row, x, y in zip(rows.column("row").to_pylist(), offsets.tolist(), offsets.tolist()[1:]):
                own, times = np.unique(codes[x:y], return_counts=True)
                mine = [words[i] for i in own.tolist()]
                yield pa.RecordBatch.from_arrays([pa.array([row] * len(own), pa.int64()), pa.array(mine, pa.string()), pa.array(times)], schema=_TIMES)


def _joined_features(docs: DataFrame, model: DataFrame, order: int) -> DataFrame:
    """The features without sending the model to the tasks: every distinct word's expressions are joined with it."""
    rows = durable(docs.withColumn("row", F.monotonically_increasing_id()))
    times = durable(rows.select("row", "text").mapInArrow(_times, "row long, word string, times long").filter("word <> ''"))
    words = times.select("word").distinct()
    padded = F.concat(F.lit(" " * (order - 1)), "word", F.lit(" "))
    spots = F.explode(F.sequence(F.lit(1), F.char_length("word") + 1)).alias("i")
    cut = words.select("word", padded.alias("p"), spots).select("word", F.expr(f"substring(p, i, {order})").alias("g"))
    logs = cut.join(model, "g", "left").groupBy("word").agg(*[F.coalesce(F.sum(m), F.lit(0.0)).alias(m) for m in MODELS])
    found = times.join(logs, "word").groupBy("row").agg(F.collect_list(F.struct("times", *MODELS)).alias("found"))
    full = rows.join(found, "row", "left").select("doc_id", "fold", "found")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                cells = r["found"] or []
                logs = np.array([[c[m] for m in MODELS] for c in cells], dtype=float).reshape(-1, len(MODELS))
                times = np.array([c["times"] for c in cells], dtype=np.int64)
                out = dict(doc_id=r["doc_id"], fold=r["fold"], full=shares(logs[:, 0], times), crossed=shares(logs[:, _crossed(r["fold"])], times))
                yield pa.RecordBatch.from_pylist([out], schema=_FEATURES_ARROW)

    return full.mapInArrow(work, _FEATURES)


def features(docs: DataFrame, model: DataFrame, order: int = ORDER, most: int = BROADCAST_EXPRESSIONS) -> DataFrame:
    """Features of (doc_id, fold, text) by the model of both folds, and by one that hasn't seen the row's fold."""
    model = durable(model)
    if model.count() > most:
        return _joined_features(docs, model, order)
    # At most ``most`` rows of a hash and three numbers.
    table = model.select("g", *MODELS).toArrow()
    points = _points("".join(table.column("g").to_pylist()))
    keys = _hashes(points, order)[::order] if len(points) else np.zeros(0, dtype=np.uint64)
    rank = np.argsort(keys, kind="stable")
    logs = np.column_stack([table.column(m).to_numpy() for m in MODELS]) if len(keys) else np.zeros((0, len(MODELS)))
    sent = docs.sparkSession.sparkContext.broadcast((keys[rank], logs[rank]))
    return docs.mapInArrow(_scorer(sent, order), _FEATURES)


def toxicity(docs: DataFrame, labels: DataFrame, most_labels: int = BROADCAST_LABELS, most_expressions: int = BROADCAST_EXPRESSIONS) -> DataFrame:
    """Score of every row of ``docs`` (doc_id, text): doc_id, held_out, score, predicted.

    ``labels`` (doc_id, toxic) are learned from for ids whose fold is not 1; of several labels of one id the largest counts,
    and a label holds for all rows of its id. Null ids and null labels are unlabelled. Null and empty texts have no words and
    get the score of a document without evidence. Without both classes in the training folds every row gets the share of
    toxic ones, 0.5 without any. Equal texts get equal scores; an empty table gives an empty one; other columns are not read.
    """
    known = labels.filter("doc_id IS NOT NULL AND toxic IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("of")).agg(
        F.max(F.col("toxic").cast("int")).alias("toxic"))
    known = durable(known)
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    slim = slim.withColumn("fold", fold_of(F.col("doc_id")))
    side = F.broadcast(known) if known.count() <= most_labels else known
    labelled = slim.join(side, F.col("doc_id") == F.col("of"), "left")
    model = evidence(_expressions(word_counts(labelled), ORDER))
    found = durable(features(slim.select("doc_id", "fold", "text"), model, ORDER, most_expressions))

    train = found.filter("fold <> 1").join(known, F.col("doc_id") == F.col("of")).select(
        F.col("toxic").cast("double").alias("label"), array_to_vector("crossed").alias("features"))
    train = durable(train.select("label", vector_to_array("features").alias("x")))
    n, toxic = train.agg(F.count("*"), F.coalesce(F.sum("label"), F.lit(0.0))).first()
    held = (F.col("fold") == 1).alias("held_out")
    if toxic in (0, n):
        score = F.lit((toxic + 0.5) / (n + 1))
        scored = found.select("doc_id", held, score.alias("score"))
    else:
        fitted = LogisticRegression(maxIter=100, regParam=1e-5).fit(train.select("label", array_to_vector("x").alias("features")))
        weights, bias = fitted.coefficients.toArray().tolist(), float(fitted.intercept)
        linear = sum((F.col("full")[i] * w for i, w in enumerate(weights)), F.lit(bias))
        scored = found.select("doc_id", held, (F.lit(1.0) / (F.lit(1.0) + F.exp(-linear))).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))
