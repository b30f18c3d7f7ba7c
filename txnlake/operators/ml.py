"""A learned category model: TF-IDF over one- and two-word terms, balanced logistic regression."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml import PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import (
    IDF, CountVectorizerModel, IndexToString, NGram, Normalizer, RegexTokenizer, SQLTransformer, StringIndexer,
)
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import SparseVector, VectorUDT
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from txnlake.functions import text
from txnlake.plans.groups import attach, dealt, durable

MAX_BROADCAST_LABELS = 100_000
#: Texts of a task, and words that are sent to all of them at most.
TEXTS_PER_TASK, MAX_SENT_WORDS = 2_000, 200_000
INNER = [
    "_text", "_words", "_counts", "_weighted", "_features", "_label", "_weight",
    "_raw", "_probability", "_prediction",
]


def merge_corrections(parsed: DataFrame, corrections: DataFrame) -> DataFrame:
    """Corrections win over parsed labels by ``id``; unmatched corrections are added.

    Without an ``id`` on both sides the tables are just put together.
    """
    left = parsed if "label_source" in parsed.columns else parsed.withColumn("label_source", F.lit("parsed"))
    right = corrections if "label_source" in corrections.columns else corrections.withColumn("label_source", F.lit("correction"))
    if "id" not in left.columns or "id" not in right.columns:
        return left.unionByName(right, allowMissingColumns=True)
    labels = [c for c in ("category", "subcategory") if c in right.columns]
    better = right.select(F.col("id").alias("_cid"), *[F.col(c).alias(f"_c_{c}") for c in labels])
    merged = left.join(better, left["id"] == better["_cid"], "left").withColumns(
        {c: F.coalesce(f"_c_{c}", F.col(c)) if c in left.columns else F.col(f"_c_{c}") for c in labels}
    ).drop("_cid", *[f"_c_{c}" for c in labels])
    extra = right.join(left.select("id"), "id", "left_anti")
    return merged.unionByName(extra, allowMissingColumns=True)


def labelled_text(df: DataFrame, text_columns: Sequence[str], target: str) -> DataFrame:
    """Rows with a label and some text, the text columns joined into ``_text``."""
    if target not in df.columns:
        raise ValueError(f"no such column: {target}")
    joined = df.withColumn("_text", text.combined([c for c in text_columns if c in df.columns]))
    return joined.filter(F.col(target).isNotNull() & (F.col("_text") != ""))


def _tally(ids: np.ndarray, place: np.ndarray, terms: int) -> tuple[np.ndarray, np.ndarray]:
    """Occurrences of each id below ``terms``, and the texts that hold it."""
    texts = np.unique(place.astype(np.int64) * terms + ids) % terms
    return np.bincount(ids, minlength=terms), np.bincount(texts, minlength=terms)


def _split(batch: pa.RecordBatch) -> tuple[pa.Array, np.ndarray]:
    """The words of texts that are words with one blank between, and the places of their texts."""
    lists = pc.split_pattern(batch.column(0), " ")
    return pc.list_flatten(lists), pc.list_parent_indices(lists).to_numpy()


def _word_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(term, occurrences, texts) of words."""
    for batch in batches:
        words, place = _split(batch)
        coded = words.dictionary_encode()
        n, texts = _tally(coded.indices.to_numpy(), place, len(coded.dictionary))
        yield pa.RecordBatch.from_arrays([coded.dictionary, pa.array(n), pa.array(texts)], ["term", "n", "texts"])


def _pair_counts(batches: Iterator[pa.RecordBatch], kept: list[str] | None) -> Iterator[pa.RecordBatch]:
    """The same of neighbouring words, both of ``kept`` (None: of all)."""
    chosen = None if kept is None else pa.array(kept, pa.string())
    for batch in batches:
        words, place = _split(batch)
        known = words.dictionary_encode().dictionary if chosen is None else chosen
        ids = pc.fill_null(pc.index_in(words, known), -1).to_numpy().astype(np.int64)
        both = (place[1:] == place[:-1]) & (ids[1:] >= 0) & (ids[:-1] >= 0)
        pairs, which = np.unique((ids[:-1] * len(known) + ids[1:])[both], return_inverse=True)
        if len(pairs):
            n, texts = _tally(which, place[1:][both], len(pairs))
            names = pc.binary_join_element_wise(known.take(pa.array(pairs // len(known))), known.take(pa.array(pairs % len(known))), " ")
            yield pa.RecordBatch.from_arrays([names, pa.array(n), pa.array(texts)], ["term", "n", "texts"])


def _vocabulary(tokens: DataFrame, features: int, min_docs: int) -> list[str]:
    """The terms found most often, of those that stand in enough texts; equal counts in the order of the terms.

    A pair is found no oftener than either of its words. If enough words are there, pairs of words that are rarer
    than the last of them are no candidates and aren't counted.
    """
    def counted(how) -> DataFrame:
        found = tokens.select("_words").filter("_words <> ''").mapInArrow(how, "term string, n long, texts long").groupBy("term")
        return found.agg(F.sum("n").alias("n"), F.sum("texts").alias("texts")).filter(F.col("texts") >= min_docs)

    words = counted(_word_counts).persist()
    try:
        top = words.orderBy(F.desc("n"), "term").limit(features).collect()
        kept = None
        if len(top) == features:
            often = words.filter(F.col("n") >= top[-1]["n"]).select("term").limit(MAX_SENT_WORDS + 1).collect()
            kept = [r["term"] for r in often] if len(often) <= MAX_SENT_WORDS else None
    finally:
        words.unpersist()
    pairs = counted(lambda batches: _pair_counts(batches, kept)).orderBy(F.desc("n"), "term").limit(features).collect()
    best = sorted([*top, *pairs], key=lambda r: (-r["n"], r["term"]))[:features]
    return [r["term"] for r in best]


def _words(tokenizer: RegexTokenizer, df: DataFrame) -> DataFrame:
    """Adds ``_words``: the words of ``_text`` with one blank between."""
    return tokenizer.transform(df).withColumn("_words", F.concat_ws(" ", "_one")).drop("_one")


def _counts(df: DataFrame, vocabulary: Sequence[str]) -> DataFrame:
    """Adds ``_counts``, how often each term stands in ``_words``: what the stages of terms give, without all other pairs."""
    size, ones, twos = len(vocabulary), {}, {}
    for i, term in enumerate(vocabulary):
        first, _, second = term.partition(" ")
        if second:
            twos.setdefault(first, {})[second] = i
        else:
            ones[first] = i
    none: dict[str, int] = {}

    def counts(words):
        listed = words.split(" ")
        found = Counter(map(ones.get, listed))
        found.update([twos.get(a, none).get(b) for a, b in zip(listed, listed[1:])])
        found.pop(None, None)
        return SparseVector(size, sorted(found.items()))

    counts = F.udf(counts, VectorUDT())
    return df.withColumn("_counts", counts("_words"))


def train_classifier(
    df: DataFrame, text_columns: Sequence[str], target: str = "category", features: int = 5000, min_docs: int = 2,
    iterations: int = 100,
) -> tuple[PipelineModel, dict[str, float]]:
    """(fitted model, {samples, labels}). Class weights are n / (classes · class size).

    Words are taken from the texts once; the counts of their terms are written, and all that is fitted reads those.
    Only the vocabulary (at most ``features`` terms), the class sizes and the coefficients pass
    through the driver.
    """
    if target not in df.columns:
        raise ValueError(f"no such column: {target}")
    needed = df.select(*dict.fromkeys([target, *[c for c in text_columns if c in df.columns]]))
    rows = labelled_text(dealt(needed, TEXTS_PER_TASK), text_columns, target)
    words = RegexTokenizer(inputCol="_text", outputCol="_one", pattern=r"(?U)\w\w+", gaps=False)
    tokens = durable(_words(words, rows.select(F.col(target).cast("string").alias("_target"), "_text")).drop("_text"))
    vocabulary = _vocabulary(tokens, features, min_docs)
    terms = [
        NGram(n=2, inputCol="_one", outputCol="_two"),
        SQLTransformer(statement="SELECT *, concat(_one, _two) AS _terms FROM __THIS__"),
        CountVectorizerModel.from_vocabulary(vocabulary, inputCol="_terms", outputCol="_counts"),
    ] if vocabulary else []
    sizes = tokens.groupBy("_target").agg(F.count("*").alias("_n")).persist()
    try:
        totals = sizes.agg(F.sum("_n").alias("n"), F.count("*").alias("k")).first()
        if not totals["n"] or not terms:
            raise ValueError("no labelled rows with text" if not totals["n"] else "no term is in enough texts")
        labels = StringIndexer(inputCol="_target", outputCol="_label", stringOrderType="alphabetAsc").fit(sizes)
        weights = sizes.select("_target", (F.lit(float(totals["n"])) / (totals["k"] * F.col("_n"))).alias("_weight"))
        # Category lists are short; a hint keeps a frequent label from becoming one large partition.
        side = F.broadcast(weights) if totals["k"] <= MAX_BROADCAST_LABELS else weights
        counted = _counts(labels.transform(attach(tokens, side, ["_target"])), vocabulary)
        counts = durable(counted.select("_counts", "_label", "_weight"))
    finally:
        sizes.unpersist()
    scale = IDF(inputCol="_counts", outputCol="_weighted").fit(counts)
    norm = Normalizer(inputCol="_weighted", outputCol="_features")
    regression = LogisticRegression(
        featuresCol="_features", labelCol="_label", weightCol="_weight", maxIter=iterations, regParam=1e-3,
        probabilityCol="_probability", rawPredictionCol="_raw", predictionCol="_prediction",
    ).fit(norm.transform(scale.transform(counts)))
    named = IndexToString(inputCol="_prediction", outputCol="predicted_category", labels=labels.labels)
    model = PipelineModel([words, *terms, scale, norm, regression, named])
    return model, {"samples": float(totals["n"]), "labels": float(totals["k"])}


def confidence_label(probability: Column, high: float = 0.8, medium: float = 0.6) -> Column:
    return F.when(probability >= high, "high").when(probability >= medium, "medium").otherwise("low")


def predict_category(
    model: PipelineModel, df: DataFrame, text_columns: Sequence[str], default: str | None = None
) -> DataFrame:
    """Adds the predicted category, its probability and a confidence; blank text gets the default."""
    return _scored(model, dealt(df, TEXTS_PER_TASK), text_columns, default)


def _scored(model: PipelineModel, df: DataFrame, text_columns: Sequence[str], default: str | None = None) -> DataFrame:
    joined = df.withColumn("_text", text.combined([c for c in text_columns if c in df.columns]))
    tokenizer, _, _, counter, *rest = model.stages
    scored = PipelineModel(rest).transform(_counts(_words(tokenizer, joined), counter.vocabulary))
    blank = F.col("_text") == ""
    best = F.when(blank, 0.0).otherwise(F.array_max(vector_to_array("_probability")))
    return (
        scored.withColumns(
            {
                "predicted_category": F.when(blank, F.lit(default)).otherwise(F.col("predicted_category")),
                "predicted_probability": best, "predicted_confidence": confidence_label(best),
            }
        ).drop(*INNER)
    )


def misclassified(model: PipelineModel, df: DataFrame, text_columns: Sequence[str], target: str = "category") -> DataFrame:
    """Labelled rows whose prediction differs from the label."""
    rows = labelled_text(dealt(df, TEXTS_PER_TASK), text_columns, target).drop("_text")
    scored = _scored(model, rows, text_columns)
    # A filter on the prediction would be pushed below the model, which would then run once more for each place where the
    # filter names a step of it. What a generator gives can't be pushed.
    given = ["predicted_category", "predicted_probability", "predicted_confidence"]
    once = scored.select(*[c for c in scored.columns if c not in given], F.inline(F.array(F.struct(*given))))
    return once.filter(F.col(target).cast("string") != F.col("predicted_category"))


def retrain(
    parsed: DataFrame, corrections: DataFrame | None, path: str, text_columns: Sequence[str], target: str = "category"
) -> dict[str, float]:
    """Merge corrections, train, and save the model under ``path``."""
    merged = parsed if corrections is None else merge_corrections(parsed, corrections)
    model, stats = train_classifier(merged, text_columns, target)
    model.write().overwrite().save(path)
    return stats
