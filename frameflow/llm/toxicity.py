"""Toxicity: a logistic classifier over words, trained with a penalty on score changes under identity swaps."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from frameflow.llm.common import LOWER_ALNUM, kept_columns, table

BUCKETS = 1 << 18
#: The classifier is fitted on at most so many labelled rows, those first by a hash of their doc_id.
MAX_TRAIN_ROWS = 8_000
#: A word is a feature if its share differs between the classes by so many standard errors, and so many rows hold it.
MIN_Z, MIN_ROWS = 4.0, 5
L2, COUNTERFACTUAL, STEPS, RATE = 1e-4, 1.0, 300, 0.1
#: Groups of identity terms; a term is swapped for the next of its group.
IDENTITY = (
    ("woman", "man"), ("women", "men"), ("female", "male"), ("girl", "boy"), ("girls", "boys"),
    ("muslim", "christian", "jewish", "hindu", "buddhist", "atheist"), ("muslims", "christians", "jews", "hindus", "buddhists", "atheists"),
    ("black", "white", "asian", "latino", "arab"), ("african", "european", "american"), ("gay", "straight", "lesbian", "bisexual"),
    ("transgender", "cisgender"), ("immigrant", "citizen"), ("immigrants", "citizens"), ("disabled", "blind", "deaf"), ("old", "young"),
    ("frau", "mann"), ("frauen", "männer"), ("femme", "homme"), ("femmes", "hommes"), ("mujer", "hombre"), ("mujeres", "hombres"),
)
_SWAP = {term.encode(): group[(i + 1) % len(group)].encode() for group in IDENTITY for i, term in enumerate(group)}


def word_set(text: str | None) -> set[bytes]:
    return set(text.encode().translate(LOWER_ALNUM).split()) if text else set()


def _buckets(words: set[bytes]) -> list[int]:
    return sorted({crc32(w) & (BUCKETS - 1) for w in words})


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(toxic, x, y): the feature buckets of a text, and those of the text with identity terms swapped, null where it has none."""
    for batch in batches:
        xs, ys = [], []
        for text in batch.column(1):
            own = word_set(text.as_py())
            xs.append(_buckets(own))
            ys.append(_buckets({_SWAP.get(w, w) for w in own}) if not own.isdisjoint(_SWAP) else None)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(xs, pa.list_(pa.int32())), pa.array(ys, pa.list_(pa.int32()))], names=["toxic", "x", "y"])


def fit(rows: list[tuple[int, list[int], list[int] | None]]) -> dict[int, float]:
    """Weights by bucket, the intercept at -1.

    The loss is the mean log loss, plus COUNTERFACTUAL times the mean squared change of the logit between a text and its identity swap,
    plus L2. Identity terms are always features, so that the penalty decides on them. No rows, or one class: an intercept alone.
    """
    labels = np.array([r[0] for r in rows], np.float64)
    n, pos = len(rows), float(labels.sum())
    if n == 0:
        return {-1: 0.0}
    prior = math.log((pos + 0.5) / (n - pos + 0.5))
    if pos in (0.0, float(n)):
        return {-1: prior}
    cols = np.concatenate([np.asarray(r[1], np.int64) for r in rows])
    own = np.repeat(np.arange(n), [len(r[1]) for r in rows])
    held, held_pos = np.bincount(cols, minlength=BUCKETS), np.bincount(cols, labels[own], minlength=BUCKETS)
    p1, p0, p = held_pos / pos, (held - held_pos) / (n - pos), held / n
    z = np.abs(p1 - p0) / np.sqrt(np.maximum(p * (1 - p), 1 / n) * (1 / pos + 1 / (n - pos)))
    use = (z >= MIN_Z) & (held >= MIN_ROWS)
    use[[crc32(t) & (BUCKETS - 1) for t in _SWAP]] = True
    at = np.cumsum(use) - 1

    def matrix(lists: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
        r = np.repeat(np.arange(len(lists)), [len(x) for x in lists])
        c = np.concatenate([np.asarray(x, np.int64) for x in lists]) if lists else np.empty(0, np.int64)
        keep = use[c]
        return r[keep], at[c[keep]]

    d = int(use.sum())
    row, col = matrix([r[1] for r in rows])
    pairs = [r for r in rows if r[2] is not None]
    (ra, ca), (rb, cb) = matrix([r[1] for r in pairs]), matrix([r[2] for r in pairs])
    rs, cs = np.concatenate([ra, rb]), np.concatenate([ca, cb])
    sign = np.concatenate([np.ones(len(ra)), -np.ones(len(rb))])
    w, m, v = np.zeros(d + 1), np.zeros(d + 1), np.zeros(d + 1)
    w[d] = prior
    for step in range(1, STEPS + 1):
        score = w[d] + np.bincount(row, w[col], minlength=n)
        error = (1 / (1 + np.exp(-np.clip(score, -30, 30))) - labels) / n
        grad = np.append(np.bincount(col, error[row], minlength=d) + 2 * L2 * w[:d], error.sum())
        if pairs:
            change = np.bincount(rs, sign * w[cs], minlength=len(pairs))
            grad[:d] += 2 * COUNTERFACTUAL / len(pairs) * np.bincount(cs, sign * change[rs], minlength=d)
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad * grad
        w -= RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return {int(b): float(w[at[b]]) for b in np.flatnonzero(use)} | {-1: float(w[d])}


def held_out(doc_id):
    return F.crc32(doc_id.cast("string")) % 5 == 0


def train(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_TRAIN_ROWS) -> dict[int, float]:
    """Fit on at most max_rows labelled documents that are not held out. Only their feature buckets reach the driver."""
    some = (
        labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & ~held_out(F.col("doc_id"))).select("doc_id", F.col("toxic").cast("int").alias("toxic")).distinct()
        .orderBy(F.xxhash64("doc_id"), "doc_id", "toxic").limit(max_rows)
    )
    rows = docs.select("doc_id", "text").join(F.broadcast(some), "doc_id").select("toxic", "text").mapInArrow(_features, "toxic int, x array<int>, y array<int>")
    return fit(sorted((tuple(r) for r in rows.collect()), key=lambda r: (r[0], r[1])))


def _score(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights = dict(model.value)
        base = weights.pop(-1)
        for batch in batches:
            out = []
            for text in batch.column(1):
                s = base + sum(weights.get(b, 0.0) for b in _buckets(word_set(text.as_py())))
                out.append(1 / (1 + math.exp(-max(-30.0, min(30.0, s)))))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.float64()), *batch.columns[2:]], names=["doc_id", "score", *batch.schema.names[2:]])

    return run


def toxicity_scores(docs: DataFrame, model: dict[int, float], keep: Sequence[str] = ()) -> DataFrame:
    """docs (doc_id, text) -> doc_id, score (0 to 1) of each whole text, and the columns ``keep`` as they are.

    A text's words count once each, whatever its length; null and empty texts get the score of no words. Rows that repeat a
    doc_id are scored each; other columns are ignored; to keep one named score raises. The model has a weight for each of at most 2^18 buckets, so it is broadcast.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)
    kept = kept_columns(keep, ("score",))
    out = docs.select(F.col("doc_id").cast("long"), F.col("text").alias("__text"), *kept)
    return out.mapInArrow(_score(sent), T.StructType([out.schema["doc_id"], T.StructField("score", T.DoubleType()), *(out.schema[c] for c in kept)]))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scores = toxicity_scores(docs, train(docs, table(spark, sf_dir, "labels")))
    return scores.select("doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
