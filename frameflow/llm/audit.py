"""How filters overlap: failures of each document as a mask, counts per mask, and a subset-zeta transform to the survivors of every set of filters."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from frameflow.llm.common import table

FILTERS = "ABCDE"
MIN_WORDS, MIN_DISTINCT, MAX_UPPER = 200, 50, 2
_MARKS, _UPPER = b"#$%&*|", bytes(range(65, 91))


def failures(text: str) -> int:
    """Bits of the filters that a text fails by itself: few words (A), few different ones (B), many capitals (C), marks (D)."""
    data = text.encode()
    words = data.split()
    short, same = len(words) < MIN_WORDS, 100 * len(set(words)) < MIN_DISTINCT * len(words)
    loud = 100 * (len(data) - len(data.translate(None, _UPPER))) > MAX_UPPER * len(text)
    return short | same << 1 | loud << 2 | (len(data.translate(None, _MARKS)) < len(data)) << 3


def _masked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        masks, digests = [], []
        for t in batch.column(2):
            text = t.as_py() or ""
            masks.append(failures(text))
            digests.append(hashlib.sha256(text.encode()).digest())
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(masks, pa.int32()), pa.array(digests, pa.binary())], names=["doc_id", "part", "mask", "digest"])


def mask_counts(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """docs (doc_id, source, text), labels (doc_id, quality, toxic) -> part, mask, n, good, toxic: documents of a part by the filters they fail.

    Texts stay where they are: a row of numbers and a SHA-256 goes on. Equal texts fail the same filters A to D, so copies are added up per text and part before
    they meet, and one of a million is one row; the least doc_id of a text is the one that doesn't fail E. Null ids come after all others and aren't copies
    of each other; a row that repeats an id isn't a copy of itself. Several labels of an id count as one that has what any of them has.
    """
    text = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("source", F.lit("")).alias("part"), "text")
    rows = text.mapInArrow(_masked, "doc_id bigint, part string, mask int, digest binary")
    marks = labels.where("doc_id IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(
        F.coalesce(F.max(F.col("quality") == 1), F.lit(False)).cast("long").alias("good"), F.coalesce(F.max(F.col("toxic") == 1), F.lit(False)).cast("long").alias("toxic")
    )
    known = rows.join(marks, "doc_id", "left").groupBy("doc_id", "digest", "mask", "part").agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.coalesce("good", F.lit(0))).alias("good"), F.sum(F.coalesce("toxic", F.lit(0))).alias("toxic")
    )
    order = F.struct(F.col("doc_id").isNull().alias("blank"), "doc_id")
    sums = ("n", "good", "toxic")
    per_part = known.groupBy("digest", "mask", "part").agg(*(F.sum(c).alias(c) for c in sums), F.min(F.struct(order.alias("id"), *sums)).alias("first"))
    least = F.min("first.id").over(Window.partitionBy("digest"))
    firsts = per_part.withColumn("holds", F.col("first.id").eqNullSafe(least))
    own = lambda c: F.when(~F.col("holds"), 0).when(F.col("first.id.blank"), F.col(c)).otherwise(F.col(f"first.{c}"))
    split = firsts.select("part", "mask", *(own(c).alias(f"own_{c}") for c in sums), *sums)
    each = F.explode(F.array(
        F.struct(F.col("mask").alias("m"), *(F.col(f"own_{c}").alias(c) for c in sums)),
        F.struct((F.col("mask") + 16).alias("m"), *((F.col(c) - F.col(f"own_{c}")).alias(c) for c in sums)),
    ))
    found = split.select("part", each.alias("e")).select("part", "e.*").where("n > 0")
    return found.groupBy("part", F.col("m").alias("mask")).agg(*(F.sum(c).alias(c) for c in sums))


def zeta(counts: np.ndarray) -> np.ndarray:
    """Over the last axis: the sum over all subsets of each mask, one filter at a time."""
    out = counts.copy()
    for bit in range(out.shape[-1].bit_length() - 1):
        halves = out.reshape(*out.shape[:-1], -1, 2, 1 << bit)
        halves[..., 1, :] += halves[..., 0, :]
    return out


_OUT = ["kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]


def _audited(filters: str):
    every = (1 << len(filters)) - 1
    orders = list(permutations(range(len(filters))))
    steps = [(no, k, x, sum(1 << y for y in order[:k])) for no, order in enumerate(orders) for k, x in enumerate(order)]
    step_filter, before = np.array([x for _, _, x, _ in steps]), np.array([p for *_, p in steps])
    after = before | 1 << step_filter
    names = ["".join(filters[x] for x in order) for order in orders]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, counts in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                table_ = np.zeros((3, every + 1), np.int64)
                for c in counts:
                    table_[:, c["mask"]] = c["n"], c["good"], c["toxic"]
                alive = zeta(table_)[:, ::-1]  # by the set of filters that all of them pass
                lost = alive[:, before] - alive[:, after]
                fails = alive[0, 0] - alive[0, 1 << step_filter]
                total = np.bincount(step_filter, lost[0].astype(float), minlength=len(filters))[step_filter].astype(np.int64)
                columns = [alive[0, after], lost[0], fails - lost[0], table_[0, 1 << step_filter], lost[1], lost[2], total]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([part] * len(steps)), pa.array([names[no] for no, *_ in steps]), pa.array([k + 1 for _, k, *_ in steps], pa.int32()), *map(pa.array, columns)],
                    names=["part", "filter_order", "step", *_OUT],
                )

    return run


def interactions(counts: DataFrame, filters: str = FILTERS) -> DataFrame:
    """counts (part, mask, n, good, toxic) -> a row per part, order of the filters and step: what is kept, removed there, and why.

    A part has at most as many counts as masks, so a row each. Survivors of every set of filters come from one subset-zeta transform; a step is the
    difference of two neighbouring sets. ``redundant`` fail the step's filter but were removed before, ``unique_fails`` fail it alone, ``shapley`` is what it removes over all orders.
    """
    grouped = counts.groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("counts"))
    return grouped.mapInArrow(_audited(filters), "part string, filter_order string, step int, " + ", ".join(f"{c} bigint" for c in _OUT))


def filter_audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """docs (doc_id, source, text), labels (doc_id, quality, toxic) -> the rows of ``interactions``. Null texts are empty, a null source is the empty part; no documents, no rows; other columns are ignored."""
    return interactions(mask_counts(docs, labels))


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


OP13_SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), l AS (
  SELECT doc_id, coalesce(max((quality = 1)::INT), 0) AS good, coalesce(max((toxic = 1)::INT), 0) AS toxic FROM labels GROUP BY doc_id
), m AS (
  SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic, (len(w) < 200)::INT + 2 * (100 * len(list_distinct(w)) < 50 * len(w))::INT
    + 4 * (100 * (length(text) - length(regexp_replace(text, '[A-Z]', '', 'g'))) > 2 * length(text))::INT + 8 * regexp_matches(text, '[#$%&*|]')::INT
    + 16 * (d.doc_id > min(d.doc_id) OVER (PARTITION BY text))::INT AS mask
  FROM d LEFT JOIN l ON l.doc_id = d.doc_id
), c AS (SELECT part, mask, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM m GROUP BY ALL),
f AS (SELECT unnest(range(5))::INT AS x),
o AS (
  SELECT [a.x, b.x, c.x, d.x, e.x] AS xs FROM f a, f b, f c, f d, f e WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5
), s AS (
  SELECT array_to_string(list_transform(xs, lambda x: 'ABCDE'[x + 1]), '') AS filter_order, k::INT AS step, 1 << xs[k] AS own,
    coalesce(list_sum(list_transform(xs[1 : k - 1], lambda x: 1 << x)), 0)::INT AS before FROM o, (SELECT unnest(range(1, 6)) AS k)
), r AS (
  SELECT part, filter_order, step, own, coalesce(sum(n) FILTER (mask & (own | before) = 0), 0)::BIGINT AS kept, coalesce(sum(n) FILTER (mask & own > 0 AND mask & before = 0), 0)::BIGINT AS removed,
    coalesce(sum(n) FILTER (mask & own > 0 AND mask & before > 0), 0)::BIGINT AS redundant, coalesce(sum(n) FILTER (mask = own), 0)::BIGINT AS unique_fails,
    coalesce(sum(good) FILTER (mask & own > 0 AND mask & before = 0), 0)::BIGINT AS good_lost, coalesce(sum(toxic) FILTER (mask & own > 0 AND mask & before = 0), 0)::BIGINT AS toxic_lost
  FROM c, s GROUP BY ALL
)
SELECT * EXCLUDE (own), sum(removed) OVER (PARTITION BY part, own)::BIGINT AS shapley FROM r
"""
