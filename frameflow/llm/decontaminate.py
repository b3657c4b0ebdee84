"""Benchmark decontamination with one Aho-Corasick automaton over normalised items."""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator, Sequence

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from frameflow.llm.common import LOWER_ALNUM, kept_columns, save, table

WINDOW = 10
#: An automaton is built of about so many windows at most, some 500 bytes each in Python; more items are split over several, each of which scans the texts.
AUTOMATON_WINDOWS = 250_000
_WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
_KINDS = {
    "doc_id": pa.int64(), "n_words": pa.int64(), "hit": pa.list_(pa.list_(pa.int64())), "items": pa.list_(pa.string()), "spans": pa.list_(pa.list_(pa.int64()))
}


def _schema() -> list[T.StructField]:
    ranges = T.ArrayType(T.ArrayType(T.LongType()))
    kinds = (T.LongType(), T.LongType(), ranges, T.ArrayType(T.StringType()), ranges)
    return [T.StructField(n, t) for n, t in zip(_KINDS, kinds, strict=True)]


def words(text: str | None) -> list[bytes]:
    """Runs of ASCII letters and digits and of non-ASCII characters, A-Z lower-cased, as UTF-8."""
    return text.encode().translate(LOWER_ALNUM).split() if text else []


def windows(items: list[tuple[object, str | None]], size: int = WINDOW) -> dict[bytes, tuple[int, set[str]]]:
    """Each distinct window: how many words it has, and the ids of the items that hold it."""
    found: dict[bytes, tuple[int, set[str]]] = {}
    for item, text in items:
        w = words(text)
        n = min(size, len(w))
        for i in range(len(w) - n + 1 if n else 0):
            ids = found.setdefault(b" ".join(w[i : i + n]), (n, set()))[1]
            if item is not None:
                ids.add(str(item))
    return found


def _merge(spans: list[tuple[int, int]]) -> list[list[int]]:
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return out


def _scan(patterns):
    """Columns after doc_id and text are handed through."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = ahocorasick.Automaton()
        for window, (n, ids) in patterns.value.items():
            automaton.add_word(f" {window.decode('latin-1')} ", (n, ids))
        if len(automaton):
            automaton.make_automaton()
        for batch in batches:
            rows: dict[str, list] = defaultdict(list)
            for doc, text in zip(batch.column(0), batch.column(1), strict=True):
                text = text.as_py()
                w = words(text)
                spans, items = [], set()
                if w and len(automaton):
                    line = b" %s " % b" ".join(w)
                    hits = list(automaton.iter(line.decode("latin-1")))
                    if hits:
                        blanks = np.flatnonzero(np.frombuffer(line, np.uint8) == 32)
                        ends = np.searchsorted(blanks, [e for e, _ in hits])
                        for end, (_, (n, ids)) in zip(ends.tolist(), hits, strict=True):
                            spans.append((end - n, end))
                            items |= ids
                spans = _merge(spans)
                rows["doc_id"].append(doc.as_py())
                rows["n_words"].append(len(w))
                rows["hit"].append(spans)
                rows["items"].append(sorted(items))
                at = [m.span() for m in _WORD.finditer(text)] if spans else []
                rows["spans"].append([[at[a][0], at[b - 1][1]] for a, b in spans])
            yield pa.RecordBatch.from_arrays(
                [*(pa.array(rows[k], t) for k, t in _KINDS.items()), *batch.columns[2:]], names=[*_KINDS, *batch.schema.names[2:]]
            )

    return run


def benchmark_hits(docs: DataFrame, benchmark: DataFrame, automaton_windows: int = AUTOMATON_WINDOWS, keep: Sequence[str] = ()) -> DataFrame:
    """docs (doc_id, text), benchmark (item_id, text) -> doc_id, n_words, hit (merged word ranges), items (sorted ids), spans (the ranges in code points of the original text), and the columns ``keep`` as they are.

    The windows of the benchmark are counted first; if they are more than ``automaton_windows``, items are dealt by hash to several automata, which are built and scanned one
    after another, and the rows of a document are joined again. Each automaton is broadcast and scans
    every text once, whole. Texts without words (null, empty) have no hits; an empty benchmark hits nothing. An item with a null
    id marks words but is not listed. Repeated items count once; repeated doc_ids keep a row each. To keep a column named like one of the others raises.
    """
    spark = docs.sparkSession
    n_words = F.regexp_count("text", F.lit(_WORD.pattern))
    size = benchmark.agg(F.coalesce(F.sum(F.when(n_words > 0, F.greatest(n_words - (WINDOW - 1), F.lit(1)))), F.lit(0))).first()[0]
    parts = -(-size // automaton_windows) or 1
    kept = kept_columns(keep, _KINDS)
    texts = docs.select(F.col("doc_id").cast("long"), F.col("text").alias("__text"), *kept)
    if parts == 1:
        found = windows([tuple(r) for r in benchmark.select("item_id", "text").collect()])
        return texts.mapInArrow(_scan(spark.sparkContext.broadcast(found)), T.StructType([*_schema(), *(texts.schema[c] for c in kept)]))
    # rows are told apart by their text as well, so that repeated doc_ids stay apart
    keyed = texts.select("doc_id", "__text", F.xxhash64("__text").alias("v"))
    out = None
    for part in range(parts):
        mine = benchmark.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(parts)) == part).select("item_id", "text")
        found = windows([tuple(r) for r in mine.collect()])
        one = save(keyed.mapInArrow(_scan(spark.sparkContext.broadcast(found)), T.StructType([*_schema(), keyed.schema["v"]])), f"hits-{part}")
        out = one if out is None else out.unionByName(one)
    whole = out.groupBy("doc_id", "v").agg(
        F.max("n_words").alias("n_words"), F.sort_array(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"),
        F.flatten(F.collect_list("hit")).alias("hit"), F.flatten(F.collect_list("spans")).alias("spans"), (F.count(F.lit(1)) / parts).cast("int").alias("copies"),
    )
    joined = lambda c: F.expr(
        f"aggregate(array_sort({c}), cast(array() as array<array<bigint>>), (acc, s) -> CASE WHEN size(acc) > 0 AND s[0] <= acc[size(acc) - 1][1] "
        "THEN concat(slice(acc, 1, size(acc) - 1), array(array(acc[size(acc) - 1][0], greatest(acc[size(acc) - 1][1], s[1])))) ELSE concat(acc, array(s)) END)"
    ).alias(c)
    whole = whole.select("doc_id", "v", "n_words", joined("hit"), "items", joined("spans"), F.explode(F.array_repeat(F.lit(1), F.col("copies")))).drop("col")
    if not kept:
        return whole.drop("v")
    back = whole.withColumnRenamed("doc_id", "__id").dropDuplicates(["__id", "v"])
    own = texts.withColumn("__v", F.xxhash64("__text"))
    return own.join(back, F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("__v") == F.col("v"))).select("doc_id", "n_words", "hit", "items", "spans", *kept)


def op5_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = benchmark_hits(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    n_hit = F.aggregate("hit", F.lit(0).cast("long"), lambda a, s: a + s[1] - s[0])
    return hits.select(
        "doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"),
    )


OP5_SQL = r"""
WITH w AS (
  SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws,
    regexp_extract_all(text, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS own, coalesce(text, '') AS text FROM documents
), b AS (
  SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark
), bw AS (
  SELECT DISTINCT item_id, n, array_to_string(ws[i : i + n - 1], ' ') AS win
  FROM (SELECT item_id, ws, n, unnest(range(1, len(ws) - n + 2)) AS i FROM (SELECT *, least(10, len(ws)) AS n FROM b WHERE len(ws) > 0))
), lengths AS (SELECT DISTINCT n FROM bw),
dw AS (
  SELECT doc_id, n, i, array_to_string(ws[i : i + n - 1], ' ') AS win
  FROM (SELECT doc_id, ws, n, unnest(range(1, len(ws) - n + 2)) AS i FROM w, lengths WHERE len(ws) >= n)
), h AS (SELECT doc_id, dw.n, i, item_id FROM dw JOIN bw USING (win, n)),
p AS (SELECT doc_id, count(DISTINCT pos) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS pos FROM h) GROUP BY doc_id),
t AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS items FROM h GROUP BY doc_id)
SELECT doc_id, CAST(coalesce(len(ws), 0) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, n_hit IS NOT NULL AS contaminated
FROM w LEFT JOIN p USING (doc_id) LEFT JOIN t USING (doc_id)
"""
