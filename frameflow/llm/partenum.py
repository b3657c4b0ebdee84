"""Exact Jaccard self-join of shingle sets by PartEnum signatures."""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from frameflow.llm.common import LOWER_BLANK, partitions_of, save, table
from frameflow.llm.components import connected_components
from frameflow.llm.simjoin import _M1, _M3, BUCKETS, PACKED, dealt, many_shingles, mix, only_ids, packed_signatures, pool_rows, pool_schema, shared_signatures, similar_components, some_at_a_time

NUM, DEN, SHINGLE = 85, 100, 4
#: Second-level partitions of each first-level one, and how many of them may differ. (2, 1) makes a third fewer signatures, each of
#: a third fewer values, but its chance candidates grow much faster than the input. ``_refined`` is written for one part left out of three.
N2, K2 = 3, 1
#: Partitions after its own by which a signature without values is refined.
CHAIN = 3
#: Largest size of a band over its smallest.
BAND = 1.4
#: Signatures keep 48 bits: zero bytes take no room in the shuffle, and a chance collision only adds a candidate.
_SIGNATURE = np.uint64(0xFFFFFFFFFFFF0000)
_ROWS = 65_536


@cache
def _bands(num: int, den: int) -> list[int]:
    """The largest set size of each band, up to 2^40."""
    tops = [1]
    while tops[-1] < 2**40:
        tops.append(max(tops[-1] + 1, int(tops[-1] * BAND)))
    return tops


@cache
def _scheme(top: int, num: int, den: int) -> tuple[int, np.ndarray]:
    """First-level partitions for sets of at most ``top``, and the second-level subsets enumerated.

    Linked sets have a Hamming distance of at most k = 2 top (den - num) / (den + num). Over n1 partitions with n1 (K2 + 1) > k
    one has at most K2 differences, which leave N2 - K2 of its N2 parts equal.
    """
    k = 2 * top * (den - num) // (den + num)
    return k // (K2 + 1) + 1, np.array(list(combinations(range(N2), N2 - K2)))


def _cells(at: np.ndarray, s: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(sums, counts) of the values s in each of n cells; at: the cell of each value."""
    sums = np.zeros(n, np.uint64)
    np.add.at(sums, at, s)
    return sums, np.bincount(at, minlength=n)


def _refined(acc: np.ndarray, i: np.ndarray, s: np.ndarray, part: np.ndarray, third: np.ndarray, n1: int, sums: np.ndarray, counts: np.ndarray) -> list[np.ndarray]:
    """Signatures in place of those that hold no value; acc: these; i: their first-level partitions; third: the part of it that each leaves out.

    All sets with the same gap would share an empty signature, so buckets of them would grow with the corpus and their pairs with its square. Both sets of a
    linked pair have the gap, so both sign by more:
    1. The partition holds at most one difference, so what the third part holds differs by at most one value: it signs whole, and without each one of its values.
    2. Where that is empty too: differences on a ring of n1 partitions that add up to k < 2 n1 leave a partition from where on each stretch of m partitions
       holds fewer than 2 m of them (the cycle lemma). So CHAIN partitions after i hold at most 2 CHAIN + 1, and of 2 CHAIN + 2 groups of their values one holds none.
       Each group signs; one that is empty signs by the groups of a second draw.
    """
    n = counts[third]
    out = [mix(acc[n > 0] * _M1 + mix(sums[third[n > 0]] + _M3))]
    several = np.flatnonzero(n > 1)
    if len(several):
        order = np.argsort(part, kind="stable")
        ends = np.cumsum(counts)
        many = n[several]
        at = np.repeat(ends[third[several]] - np.cumsum(many), many) + np.arange(many.sum())
        out.append(mix(np.repeat(acc[several], many) * _M1 + mix(np.repeat(sums[third[several]], many) - s[order[at]] + _M3)))
    acc, i = mix(acc[n < 2] + _M3), i[n < 2]
    chain = min(CHAIN, n1 - 1)
    if not chain or not len(acc):
        return [*out, acc]
    groups = 2 * chain + 2
    for draw in (1, 2):
        group = (mix(s + np.uint64(draw)) % np.uint64(groups)).astype(np.int64)
        own, held = (c.reshape(n1, groups) for c in _cells(part // N2 * groups + group, s, n1 * groups))
        next_ = (i[:, None] + np.arange(1, chain + 1)) % n1
        total, some = own[next_].sum(1, dtype=np.uint64), held[next_].sum(1) > 0
        new = mix(acc[:, None] * _M1 + mix(total + mix(np.arange(groups, dtype=np.uint64) + np.uint64(draw << 32))[None, :]))
        out.append(new[some] if draw == 1 else new.ravel())
        acc, i = new[~some], np.broadcast_to(i[:, None], new.shape)[~some]
        if not len(acc):
            break
    return out


def signatures(s: np.ndarray, num: int = NUM, den: int = DEN) -> np.ndarray:
    """48-bit PartEnum signatures of a non-empty set: two sets with den * |both| >= num * |either| share at least one.

    A set signs in its own band of sizes and, if a larger partner could be in a later one, in that too. Signatures that hold no value are refined.
    """
    tops = _bands(num, den)
    band = int(np.searchsorted(tops, len(s)))
    out = []
    while True:
        n1, subsets = _scheme(tops[band], num, den)
        if n1 == 1 and 2 * tops[band] * (den - num) // (den + num) == 0:  # only equal sets are linked
            out.append(mix(np.array([mix(s + np.uint64(band)).sum(dtype=np.uint64)])))
        else:
            # values of the set are random bits already: some choose the part, all are summed
            part = (s >> np.uint64(16)).astype(np.int64) % (n1 * N2)
            raw, counts = _cells(part, s, n1 * N2)
            sums = mix(raw).reshape(n1, N2)
            acc = mix(np.arange(n1, dtype=np.uint64) + np.uint64((band + 1) << 32))[:, None] + mix(np.arange(len(subsets), dtype=np.uint64) + _M3)[None, :]
            for j in range(N2 - K2):
                acc = mix(acc * _M1 + sums[:, subsets[:, j]])
            empty = counts.reshape(n1, N2)[:, subsets].sum(2) == 0
            out.append(acc[~empty])
            if empty.any():
                i, j = np.nonzero(empty)
                third = i * N2 + (N2 * (N2 - 1) // 2 - subsets.sum(1))[j]
                out += _refined(acc[empty], i, s, part, third, n1, raw, counts)
        if len(s) * den < num * (tops[band] + 1):  # a partner has at most size * den / num
            break
        band += 1
    return np.concatenate(out) & _SIGNATURE


def _texts(batch: pa.RecordBatch) -> Iterator[tuple[pa.Array, list[bytes]]]:
    """(ids, words and blanks of the texts) of the rows (id, text); only about a megabyte of them is held as Python objects at a time."""
    for i, j in some_at_a_time(pc.fill_null(pc.binary_length(batch.column(1)), 0).to_pylist()):
        yield batch.column(0).slice(i, j - i), [(t or "").encode().translate(LOWER_BLANK) for t in batch.column(1).slice(i, j - i).to_pylist()]


def _sets(batch: pa.RecordBatch, size: int) -> Iterator[tuple[pa.Array, list[np.ndarray]]]:
    """(ids, sets) of the rows (id, text), about a megabyte of texts at a time."""
    for ids, texts in _texts(batch):
        values, counts = many_shingles(texts, size)
        yield ids, np.split(values, np.cumsum(counts)[:-1])


def _keys(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, sets in _sets(batch, size):
                yield pa.RecordBatch.from_arrays(
                    [ids, pa.array([len(s) for s in sets], pa.int64()), pa.array([xxhash.xxh3_128_digest(s.tobytes()) for s in sets], pa.binary())],
                    names=["doc_id", "n_shingles", "key"],
                )

    return run


def _signed(size: int, num: int, den: int):
    """Signature rows; a set met again by the same task, told by its digest, signs only once for the first of its documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()
        out: list[np.ndarray] = []
        ids: list[np.ndarray] = []
        n = 0

        def flush() -> pa.RecordBatch:
            return dealt(np.concatenate(out), pa.array(np.concatenate(ids)))

        for batch in batches:
            for doc, s in ((d, s) for docs, sets in _sets(batch, size) for d, s in zip(docs, sets, strict=True)):
                digest = xxhash.xxh3_128_digest(s.tobytes())
                if not len(s) or digest in seen:
                    continue
                seen.add(digest)
                sig = signatures(s, num, den)
                out.append(sig)
                ids.append(np.full(len(sig), doc.as_py(), np.int64))
                n += len(sig)
                if n >= _ROWS:
                    yield flush()
                    out, ids, n = [], [], 0
        if out:
            yield flush()

    return run


def _pooled(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, texts in _texts(batch):
                yield from pool_rows(ids, texts, size)

    return run


def jaccard_components(docs: DataFrame, num: int = NUM, den: int = DEN, size: int = SHINGLE) -> DataFrame:
    """docs (doc_id, text) -> doc_id, n_shingles, component_id: the smallest doc_id reachable over links den * |both| >= num * |either|.

    Documents of equal sets are one class, found by a 128-bit digest of the set, and only the smallest doc_id of each goes on,
    so copies are never paired. Null texts and texts without words have the empty set and are linked with nothing. A null doc_id
    is linked with nothing and has a null component. doc_id names a document: rows that repeat one share a component
    if any of them is linked. Other columns are ignored. Shingles are compared as 64-bit hashes.
    """
    texts = docs.select(F.col("doc_id").cast("long"), "text")
    keyed = save(texts.mapInArrow(_keys(size), "doc_id bigint, n_shingles bigint, key binary"), "sets")
    own = keyed.where("n_shingles > 0 AND doc_id IS NOT NULL")
    classes = save(own.groupBy("key").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most")), "classes")
    several = save(classes.where("least < most"), "several")
    signed = texts.where("doc_id IS NOT NULL").mapInArrow(packed_signatures(_signed(size, num, den), BUCKETS * partitions_of(texts)), PACKED)

    def pool_of(ids: DataFrame) -> DataFrame:
        return only_ids(texts.withColumnRenamed("doc_id", "id"), ids, "id").select("id", "text").mapInArrow(_pooled(size), pool_schema("bigint"))

    linked = save(similar_components(shared_signatures(signed, "bigint", "jaccard"), pool_of, size, num, den, "jaccard"), "linked")
    # of a class, several tasks may each have signed one document: the class is joined over all of them
    of_class = save(keyed.join(several.select("key", "least"), "key").select("doc_id", "least").distinct(), "of-class")
    bridges = of_class.join(linked.withColumnRenamed("id", "doc_id"), "doc_id").selectExpr("least a", "component b").where("a <> b")
    merged = save(connected_components(bridges, "bridges"), "merged")
    start = (
        keyed.join(of_class.groupBy("doc_id").agg(F.min("least").alias("least")), "doc_id", "left").select("doc_id", "n_shingles", F.coalesce("least", "doc_id").alias("rep"))
        .join(linked.select(F.col("id").alias("rep"), "component"), "rep", "left")
        .select("doc_id", "n_shingles", F.coalesce("component", "rep").alias("c"))
    )
    return start.join(merged.select(F.col("id").alias("c"), F.col("component").alias("m")), "c", "left").select(
        "doc_id", "n_shingles", F.when(F.col("n_shingles") == 0, F.col("doc_id")).otherwise(F.coalesce("m", "c")).alias("component_id")
    )


def op10_partenum_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(table(spark, sf_dir, "documents"))


OP10_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents
), s AS (
  SELECT DISTINCT doc_id, md5(array_to_string(ws[i : i + 3], ' ')) AS g
  FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 3, 1) + 1)) AS i FROM w WHERE len(ws) > 0)
), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
pairs AS (
  SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS shared
  FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2
), links AS (
  SELECT x, y FROM pairs JOIN n nx ON nx.doc_id = x JOIN n ny ON ny.doc_id = y WHERE 100 * shared >= 85 * (nx.n + ny.n - shared)
), both_ways AS (SELECT x, y FROM links UNION ALL SELECT y, x FROM links),
reach AS (
  SELECT doc_id AS at, doc_id AS seen FROM w
  UNION
  SELECT reach.at, both_ways.y FROM reach JOIN both_ways ON both_ways.x = reach.seen
)
SELECT w.doc_id, coalesce(n.n, 0) AS n_shingles, min(seen) AS component_id
FROM w LEFT JOIN n USING (doc_id) JOIN reach ON reach.at = w.doc_id GROUP BY 1, 2
"""
