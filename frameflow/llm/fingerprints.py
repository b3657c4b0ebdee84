"""Canonical exact digests: Unicode, case and blank folding, a wide xxhash, bytes compared inside equal buckets."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from frameflow.llm.common import partitions_of, save, table
from frameflow.llm.simjoin import only_ids

_ROWS = 512
#: So many copies of one text are compared with its first by one task, about.
_DEALT = 1_000


def canonical(text: str | None) -> bytes:
    """NFKC, case folded, NFKC again (folding may undo it), runs of blanks as one space, none at the ends; as UTF-8."""
    if not text:
        return b""
    if text.isascii():
        return b" ".join(text.lower().encode().split())
    folded = unicodedata.normalize("NFKC", unicodedata.normalize("NFKC", text).casefold())
    return " ".join(folded.split()).encode()


def fingerprint(data: bytes) -> str:
    return xxhash.xxh3_128_hexdigest(data)


def _prints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        prints = [fingerprint(canonical(t.as_py())) for t in batch.column(1)]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(prints, pa.string())], names=["doc_id", "fingerprint"])


def _compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        same = [canonical(a.as_py()) == canonical(b.as_py()) for a, b in zip(batch.column(2), batch.column(3), strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(same, pa.bool_())], names=["doc_id", "fingerprint", "same"])


def exact_classes(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text) -> doc_id, fingerprint, class_id: the smallest doc_id with the same canonical bytes.

    Buckets of equal fingerprints are compared byte by byte with their smallest doc_id; only texts in buckets of several are read
    again. A bucket of many copies is dealt over as many tasks as it has thousands of documents, and only its first text goes to each. Should bytes differ under one fingerprint, those documents are split off by a SHA-256 of the bytes. Null texts are
    empty; rows that repeat a doc_id are one document if equal; a null doc_id has a null class. Other columns are ignored.
    """
    texts = docs.select(F.col("doc_id").cast("long"), "text")
    prints = save(texts.mapInArrow(_prints, "doc_id bigint, fingerprint string"), "prints")
    several = save(
        prints.groupBy("fingerprint").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last"), F.count(F.lit(1)).alias("n")).where("first < last")
        .select("fingerprint", "first", F.ceil(F.col("n") / _DEALT).cast("long").alias("deals")), "buckets")
    inside = save(prints.join(several, "fingerprint").distinct(), "inside")
    # texts outside buckets of several are left out before the shuffle
    own = only_ids(texts, save(inside.select("doc_id").distinct(), "inside-ids"), "doc_id")
    mine = inside.join(own, "doc_id").select("doc_id", "fingerprint", F.pmod(F.xxhash64("doc_id"), F.col("deals")).alias("deal"), F.col("text").alias("text"))
    firsts = save(several.withColumnRenamed("first", "doc_id").join(only_ids(texts, several.select(F.col("first").alias("doc_id")).distinct(), "doc_id"), "doc_id").select("fingerprint", F.col("text").alias("text_of_first")), "firsts")
    firsts = firsts.join(several.select("fingerprint", "deals"), "fingerprint").select("fingerprint", "text_of_first", F.explode(F.sequence(F.lit(0).cast("long"), F.col("deals") - 1)).alias("deal"))
    checked = save(mine.join(firsts, ["fingerprint", "deal"]).select("doc_id", "fingerprint", "text", "text_of_first").mapInArrow(_compared, "doc_id bigint, fingerprint string, same boolean"), "checked")
    placed = prints.join(checked.groupBy("doc_id", "fingerprint").agg(F.max("same").alias("same")), ["doc_id", "fingerprint"], "left").join(several.select("fingerprint", "first"), "fingerprint", "left")
    return placed.select("doc_id", "fingerprint", F.when(F.col("same"), F.col("first")).otherwise(F.col("doc_id")).alias("class_id"))


_OUT = {
    "doc_id": pa.int64(), "n_chars": pa.int64(), "edited_sha256": pa.string(), "fingerprint": pa.string(),
    "edited_fingerprint": pa.string(), "near_edited": pa.float64(), "near_next": pa.float64(),
}


def _edited(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of a stretch in descending order, then the first row of the next stretch (ghost): each real row meets its follower."""
    out: list[tuple] = []
    before: tuple | None = None

    def row(doc: int | None, text: str, data: bytes, mark: str, following: tuple | None) -> tuple:
        half = len(text) // 2
        after = following[1] if following else ""
        edited = text[: len(text) - half] + after[:half]
        e = canonical(edited)
        e_mark = fingerprint(e)
        like = lambda other, m: float(m == mark and other == data)  # noqa: E731  bytes are compared inside equal buckets
        return doc, len(text), sha256(edited.encode()).hexdigest(), mark, e_mark, like(e, e_mark), like(following[2], following[3]) if following else 0.0

    def flush() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), _OUT.values(), strict=True)], names=list(_OUT))

    stretch = None
    for batch in batches:
        for part, ghost, doc, text in zip(*(batch.column(i) for i in range(4)), strict=True):
            part, text = part.as_py(), text.as_py() or ""
            data = canonical(text)
            now = (doc.as_py(), text, data, fingerprint(data))
            if before and part == stretch:
                out.append(row(*before, now))
            elif before:
                out.append(row(*before, None))
            stretch, before = part, None if ghost.as_py() else now
            if len(out) >= _ROWS:
                yield flush()
                out = []
    if before:
        out.append(row(*before, None))
    if out:
        yield flush()


def _dealt(cuts: list[int], nulls: bool):
    """(part, ghost, doc_id, h, text): each row in its stretch, and the first of a stretch in the one before as well.

    A stretch reaches from a cut down to above the next cut, so that its first document is the cut itself; stretch 0 is the highest.
    Null ids are a stretch of their own at the end. The first stretch of all follows the last.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ascending, n = np.array(cuts, np.int64), len(cuts)
        for batch in batches:
            null = batch.column(0).is_null().to_numpy(zero_copy_only=False)
            ids = batch.column(0).fill_null(0).to_numpy()
            at = np.searchsorted(ascending, ids)
            part = np.where(null, n if n else 0, n - 1 - at)
            first = np.flatnonzero(null if not n else null | (~null & (ascending[np.minimum(at, n - 1)] == ids)))
            before = np.where(part[first] == 0, n if nulls and n else max(n - 1, 0), part[first] - 1)
            rows = np.concatenate([np.arange(len(ids)), first])
            h = np.array([xxhash.xxh3_64_intdigest(t.as_py() or "") for t in batch.column(1)], np.uint64).view(np.int64)
            ghost = np.concatenate([np.zeros(len(ids)), np.ones(len(first))])
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate([part, before]), pa.int32()), pa.array(ghost, pa.int32()), batch.column(0).take(pa.array(rows)), pa.array(h[rows]), batch.column(1).take(pa.array(rows))],
                names=["part", "ghost", "doc_id", "h", "text"],
            )

    return run


def edited_fingerprints(docs: DataFrame, stretches: int | None = None) -> DataFrame:
    """docs (doc_id, text) -> the contract's row for each document and its follower in descending doc_id.

    Documents are dealt to stretches of the order, cut at actual doc_ids, and the first document after a cut is sent to the
    stretch before it too, so each meets its follower without a global order and texts are shuffled once. After the last
    comes the first. Null texts are empty; ties of doc_id are in the order of their texts' hash; null doc_ids come last. A single document follows itself; no documents
    give no rows. Likeness is 1 for equal canonical bytes, else 0. Other columns are ignored.
    """
    texts = docs.select(F.col("doc_id").cast("long"), "text")
    partitions = partitions_of(docs)
    n = stretches or 4 * partitions
    cuts, top, nulls, last = texts.agg(
        F.percentile_approx("doc_id", [i / n for i in range(n)], 10_000), F.max("doc_id"), F.count_if(F.col("doc_id").isNull()), F.min("doc_id")
    ).first()
    uppers = sorted({*(cuts or []), *([top] if top is not None else []), *([last] if last is not None else [])}, reverse=True)
    spread = texts.mapInArrow(_dealt(uppers[::-1], bool(nulls)), "part int, ghost int, doc_id bigint, h bigint, text string")
    ordered = spread.repartition(partitions, "part").sortWithinPartitions("part", "ghost", F.col("doc_id").desc_nulls_last(), "h")
    return ordered.select("part", "ghost", "doc_id", "text").mapInArrow(_edited, "doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")


def digests_and_classes(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text) -> the rows of edited_fingerprints with class_id, the smallest doc_id with the same canonical bytes; null for a null doc_id."""
    classes = exact_classes(docs).where("doc_id IS NOT NULL").distinct()
    return edited_fingerprints(docs).join(classes, ["doc_id", "fingerprint"], "left").select(*_OUT, "class_id")


def op8_canonical_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests_and_classes(table(spark, sf_dir, "documents"))
