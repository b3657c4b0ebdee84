"""Reversible line dedup: exact reference counts per line, with sharded cuckoo filters in front."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from frameflow.llm.common import _LOWER, BLANKS, kept_columns, partitions_of, save, table

MIN_CHARS = 10
#: Keys of a shard, about: its filter takes two to three bytes for each. The number of shards follows the number of keys.
SHARD_KEYS = 100_000
_SLOTS, _KICKS = 4, 500


class Cuckoo:
    """A cuckoo filter of 16-bit fingerprints in buckets of four. Keys are 16 random bytes; a key may be added and removed once.

    It grows instead of failing, from the keys that its owner holds, so it never forgets a key.
    """

    def __init__(self, buckets: int):
        self.table = np.zeros((1 << max(1, (buckets - 1).bit_length()), _SLOTS), np.uint16)

    @classmethod
    def of(cls, keys: list[bytes]) -> Cuckoo:
        size = max(2, len(keys) // 3)
        while True:
            f = cls(size)
            if all(f.add(k) for k in keys):
                return f
            size *= 2

    @classmethod
    def load(cls, data: bytes) -> Cuckoo:
        f = cls(1)
        f.table = np.frombuffer(data, np.uint16).reshape(-1, _SLOTS).copy()
        return f

    def dump(self) -> bytes:
        return self.table.tobytes()

    @staticmethod
    def _other(bucket, mark, mask):
        return bucket ^ ((mark.astype(np.int64) * 0x5BD1E995) & mask)

    def _places(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """keys: rows of two 64-bit values -> fingerprints and both buckets."""
        mask = len(self.table) - 1
        mark = ((keys[:, 1] >> np.uint64(48)).astype(np.int64) % 65535 + 1).astype(np.uint16)
        one = (keys[:, 0] & np.uint64(mask)).astype(np.int64)
        return mark, one, self._other(one, mark, mask)

    def holds(self, keys: np.ndarray) -> np.ndarray:
        mark, one, two = self._places(keys)
        return (self.table[one] == mark[:, None]).any(1) | (self.table[two] == mark[:, None]).any(1)

    def _place(self, key: bytes):
        mark, one, two = self._places(np.frombuffer(key, "<u8").reshape(1, 2))
        return mark[0], int(one[0]), int(two[0])

    def add(self, key: bytes) -> bool:
        mark, one, two = self._place(key)
        mask = len(self.table) - 1
        for turn in range(_KICKS):
            for b in (one, two):
                free = np.flatnonzero(self.table[b] == 0)
                if len(free):
                    self.table[b, free[0]] = mark
                    return True
            slot = turn % _SLOTS
            mark, self.table[two, slot] = self.table[two, slot], mark
            one = two
            two = int(self._other(np.int64(two), mark, mask))
        return False

    def remove(self, key: bytes) -> None:
        mark, one, two = self._place(key)
        for b in (one, two):
            at = np.flatnonzero(self.table[b] == mark)
            if len(at):
                self.table[b, at[0]] = 0
                return


def line_key(line: bytes) -> bytes | None:
    """The 128-bit digest of a line's key; None where the key has fewer than MIN_CHARS code points."""
    key = line.strip(BLANKS).translate(_LOWER)
    if len(key) < MIN_CHARS or len(key) < 4 * MIN_CHARS and len(key.decode()) < MIN_CHARS:
        return None
    return xxhash.xxh3_128_digest(key)


def shard_of(key, shards: int):
    """Of a binary column."""
    return F.pmod(F.xxhash64(key), F.lit(shards)).cast("int")


def _postings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, doc_id) of the lines of a batch, once for each key of a text."""
    for batch in batches:
        docs, keys = [], []
        for doc, text in zip(batch.column(0), batch.column(1), strict=True):
            doc, text = doc.as_py(), text.as_py()
            if doc is None or not text:
                continue
            own = {k for line in text.encode().split(b"\n") if (k := line_key(line))}
            keys.extend(own)
            docs.extend([doc] * len(own))
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(docs, pa.int64())], names=["key", "doc_id"])


def postings(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text) -> (key, doc_id), once for each line key of a document, also where rows repeat a doc_id."""
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(_postings, "key binary, doc_id bigint").distinct()


def reference_counts(held: DataFrame) -> DataFrame:
    """(key, doc_id) -> the exact table: key, refs (documents that hold it), keeper (smallest doc_id), last (largest)."""
    return held.groupBy("key").agg(F.count(F.lit(1)).alias("refs"), F.min("doc_id").alias("keeper"), F.max("doc_id").alias("last"))


def _build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    keys: dict[int, list[bytes]] = {}
    for batch in batches:
        for shard, key in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            keys.setdefault(shard, []).append(key)
    for shard, own in keys.items():
        yield pa.RecordBatch.from_arrays([pa.array([shard], pa.int32()), pa.array([Cuckoo.of(own).dump()], pa.binary())], names=["shard", "filter"])


def build_filters(shared: DataFrame, shards: int) -> DataFrame:
    """shared (key) -> (shard, filter): a cuckoo filter over the keys of each shard, built where the shard is."""
    dealt = shared.select(shard_of("key", shards).alias("shard"), "key").repartition(shards, "shard")
    return dealt.mapInArrow(_build, "shard int, filter binary")


def _changed(key: tuple, old: pa.Table, new: pa.Table) -> pa.Table:
    loaded = old.column("filter").to_pylist()
    keys, states = new.column("key").to_pylist(), new.column("now").to_pylist()
    kept = [k for k, s in zip(keys, states, strict=True) if s == "kept"]
    add = [k for k, s in zip(keys, states, strict=True) if s == "added"]
    f = Cuckoo.load(loaded[0]) if loaded else Cuckoo(2)
    for k, s in zip(keys, states, strict=True):
        if s == "gone":
            f.remove(k)
    if not all(f.add(k) for k in add):
        f = Cuckoo.of(kept + add)
    shard = key[0].as_py()
    return pa.table({"shard": pa.array([shard], pa.int32()), "filter": pa.array([f.dump()], pa.binary())})


class LineIndex:
    """Line dedup that takes documents in and out again: postings (key, doc_id), the exact reference counts and the filters of the shared keys.

    All three are tables; insert() and delete() return a new index whose state equals one built from scratch on the documents that are in it. Reference counts go up and
    down by the postings that come and go; only keys that lose their smallest or largest document are looked up in the postings again.
    """

    def __init__(self, held: DataFrame, counts: DataFrame, filters: DataFrame, shards: int):
        self.held, self.counts, self.filters, self.shards = held, counts, filters, shards

    @staticmethod
    def _shards(counts: DataFrame) -> int:
        return 1 + counts.where("refs > 1").count() // SHARD_KEYS

    @classmethod
    def of(cls, docs: DataFrame, shards: int | None = None) -> LineIndex:
        held = save(postings(docs), "line-postings")
        counts = save(reference_counts(held), "line-counts")
        shards = shards or cls._shards(counts)
        return cls(held, counts, save(build_filters(counts.where("refs > 1").select("key"), shards), "line-filters"), shards)

    def _with(self, held: DataFrame, counts: DataFrame) -> LineIndex:
        """Filters take in the keys that are shared now and let go those that no longer are; once keys outgrow the shards, they are built anew."""
        counts = save(counts, "line-counts")
        if (shards := self._shards(counts)) > 2 * self.shards:
            return LineIndex(held, counts, save(build_filters(counts.where("refs > 1").select("key"), shards), "line-filters"), shards)
        was = self.counts.where("refs > 1").select("key", F.lit(True).alias("was"))
        now = counts.where("refs > 1").select("key", F.lit(True).alias("is"))
        states = was.join(now, "key", "full").select(
            shard_of("key", self.shards).alias("shard"), "key", F.when(F.col("was").isNull(), "added").when(F.col("is").isNull(), "gone").otherwise("kept").alias("now")
        )
        filters = self.filters.groupBy("shard").cogroup(states.groupBy("shard")).applyInArrow(_changed, "shard int, filter binary")
        return LineIndex(held, counts, save(filters, "line-filters"), self.shards)

    def insert(self, docs: DataFrame) -> LineIndex:
        """docs (doc_id, text) come in; lines that a document of that doc_id has already are counted once."""
        new = save(postings(docs).join(self.held, ["key", "doc_id"], "left_anti"), "line-new")
        more = reference_counts(new).select("key", F.col("refs").alias("more"), F.col("keeper").alias("low"), F.col("last").alias("high"))
        counts = self.counts.join(more, "key", "full").select(
            "key", (F.coalesce("refs", F.lit(0)) + F.coalesce("more", F.lit(0))).alias("refs"), F.least("keeper", "low").alias("keeper"), F.greatest("last", "high").alias("last")
        )
        return self._with(save(self.held.unionByName(new), "line-postings"), counts)

    def delete(self, ids: DataFrame) -> LineIndex:
        """ids (doc_id): the documents that leave."""
        leaving = ids.select(F.col("doc_id").cast("long")).distinct()
        gone = save(self.held.join(leaving, "doc_id", "left_semi"), "line-gone")
        held = save(self.held.join(leaving, "doc_id", "left_anti"), "line-postings")
        less = reference_counts(gone).select("key", F.col("refs").alias("less"), F.col("keeper").alias("low"), F.col("last").alias("high"))
        left = save(self.counts.join(less, "key", "left").withColumn("refs", F.col("refs") - F.coalesce("less", F.lit(0))).where("refs > 0"), "line-left")
        moved = left.where("low = keeper or high = last")
        ends = held.join(moved.select("key"), "key", "left_semi").groupBy("key").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("final"))
        counts = left.join(ends, "key", "left").select("key", "refs", F.coalesce("first", "keeper").alias("keeper"), F.coalesce("final", "last").alias("last"))
        return self._with(held, counts)

    def drops(self) -> DataFrame:
        """(key, doc_id): the lines that go, all but those of the smallest document of a key that several hold.

        Postings meet their shard's filter where both are dealt to, each shard over as many tasks as the session has partitions for it;
        what the filters let through meets the exact table.
        """
        partitions = partitions_of(self.held)
        deals = max(1, partitions // self.shards)
        empty = lambda kind, name: F.lit(None).cast(kind).alias(name)
        rows = self.held.select(shard_of("key", self.shards).alias("shard"), F.pmod(F.xxhash64("doc_id"), F.lit(deals)).cast("int").alias("deal"), empty("binary", "filter"), "key", "doc_id")
        filters = self.filters.select("shard", F.explode(F.sequence(F.lit(0), F.lit(deals - 1))).alias("deal"), "filter", empty("binary", "key"), empty("bigint", "doc_id"))
        met = rows.unionByName(filters).repartition(partitions, "shard", "deal").sortWithinPartitions("shard", "deal", F.col("filter").isNull())
        return met.mapInArrow(_maybe, "key binary, doc_id bigint").join(self.counts.where("refs > 1").select("key", "keeper"), "key").where("doc_id > keeper").select("key", "doc_id")


def _maybe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of (shard, deal, filter, key, doc_id), where a shard's filter stands before its postings, those whose key the filter may hold; filters forget no key, so no shared line is missed."""
    shard, held = None, None
    for batch in batches:
        shards, data = batch.column(0).to_numpy(), batch.column(2)
        filters = np.flatnonzero(data.is_valid().to_numpy(zero_copy_only=False))
        keys = np.frombuffer(b"".join(k or bytes(16) for k in batch.column(3).to_pylist()), "<u8").reshape(-1, 2)
        hit = np.zeros(len(shards), bool)
        for begin, end in zip([0, *filters], [*filters, len(shards)], strict=True):
            if begin in filters:
                shard, held = shards[begin], Cuckoo.load(data[begin].as_py())
                begin += 1
            own = begin + np.flatnonzero(shards[begin:end] == shard)
            if held is not None and len(own):
                hit[own] = held.holds(keys[own])
        yield batch.select([3, 4]).filter(pa.array(hit))


def _kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        n_lines, n_dropped, kept = [], [], []
        for text, gone in zip(batch.column(1), batch.column(2), strict=True):
            lines = (text.as_py() or "").encode().split(b"\n")
            gone = set(gone.as_py() or ())
            stay = [line for line in lines if not gone or line_key(line) not in gone]
            n_lines.append(len(lines))
            n_dropped.append(len(lines) - len(stay))
            kept.append(b"\n".join(stay).decode())
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(n_lines, pa.int64()), pa.array(n_dropped, pa.int64()), pa.array(kept, pa.string()), *batch.columns[3:]],
            names=["doc_id", "n_lines", "n_dropped", "kept", *batch.schema.names[3:]],
        )


def dedup_lines(docs: DataFrame, index: LineIndex | None = None, keep: Sequence[str] = ()) -> DataFrame:
    """docs (doc_id, text) -> doc_id, n_lines, n_dropped, kept (the text that stays), and the columns ``keep`` as they are.

    A line is dropped if its key (blanks stripped, A-Z lower-cased, 10 code points or more) is in another document with a smaller doc_id; all its
    lines in that document stay. Null and empty texts have one empty line. Rows that repeat a doc_id are one
    document, which loses no lines to itself; a row without doc_id keeps its lines and counts for none. Other columns are ignored;
    to keep one named like a column made here raises. Keys are compared by 128-bit digests. Texts are shuffled once, to meet the keys that they lose.
    """
    keep = kept_columns(keep, ("n_lines", "n_dropped", "kept", "gone"))
    index = index or LineIndex.of(docs)
    gone = save(index.drops().groupBy("doc_id").agg(F.collect_set("key").alias("gone")), "line-drops")
    met = docs.select(F.col("doc_id").cast("long"), F.col("text").alias("__text"), *keep).join(gone, "doc_id", "left").select("doc_id", "__text", "gone", *keep)
    kinds = (T.LongType(), T.LongType(), T.LongType(), T.StringType())
    schema = [*(T.StructField(n, t) for n, t in zip(("doc_id", "n_lines", "n_dropped", "kept"), kinds, strict=True)), *(met.schema[c] for c in keep)]
    return met.mapInArrow(_kept, T.StructType(schema))


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_lines(table(spark, sf_dir, "documents")).select("doc_id", "n_lines", "n_dropped", F.sha2("kept", 256).alias("kept_sha256"))


OP9_SQL = r"""
WITH d AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
l AS (SELECT doc_id, unnest(ls) AS line, generate_subscripts(ls, 1) AS no FROM d),
k AS (SELECT *, translate(regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
s AS (SELECT key, min(doc_id) AS keeper FROM k WHERE length(key) >= 10 GROUP BY key HAVING count(DISTINCT doc_id) >= 2),
j AS (SELECT k.*, s.keeper IS NOT NULL AND k.doc_id <> s.keeper AS gone FROM k LEFT JOIN s USING (key))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY no) FILTER (NOT gone), '')) AS kept_sha256
FROM j GROUP BY doc_id
"""
