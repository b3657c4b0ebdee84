"""From signatures to exact links: candidate pairs out of shared signatures, verified on whole sets."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce
from itertools import groupby

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from frameflow.llm.common import partitions_of, save
from frameflow.llm.components import connected_components

_M1, _M2, _M3 = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB))
#: Ids are broadcast up to this many (16 MB of longs), pairs of ids up to a quarter of it; larger tables are joined by a shuffle.
BROADCAST_IDS = 1_000_000
#: A signature that recurs so often among the rows of one flush is dealt in two levels.
HOT = 8
#: Centres drawn in a bucket at once: first among all its ids, then among those of its largest component, then the pairs of what is still apart are listed.
CENTRES = (4, 12)
#: Remains with so many pairs are listed at once.
FEW_PAIRS = 50_000


def only_ids(df: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """Rows of df whose key is among ids (one column, saved): broadcast behind a count, else a shuffled semi join."""
    return df.join(F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids, key, "left_semi")


def small(pairs: DataFrame) -> DataFrame:
    """A saved table of two ids or signatures a row, to be broadcast if a count says that it is small."""
    return F.broadcast(pairs) if pairs.count() <= BROADCAST_IDS // 4 else pairs


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * _M2
    x = (x ^ (x >> np.uint64(27))) * _M3
    return x ^ (x >> np.uint64(31))


_BYTES = mix(np.arange(1, 64 * 256 + 1, dtype=np.uint64))


def word_hashes(data: bytes) -> np.ndarray:
    """A 64-bit hash of each word between the blanks of data: the sum of a random value for each byte at its place, mixed."""
    a = np.frombuffer(data, np.uint8)
    at = np.flatnonzero(a != 32)
    if not len(at):
        return np.empty(0, np.uint64)
    starts = np.flatnonzero(np.diff(at, prepend=-2) > 1)
    place = at - np.repeat(at[starts], np.diff(starts, append=len(at)))
    code = place * 256 + a[at]
    values = _BYTES[code] if place.max() < 64 else mix(code.astype(np.uint64) + np.uint64(1))
    return mix(np.add.reduceat(values, starts))


def shingles(data: bytes, size: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word shingles of data; fewer words than a shingle make one; none none."""
    h = word_hashes(data)
    if not len(h):
        return h
    n, width = max(1, len(h) - size + 1), min(size, len(h))
    acc = np.full(n, width, np.uint64)
    for i in range(width):
        acc = acc * _M1 + h[i : i + n]
    return np.unique(mix(acc))


def many_shingles(texts: list[bytes], size: int) -> tuple[np.ndarray, np.ndarray]:
    """(values, counts): the sets of ``shingles`` for many texts one after another, all worked on at once. texts: words and blanks."""
    h = word_hashes(b" ".join(texts))
    n = np.array([len(t.split()) for t in texts])
    width = np.minimum(n, size)
    many = np.where(n > 0, np.maximum(1, n - size + 1), 0)
    owner = np.repeat(np.arange(len(texts)), many)
    at = np.arange(len(owner)) - np.repeat(np.cumsum(many) - many, many) + np.repeat(np.cumsum(n) - n, many)
    acc = width[owner].astype(np.uint64)
    for i in range(size):
        on = width[owner] > i if i else slice(None)
        acc[on] = acc[on] * _M1 + h[at[on] + i]
    acc = mix(acc)
    ends = np.cumsum(many)
    for i, j in zip((ends - many).tolist(), ends.tolist(), strict=True):
        acc[i:j].sort()
    fresh = np.concatenate([[True], (acc[1:] != acc[:-1]) | (owner[1:] != owner[:-1])]) if len(acc) else np.empty(0, bool)
    return acc[fresh], np.bincount(owner[fresh], minlength=len(texts))


#: 64-bit words of the short sketch that candidates of one bucket are compared by.
SHORT = 8


def odd_sketches(values: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """For each set SHORT words of bits that say for each of 64 * SHORT cells whether an odd number of its values falls there."""
    cells = 64 * SHORT
    at = np.repeat(np.arange(len(counts)) * cells, counts) + (mix(values ^ _M3) & np.uint64(cells - 1)).astype(np.int64)
    return np.packbits(np.bincount(at, minlength=cells * len(counts)).astype(np.uint8) & 1, bitorder="little").view(np.int64)


def wide_sketch(values: np.ndarray) -> bytes:
    """The same over at least as many cells as the set has values, a power of two; folding it in halves gives that of fewer cells."""
    cells = 1 << max(9, (len(values) - 1).bit_length() if len(values) else 0)
    return np.packbits(np.bincount((mix(values ^ _M3) & np.uint64(cells - 1)).astype(np.int64), minlength=cells).astype(np.uint8) & 1, bitorder="little").tobytes()


def some_at_a_time(sizes: list[int], most: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """(from, until) of stretches of rows whose sizes add up to about ``most``; a longer row is a stretch of its own."""
    begin, held = 0, 0
    for i, size in enumerate(sizes):
        if held and held + size > most:
            yield begin, i
            begin, held = i, 0
        held += size + 64
    if held:
        yield begin, len(sizes)


def dealt(sig: np.ndarray, ids: pa.Array) -> pa.RecordBatch:
    """(sig, id, bucket): the signature rows of one flush, in two levels where a signature is hot.

    Ids that share a hot signature meet under a signature of their own flush, and only the first of them goes on under the hot one, so no task gets
    all ids of a signature that a third of the documents has. ``bucket`` is the signature that they have in common; null where sig says so itself.
    """
    order = np.argsort(sig, kind="stable")
    run = sig[order]
    start = np.flatnonzero(np.concatenate([[True], run[1:] != run[:-1]]))
    count = np.diff(start, append=len(run))
    hot = np.flatnonzero(count >= HOT)
    if not len(hot):
        return pa.RecordBatch.from_arrays([pa.array(sig.view(np.int64)), ids, pa.nulls(len(sig), pa.int64())], names=["sig", "id", "bucket"])
    rows = np.concatenate([order[start[g] : start[g] + count[g]] for g in hot])
    own = sig.copy()
    # told by the flush's content, so that a task that runs again deals alike
    own[rows] = mix(sig[rows] + mix(np.array([sig.sum(dtype=np.uint64)]))[0]) & np.uint64(0xFFFFFFFFFFFF0000)
    local = np.zeros(len(sig), bool)
    local[rows] = True
    first = order[start[hot]]
    return pa.RecordBatch.from_arrays(
        [
            pa.array(np.concatenate([own, sig[first]]).view(np.int64)), pa.concat_arrays([ids, ids.take(pa.array(first))]),
            pa.array(np.concatenate([sig, sig[first]]).view(np.int64), mask=np.concatenate([~local, np.ones(len(first), bool)])),
        ],
        names=["sig", "id", "bucket"],
    )


#: Rows that a task packs at once, and buckets for each partition of the shuffle; a task of it holds one bucket at a time.
PACKED_ROWS, BUCKETS = 1 << 19, 8
PACKED = "part int, data binary"


def pack(columns: list[np.ndarray], parts: int) -> pa.RecordBatch:
    """(part, data): rows dealt to parts by their first column, a row of bytes for each part: byte by byte of a row, those of all rows together, which packs well."""
    part = (mix(columns[0].view(np.uint64)) % np.uint64(parts)).astype(np.int32)
    order = np.argsort(part, kind="stable")
    # the rows' bytes
    data = np.concatenate([np.ascontiguousarray(c[order]).view(np.uint8).reshape(len(c), c.itemsize) for c in columns], axis=1)
    begin = np.flatnonzero(np.diff(part[order], prepend=-1))
    blobs = [np.ascontiguousarray(data[i:j].T).tobytes() for i, j in zip(begin, np.append(begin[1:], len(part)), strict=True)]
    return pa.RecordBatch.from_arrays([pa.array(part[order][begin], pa.int32()), pa.array(blobs, pa.binary())], names=["part", "data"])


def unpacked(batches: Iterator[pa.RecordBatch], kinds: list[np.dtype]) -> Iterator[list[np.ndarray]]:
    """The columns of each part of (part, data), sorted by part."""
    width = sum(k.itemsize for k in kinds)
    ends = np.cumsum([0, *(k.itemsize for k in kinds)])
    rows = ((p, d) for batch in batches for p, d in zip(batch.column("part").to_pylist(), batch.column("data"), strict=True))
    for _, blobs in groupby(rows, key=lambda r: r[0]):
        data = np.concatenate([np.frombuffer(d.as_buffer(), np.uint8).reshape(width, -1).T for _, d in blobs])
        yield [np.ascontiguousarray(data[:, i:j]).view(k).ravel() for i, j, k in zip(ends, ends[1:], kinds, strict=False)]


def met(rows: DataFrame) -> DataFrame:
    """Packed rows (part, data), those of a part together."""
    return rows.repartition(partitions_of(rows), "part").sortWithinPartitions("part")


def _flat(ids: pa.Array) -> list[np.ndarray]:
    return [c.to_numpy(zero_copy_only=False) for c in (ids.flatten() if pa.types.is_struct(ids.type) else [ids])]


def packed_signatures(signed: Callable, parts: int):
    """The batches (sig, id, bucket) of ``signed``, packed: a row for each of them would cost more than all that is done with it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = []
        n = 0

        def flush() -> pa.RecordBatch:
            return pack([np.concatenate(c) for c in zip(*held, strict=True)], parts)

        for batch in signed(batches):
            sig = batch.column("sig").to_numpy()
            # nothing but zeros where a signature is no local one
            bucket = pc.coalesce(batch.column("bucket"), batch.column("sig")).to_numpy()
            held.append([sig, sig ^ bucket, *_flat(batch.column("id"))])
            n += len(sig)
            if n >= PACKED_ROWS:
                yield flush()
                held, n = [], 0
        if n:
            yield flush()

    return run


def _members(kind: pa.DataType):
    """(sig, id, centre) of the packed signatures of ids: the ids under each signature but for the smallest, their centre; sig is the bucket where there is one, and null for digests."""
    fields = list(kind) if pa.types.is_struct(kind) else []
    kinds = [np.dtype(f.type.to_pandas_dtype()) for f in fields] or [np.dtype(np.int64)]

    def made(columns: list[np.ndarray]) -> pa.Array:
        return pa.StructArray.from_arrays([pa.array(c) for c in columns], fields=fields) if fields else pa.array(columns[0])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for columns in unpacked(batches, [np.dtype(np.int64)] * 2 + kinds):
            order = np.argsort(columns[0])
            run_ = columns[0][order]
            same = run_[1:] == run_[:-1]
            order = order[np.append(same, False) | np.append(False, same)]
            if not len(order):
                continue
            sig, apart, *ids = (c[order] for c in columns)
            order = np.lexsort((*ids[::-1], apart, sig))
            sig, apart, *ids = (c[order] for c in (sig, apart, *ids))
            fresh = np.append(True, (sig[1:] != sig[:-1]) | (apart[1:] != apart[:-1]))
            first = np.flatnonzero(fresh)[np.cumsum(fresh) - 1]
            repeats = np.append(True, np.logical_and.reduce([c[1:] == c[:-1] for c in ids])) | fresh
            keep = ~repeats & np.logical_or.reduce([c != c[first] for c in ids])
            yield pa.RecordBatch.from_arrays([pa.array((sig ^ apart)[keep], mask=(sig[keep] & 1).astype(bool)), made([c[keep] for c in ids]), made([c[first[keep]] for c in ids])], names=["sig", "id", "centre"])

    return run


def digest_rows(keys: list[bytes], ids: pa.Array) -> pa.RecordBatch:
    """(sig, id, bucket): 128-bit digests of one flush as signatures of their own, told by the last bit of sig; both words are compared, so ids that meet are equal.

    Ids with a common digest meet under a digest of their own flush, and only the first of them goes on under the common one, so that no task gets all copies of one text.
    """
    word = np.frombuffer(b"".join(keys), np.uint64).reshape(-1, 2).copy()
    salt = mix(np.array([word.sum(dtype=np.uint64)]))[0]
    order = pc.sort_indices(pa.table({"k": word[:, 0], "c": word[:, 1], "at": np.arange(len(word))}), sort_keys=[("k", "ascending"), ("c", "ascending"), ("at", "ascending")]).to_numpy()
    run = word[order]
    fresh = np.append(True, (run[1:] != run[:-1]).any(1))
    start = np.flatnonzero(fresh)
    several = np.repeat(np.diff(start, append=len(order)) > 1, np.diff(start, append=len(order)))
    local = order[several]
    word = np.concatenate([run[start], mix(run[several] + salt)])
    word[:, 0] |= np.uint64(1)
    return pa.RecordBatch.from_arrays([pa.array(word[:, 0].view(np.int64)), ids.take(pa.array(np.concatenate([order[start], local]))), pa.array((word[:, 0] ^ word[:, 1]).view(np.int64))], names=["sig", "id", "bucket"])


def shared_signatures(signatures: DataFrame, kind: str, name: str) -> DataFrame:
    """(sig, id, centre), saved: for each signature (sig, id, bucket, as of ``dealt`` and ``digest_rows``, packed by ``packed_signatures``; repeats allowed) its ids but for the smallest, the centre. sig is null for digests. kind: the type of ids."""
    id_type = T.StructType.fromDDL(f"id {kind}")["id"].dataType
    return save(met(signatures).mapInArrow(_members(to_arrow_type(id_type)), f"sig bigint, id {kind}, centre {kind}"), name)


def pool_rows(ids: pa.Array, texts: list[bytes], size: int) -> Iterator[pa.RecordBatch]:
    """(id, n, short, wide, text): what candidates are compared by, about a megabyte at a time; texts: words and blanks, A-Z lower-cased."""
    for i, j in some_at_a_time([len(t) for t in texts]):
        values, counts = many_shingles(texts[i:j], size)
        short = pa.ListArray.from_arrays(pa.array(np.arange(j - i + 1, dtype=np.int32) * SHORT), pa.array(odd_sketches(values, counts)))
        wide = pa.array([wide_sketch(v) for v in np.split(values, np.cumsum(counts)[:-1])], pa.binary())
        yield pa.RecordBatch.from_arrays([ids.slice(i, j - i), pa.array(counts, pa.int64()), short, wide, pa.array(texts[i:j], pa.binary()).cast(pa.string())], names=["id", "n", "short", "wide", "text"])


def pool_schema(kind: str) -> str:
    return f"id {kind}, n bigint, short array<bigint>, wide binary, text string"


def _allowed(v: pa.Buffer, w: pa.Buffer, total: int, num: int, den: int) -> bool:
    """Whether wide sketches allow a link of sets with ``total`` values in all."""
    x, y = np.frombuffer(v, np.uint64), np.frombuffer(w, np.uint64)
    while len(x) > len(y):
        x = x[: len(x) // 2] ^ x[len(x) // 2 :]
    while len(y) > len(x):
        y = y[: len(y) // 2] ^ y[len(y) // 2 :]
    return (den + num) * int(np.bitwise_count(x ^ y).sum()) <= (den - num) * total


def _maybe_linked(num: int, den: int):
    """Of (a, b, n, m, v, w) the pairs whose wide sketches v, w allow a link."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            totals = (batch.column("n").to_numpy() + batch.column("m").to_numpy()).tolist()
            maybe = [_allowed(v.as_buffer(), w.as_buffer(), t, num, den) for v, w, t in zip(batch.column("v"), batch.column("w"), totals, strict=True)]
            yield batch.select(["a", "b"]).filter(pa.array(maybe, pa.bool_()))

    return run


def _linked(size: int, num: int, den: int):
    """Of (a, b, x, y) the pairs whose texts x, y are linked."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            xs, ys = batch.column("x"), batch.column("y")
            sizes = [len(x.as_buffer()) + len(y.as_buffer()) if x.is_valid and y.is_valid else 0 for x, y in zip(xs, ys, strict=True)]
            for i, j in some_at_a_time(sizes):
                # a text that several pairs have is worked on once
                place: dict[str, int] = {}
                left, right = ([place.setdefault(t, len(place)) for t in c.slice(i, j - i).to_pylist()] for c in (xs, ys))
                values, counts = many_shingles([t.encode() for t in place], size)
                sets = np.split(values, np.cumsum(counts)[:-1])
                both = np.array([len(np.intersect1d(sets[p], sets[q], assume_unique=True)) for p, q in zip(left, right, strict=True)])
                keep = den * both >= num * (counts[left] + counts[right] - both)
                yield batch.slice(i, j - i).select(["a", "b"]).filter(pa.array(keep))

    return run


class Candidates:
    """Texts that share signatures, and how pairs of them are decided.

    pool: (id, n, short, wide, text), saved; an id may have several texts, any counts. size: words of a shingle.
    """

    def __init__(self, pool: DataFrame, size: int, num: int, den: int, name: str):
        self.pool, self.size, self.num, self.den, self.name = pool, size, num, den, name
        self.kind = pool.schema["id"].dataType.simpleString()

    def _met(self, column: str, one: str, other: str, pairs: DataFrame) -> DataFrame:
        """(a, b, one, other) of the saved pairs (a, b): a column of the pool at either end. Only rows of ids that pairs name move."""
        side = lambda end, *names: self.pool.select(F.col("id").alias(end), *(F.col(c).alias(n) for c, n in names))
        pairs = small(pairs)
        at_b = side("b", ("n", "m"), (column, other)).join(pairs, "b")
        return at_b.join(side("a", ("n", "n"), (column, one)).join(pairs.select("a"), "a", "left_semi"), "a")

    def possible(self, pairs: DataFrame) -> DataFrame:
        """Of the saved pairs (a, b, ...) those whose sizes and short sketches allow a link: a bit that differs stands for a value that only one set holds."""
        side = lambda end, n, s: self.pool.select(F.col("id").alias(end), F.col("n").alias(n), F.col("short").alias(s))
        met = side("b", "m", "t").join(side("a", "n", "s").join(small(pairs), "a"), "b")
        return met.where(self.allowed(lambda i: f"s[{i}]", lambda i: f"t[{i}]")).select(*pairs.columns).distinct()

    def allowed(self, s, t) -> str:
        apart = " + ".join(f"bit_count({s(i)} ^ {t(i)})" for i in range(SHORT))
        return f"{self.den} * least(n, m) >= {self.num} * greatest(n, m) and {self.den + self.num} * ({apart}) <= {self.den - self.num} * (n + m)"

    def linked(self, pairs: DataFrame) -> DataFrame:
        """Of the saved pairs (a, b) those whose sets have den * |both| >= num * |either|: wide sketches decide most that do not; then the texts of b move to those of a."""
        ends = f"a {self.kind}, b {self.kind}"
        met = self._met("wide", "v", "w", pairs.select("a", "b")).select("a", "b", "n", "m", "v", "w")
        near = save(met.mapInArrow(_maybe_linked(self.num, self.den), ends).distinct(), self.name)
        both = self._met("text", "x", "y", near).select("a", "b", "x", "y")
        return save(both.mapInArrow(_linked(self.size, self.num, self.den), ends).distinct(), self.name)

    def sketched(self, rows: DataFrame) -> DataFrame:
        """rows (id, ...) with the sizes n and the short sketches s0, s1, ... of their texts."""
        return rows.join(self.pool.select("id", "n", *(F.get("short", F.lit(i)).alias(f"s{i}") for i in range(SHORT))), "id")

    def pairs_between(self, centres: DataFrame, rows: DataFrame) -> DataFrame:
        """(a, b, c, d) of ids a of centres and b of rows, both sketched (sig, id, c), that share a signature, are in different components and may be linked. Sketches meet in this one join, so what they rule out is never a row."""
        one = centres.withColumnRenamed("id", "a")
        other = rows.select("sig", F.col("id").alias("b"), F.col("c").alias("d"), F.col("n").alias("m"), *(F.col(f"s{i}").alias(f"t{i}") for i in range(SHORT)))
        return one.join(other, "sig").where(f"a <> b and c <> d and {self.allowed(lambda i: f's{i}', lambda i: f't{i}')}").select("a", "b", "c", "d").distinct()

    def pairs_within(self, rows: DataFrame) -> DataFrame:
        """The same for all pairs of rows, each pair once."""
        return self.pairs_between(rows, rows).where("a < b")


def similar_components(members: DataFrame, pool_of: Callable[[DataFrame], DataFrame], size: int, num: int, den: int, name: str) -> DataFrame:
    """(id, component) of ids that share a signature and are linked, directly or over others.

    members: (sig, id, centre) as of ``shared_signatures``, without digests. Two ids with a common signature are a candidate pair. pool_of(ids) gives the
    candidates' texts with their sketches; they are written once and all comparisons read them there.
    First each id is checked against one centre only, the smallest id of most of its buckets; that
    joins nearly all true copies without listing the pairs of a group. Then against its other centres. Then, in buckets that still hold several
    components, against a few ids drawn from the bucket, and again against a few of its largest component; so the many ids of one
    group fall into one component without pairs of all of them. What is then still apart is compared in full, so no link that joins two
    components is lost whatever the sizes of the buckets.
    """
    ids = save(members.select("id").unionByName(members.select(F.col("centre").alias("id"))).distinct(), name)
    pool = save(pool_of(ids), f"{name}-pool")
    own = Candidates(pool, size, num, den, name)

    shared = save(members.groupBy("id", "centre").agg(F.count(F.lit(1)).alias("n")), name)
    stars = save(shared.groupBy("id").agg(F.min(F.struct(-F.col("n"), F.col("centre"))).alias("m")).select(F.col("m.centre").alias("a"), F.col("id").alias("b")), name)
    found = save(connected_components(own.linked(stars), name), name)

    known = small(found.select("id", "component"))
    placed = known.select("id", F.col("component").alias("c"))
    centres = known.select(F.col("id").alias("centre"), F.col("component").alias("d"))
    at = lambda rows: rows.join(placed, "id", "left").join(centres, "centre", "left").withColumns({"c": F.coalesce("c", "id"), "d": F.coalesce("d", "centre")})
    others = save(at(shared.select("id", "centre").join(stars.select(F.col("a").alias("centre"), F.col("b").alias("id")), ["id", "centre"], "left_anti")).where("c <> d").select(F.col("centre").alias("a"), F.col("id").alias("b"), F.col("d").alias("c"), F.col("c").alias("d")), name)

    edges: list[DataFrame] = []
    moved: DataFrame | None = None

    def compared(pairs: DataFrame) -> None:
        """Pairs (a, b, c, d) that are linked join their components c and d."""
        nonlocal moved
        near = save(pairs, name)
        if near.isEmpty():
            return
        new = save(near.join(small(own.linked(near)), ["a", "b"]).select(F.col("c").alias("a"), F.col("d").alias("b")).distinct(), name)
        if not new.isEmpty():
            edges.append(new)
            moved = small(save(connected_components(reduce(DataFrame.unionByName, edges), name), name))

    def now(rows: DataFrame, column: str = "c") -> DataFrame:
        """rows with their components after all merges so far."""
        if moved is None:
            return rows
        return rows.join(moved.select(F.col("id").alias(column), F.col("component").alias("__to")), column, "left").withColumn(column, F.coalesce("__to", column)).drop("__to")

    if not others.isEmpty():
        compared(own.possible(others))
    # buckets of two are settled now; of the others, those in several components are read on
    rows = now(now(at(members), "c"), "d")
    stats = rows.groupBy("sig").agg(F.count_if(F.col("c") != F.col("d")).alias("apart"), F.count(F.lit(1)).alias("n"), F.min("centre").alias("one"), F.max("centre").alias("last"))
    mixed = save(stats.where("apart > 0 and n > 1").select("sig", (F.col("one") == F.col("last")).alias("single")), name)
    within = save(rows.join(small(mixed), "sig").select("sig", "id", "c", "centre", "d", "single"), name)
    # a bucket's only centre has met all its ids
    open_ = save(own.sketched(within.select("sig", "id", "c").unionByName(within.where("not single").select("sig", F.col("centre").alias("id"), F.col("d").alias("c"))).distinct()), name)
    listed = 0
    for turn, centres_drawn in enumerate(CENTRES):
        drawn = [F.min(F.struct(F.xxhash64("id", F.lit(100 * turn + i)), F.col("id").alias("id"), F.col("c").alias("d"))).alias(f"z{i}") for i in range(centres_drawn)]
        parts = open_.groupBy("sig", *["c"] * bool(turn)).agg(F.min("c").alias("low"), F.max("c").alias("high"), F.count(F.lit(1)).alias("n"), *drawn)
        if turn:  # the centres of the largest component
            zs = F.max_by(F.struct(*(f"z{i}" for i in range(centres_drawn))), F.struct("n", "low")).alias("z")
            parts = parts.groupBy("sig").agg(F.min("low").alias("low"), F.max("high").alias("high"), F.sum("n").alias("n"), zs).select("sig", "low", "high", "n", "z.*")
        buckets = save(parts.where("low < high").select("sig", "n", F.array_distinct(F.array(*(F.struct(f"z{i}.id", f"z{i}.d") for i in range(centres_drawn)))).alias("zs")), name)
        listed = buckets.agg(F.coalesce(F.sum(F.col("n") * (F.col("n") - 1) / 2), F.lit(0))).first()[0]
        if listed <= FEW_PAIRS:
            break
        centres = own.sketched(buckets.select("sig", F.explode("zs").alias("z")).select("sig", F.col("z.id").alias("id"), F.col("z.d").alias("c")))
        compared(own.pairs_between(save(centres, name), open_))
        open_ = save(now(only_ids(open_, buckets.select("sig"), "sig")), name)
    if listed:
        compared(own.pairs_within(open_))
    if moved is None:
        return found
    return save(now(found.withColumnRenamed("component", "c")).withColumnRenamed("c", "component").unionByName(moved.join(found, "id", "left_anti")), name)
