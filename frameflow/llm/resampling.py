"""Importance resampling towards a target distribution: hashed word runs score documents, sorted runs are merged by tournament trees."""

from __future__ import annotations

import hashlib
import math
import tempfile
from collections.abc import Iterable, Iterator
from functools import cache
from itertools import chain, islice
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from frameflow.llm.common import LOWER_ALNUM, partitions_of, save, table

BUCKETS, MIN_WORDS, PERCENT, SEED = 10_000, 20, 25, 7
#: Texts are worked on so many bytes at a time; a longer text goes through in pieces.
_PIECE = 1 << 20
#: Words of up to so many bytes are hashed by tables, longer ones by themselves.
_LONGEST = 64
#: A sorted run holds at most so many documents; a tree merges at most so many runs at once, and reads so many records of each ahead.
RUN_ROWS, FAN_IN, _AHEAD = 1 << 20, 128, 512
#: A range of scores holds about so many drawn documents at most.
RANGE_ROWS = 1 << 20
#: Scores are sums of logarithms of 64-bit counts and of a noise of 32 bits, times 1000: fewer than 2^17 whole numbers.
_MAX_SCORES = 1 << 18
#: Bytes of a range's runs kept in memory; beyond, they are in a file of the task.
_SPOOL = 64 << 20


@cache
def _onward() -> np.ndarray:
    """[n, place, byte]: what a CRC's byte at a place turns into over n more bytes, apart from what these bytes are: CRC-32 is linear over bits."""
    bits = np.array([[crc32(bytes(n), 1 << b) ^ crc32(bytes(n)) for b in range(32)] for n in range(_LONGEST + 1)], np.uint32).reshape(_LONGEST + 1, 4, 8)
    byte = np.arange(256)
    return np.bitwise_xor.reduce(np.where(byte[:, None] >> np.arange(8) & 1, bits[:, :, None, :], 0), axis=3).astype(np.uint32)


def _pieces(text: str | None) -> Iterator[list[bytes]]:
    """The words of a text, in lists; each list but the first begins with the last word of the one before."""
    data = (text or "").encode().translate(LOWER_ALNUM)
    at, last = 0, []
    while at < len(data):
        cut = data.find(b" ", at + _PIECE) if at + _PIECE < len(data) else -1
        words = data[at : cut if cut >= 0 else len(data)].split()
        at = cut if cut >= 0 else len(data)
        if words:
            yield last + words
            last = words[-1:]


def _hashed(lists: list[list[bytes]], first: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Lists of words -> the buckets of all their words and pairs, and the list that each belongs to. A list that isn't a text's first doesn't count its first word."""
    flat = list(chain.from_iterable(lists))
    if not flat:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    sizes = np.array([len(x) for x in lists])
    ids = {w: i for i, w in enumerate(dict.fromkeys(flat))}
    at = np.fromiter(map(ids.__getitem__, flat), np.int64, len(flat))
    own = np.fromiter(map(crc32, ids), np.uint32, len(ids))
    spaced = np.fromiter((crc32(b" ", c) for c in own.tolist()), np.uint32, len(ids))
    length = np.fromiter(map(len, ids), np.int64, len(ids))
    of = np.repeat(np.arange(len(lists)), sizes)
    begins = np.zeros(len(flat), bool)
    begins[(np.cumsum(sizes) - sizes)[sizes > 0]] = True
    a, b = at[:-1][~begins[1:]], at[1:][~begins[1:]]
    n, c, tables = np.minimum(length[b], _LONGEST), spaced[a], _onward()
    pair = own[b] ^ tables[n, 0, c & 255] ^ tables[n, 1, c >> 8 & 255] ^ tables[n, 2, c >> 16 & 255] ^ tables[n, 3, c >> 24]
    long = np.flatnonzero(length[b] > _LONGEST)
    if len(long):
        words = list(ids)
        pair[long] = [crc32(words[w], int(s)) for w, s in zip(b[long], c[long], strict=True)]
    single = ~begins | first[of]
    return np.concatenate([own[at[single]], pair]).astype(np.int64) % buckets, np.concatenate([of[single], of[1:][~begins[1:]]])


def _chunks(texts: Iterable[str | None]) -> Iterator[tuple[list[list[bytes]], np.ndarray, list[int]]]:
    """(lists of words, whether each is its text's first, the text's number): about a piece's size at a time."""
    lists, first, of, size = [], [], [], 0
    for i, text in enumerate(texts):
        for k, words in enumerate(_pieces(text)):
            lists.append(words)
            first.append(k == 0)
            of.append(i)
        size += len(text or "")
        if size >= _PIECE:
            yield lists, np.array(first, bool), of
            lists, first, of, size = [], [], [], 0
    if lists:
        yield lists, np.array(first, bool), of


def bucket_counts(texts: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """texts (text) -> bucket, n: how many words and pairs of neighbouring words of all texts fall into it. A task adds its own up before the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for lists, first, _ in _chunks(t.as_py() for t in batch.column(0)):
                total += np.bincount(_hashed(lists, first, buckets)[0], minlength=buckets)
        held = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(held, pa.int64()), pa.array(total[held])], names=["bucket", "n"])

    return texts.select("text").mapInArrow(run, "bucket bigint, n bigint").groupBy("bucket").agg(F.sum("n").alias("n"))


def bucket_gains(docs: DataFrame, target: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """floor(1000 ln) of the ratio of the smoothed shares of each bucket in the target's and in all documents' features. As many numbers as buckets, whatever the input."""
    s, t = ({r.bucket: r.n for r in bucket_counts(x, buckets).collect()} for x in (docs, target))
    all_s, all_t = sum(s.values()), sum(t.values())
    return np.array([math.floor(1000 * math.log((t.get(b, 0) + 1) * (all_s + buckets) / ((s.get(b, 0) + 1) * (all_t + buckets)))) for b in range(buckets)], np.int64)


def noise(doc_id: int | None, seed: int = SEED) -> int:
    """floor(1000 times a Gumbel variate) that the id decides; a null id counts as an empty one."""
    h = int(hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def scores(docs: DataFrame, gains: np.ndarray, seed: int = SEED) -> DataFrame:
    """docs (doc_id, text) -> doc_id, n_words, n_features, weight, score. The gains are an array of fixed length, sent to all tasks."""
    sent, buckets = docs.sparkSession.sparkContext.broadcast(gains), len(gains)
    names = ["doc_id", "n_words", "n_features", "weight", "score"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gain = sent.value
        for batch in batches:
            words, features, total = (np.zeros(batch.num_rows, np.int64) for _ in range(3))
            for lists, first, of in _chunks(t.as_py() for t in batch.column(1)):
                hashed, own = _hashed(lists, first, buckets)
                text = np.array(of, np.int64)
                np.add.at(words, text, np.array([len(x) for x in lists]) - ~first)
                upto = np.zeros(len(lists), np.int64)
                np.add.at(upto, own, gain[hashed])
                np.add.at(total, text, upto)
                np.add.at(features, text, np.bincount(own, minlength=len(lists)))
            weight = total // np.maximum(features, 1)
            drawn = np.fromiter((noise(d, seed) for d in batch.column(0).to_pylist()), np.int64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), *map(pa.array, (words, features, weight, weight + drawn))], names=names)

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, ", ".join(f"{n} bigint" for n in names))


class Tournament:
    """The least of several sorted streams first: a tree of winners, one path of which is played anew for each record taken."""

    _END = (math.inf,)

    def __init__(self, streams: list[Iterator[tuple]]):
        self.streams = streams
        self.size = 1 << max(0, (len(streams) - 1).bit_length())
        self.heads = [next(s, self._END) for s in streams] + [self._END] * (self.size - len(streams))
        self.tree = [0] * self.size + list(range(self.size))
        for node in range(self.size - 1, 0, -1):
            self._play(node)

    def _play(self, node: int) -> None:
        left, right = self.tree[2 * node], self.tree[2 * node + 1]
        self.tree[node] = left if self.heads[left] <= self.heads[right] else right

    def __iter__(self) -> Iterator[tuple]:
        return self

    def __next__(self) -> tuple:
        won = self.tree[1] if self.size > 1 else 0
        out = self.heads[won]
        if out is self._END:
            raise StopIteration
        self.heads[won] = next(self.streams[won], self._END)
        node = (won + self.size) // 2
        while node:
            self._play(node)
            node //= 2
        return out


class Runs:
    """Sorted runs of records of whole numbers, kept in a file of the task once they are large."""

    def __init__(self, fields: int):
        self.fields, self.file, self.runs = fields, tempfile.SpooledTemporaryFile(max_size=_SPOOL), []  # noqa: SIM115

    def add(self, records: np.ndarray, new: bool) -> None:
        """records (n, fields) go on with the last run or begin a new one."""
        self.file.seek(0, 2)
        if new or not self.runs:
            self.runs.append([self.file.tell(), 0])
        self.runs[-1][1] += len(records)
        self.file.write(np.ascontiguousarray(records, np.int64).tobytes())

    def _read(self, start: int, n: int) -> Iterator[tuple]:
        wide = 8 * self.fields
        for i in range(0, n, _AHEAD):
            self.file.seek(start + i * wide)
            data = self.file.read(min(_AHEAD, n - i) * wide)
            yield from map(tuple, np.frombuffer(data, np.int64).reshape(-1, self.fields).tolist())

    def merged(self) -> Tournament:
        """All records in order. More runs than a tree takes are first merged, group by group, into longer runs."""
        runs = self
        while len(runs.runs) > FAN_IN:
            longer = Runs(self.fields)
            for i in range(0, len(runs.runs), FAN_IN):
                tree, new = Tournament([runs._read(*r) for r in runs.runs[i : i + FAN_IN]]), True
                while some := list(islice(tree, 8 * _AHEAD)):
                    longer.add(np.array(some, np.int64), new)
                    new = False
            runs.file.close()
            runs = longer
        return Tournament([runs._read(*r) for r in runs.runs])


_RUN = ["range", "run", "pos", "down", "blank", "doc_id", "n_features", "weight"]


def _sorted_runs(tops: list[int]):
    """Rows (doc_id, n_features, weight, score) -> runs in order: score down, then doc_id (null last), in ranges that end above the next of tops."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        limits, no, held, size = np.array(tops, np.int64), 0, [], 0

        def flush() -> pa.RecordBatch:
            rows = np.concatenate(held)
            rows = rows[np.lexsort(rows.T[::-1])]
            range_ = np.searchsorted(limits, rows[:, 0], "right") - 1
            run_id = np.full(len(rows), TaskContext.get().partitionId() * 1_000_000 + no)
            return pa.RecordBatch.from_arrays(list(map(pa.array, (range_, run_id, np.arange(len(rows)), *rows.T))), names=_RUN)

        for batch in batches:
            ids = batch.column(0)
            columns = [c.to_numpy(zero_copy_only=False) for c in batch.columns[1:]]
            held.append(np.stack([-columns[2], ids.is_null().to_numpy(zero_copy_only=False).astype(np.int64), ids.fill_null(0).to_numpy(), columns[0], columns[1]], axis=1))
            size += batch.num_rows
            if size >= RUN_ROWS:
                yield flush()
                no, held, size = no + 1, [], 0
        if size:
            yield flush()

    return run


def _ranked(offsets: list[int], draw: int):
    """Runs of ranges, one after another -> doc_id, n_features, weight, score, rank; a tree stops when its range has given what is to be drawn."""

    def rows(records: list[tuple], first: int | None) -> pa.RecordBatch:
        down, blank, doc, features, weight = np.array(records, np.int64).T
        ranks = pa.nulls(len(records), pa.int64()) if first is None else pa.array(np.arange(first, first + len(records)))
        return pa.RecordBatch.from_arrays([pa.array(doc, mask=blank == 1), pa.array(features), pa.array(weight), pa.array(-down), ranks], names=["doc_id", "n_features", "weight", "score", "rank"])

    def done(range_: int, runs: Runs) -> Iterator[pa.RecordBatch]:
        tree, at = runs.merged(), offsets[range_]
        while at < draw and (some := list(islice(tree, min(8 * _AHEAD, draw - at)))):
            yield rows(some, at + 1)
            at += len(some)
        rest = chain([h for h in tree.heads if h is not tree._END], *tree.streams)  # beyond the draw: in no order
        while some := list(islice(rest, 8 * _AHEAD)):
            yield rows(some, None)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        range_, last, runs = None, None, Runs(5)
        for batch in batches:
            columns = [c.to_numpy() for c in batch.columns]
            records = np.stack(columns[3:], axis=1)
            cuts = np.flatnonzero((np.diff(columns[0]) != 0) | (np.diff(columns[1]) != 0)) + 1
            for lo, hi in zip([0, *cuts.tolist()], [*cuts.tolist(), len(records)], strict=True):
                if lo == hi:
                    continue
                now = int(columns[0][lo]), int(columns[1][lo])
                if range_ is not None and now[0] != range_:
                    yield from done(range_, runs)
                    runs = Runs(5)
                runs.add(records[lo:hi], now != last)
                range_, last = now[0], now
        if range_ is not None:
            yield from done(range_, runs)

    return run


def draw(scored: DataFrame, percent: int = PERCENT, min_words: int = MIN_WORDS) -> DataFrame:
    """scored (doc_id, n_words, n_features, weight, score) -> all rows with rank: of those with min_words the floor(percent * N / 100) highest scores, 1 first; null for the others.

    The counts of each whole-number score, which are few whatever N is, tell below which score nothing is drawn; only rows at or above it are
    sorted, as runs of each partition, and dealt by ranges of scores. A range's runs are merged in one task, which knows how many rows stand
    before it. Noise spreads the scores: of any number of distinct ids at most one in 2,700 is expected at one score. ``scored`` is read several times: save it first.
    """
    good = scored.where(F.col("n_words") >= min_words)
    counts = {r.score: r.n for r in good.groupBy("score").agg(F.count(F.lit(1)).alias("n")).limit(_MAX_SCORES + 1).collect()}
    if len(counts) > _MAX_SCORES:
        raise ValueError(f"more than {_MAX_SCORES} different scores")
    wanted, upto, per, tops, offsets = percent * sum(counts.values()) // 100, 0, 0, [], []
    size = max(1, min(RANGE_ROWS, wanted // (2 * partitions_of(scored))))
    lowest = None
    for score in sorted(counts, reverse=True):
        if upto >= wanted:
            break
        if not tops or per >= size:
            tops.append(-score)
            offsets.append(upto)
            per = 0
        upto, per, lowest = upto + counts[score], per + counts[score], score
    plain = ["doc_id", "n_features", "weight", "score"]
    if lowest is None:
        return scored.select(*plain, F.lit(None).cast("long").alias("rank"))
    can = (F.col("n_words") >= min_words) & (F.col("score") >= lowest)
    runs = scored.where(can).select(*plain).mapInArrow(_sorted_runs(tops), ", ".join(f"{c} bigint" for c in _RUN))
    dealt = runs.repartition(partitions_of(scored), "range").sortWithinPartitions("range", "run", "pos")
    ranked = dealt.mapInArrow(_ranked(offsets, wanted), "doc_id bigint, n_features bigint, weight bigint, score bigint, rank bigint")
    return ranked.unionByName(scored.where(~can).select(*plain, F.lit(None).cast("long").alias("rank")))


def resample(docs: DataFrame, target: DataFrame, percent: int = PERCENT, min_words: int = MIN_WORDS, buckets: int = BUCKETS, seed: int = SEED) -> DataFrame:
    """docs (doc_id, text), target (text) -> doc_id, n_features, weight, score and rank of each document; those with a rank are the sample.

    Null and empty texts have no features, weight 0 and no rank. Rows that repeat a doc_id are documents each, with the same noise; equal
    scores go by doc_id (null last), then features. Without documents there are no rows; without a target all buckets' targets are
    the smoothing alone. Other columns are ignored. Whole texts are read twice and never shuffled.
    """
    scored = save(scores(docs, bucket_gains(docs, target, buckets), seed), "scored")
    return draw(scored, percent, min_words)


def op11_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


OP11_SQL = r"""
WITH texts AS (
  SELECT 'd' AS kind, doc_id, translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents
  UNION ALL SELECT 'b', item_id, translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') FROM benchmark
), words AS (
  SELECT kind, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM texts
), features AS (
  SELECT kind, doc_id, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) AS f FROM words
), named AS (
  SELECT f, hex(encode(f)) AS h FROM (SELECT DISTINCT f FROM features)
), hashed AS (
  SELECT f, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(1, length(h), 2), lambda i: (strpos('0123456789ABCDEF', h[i]) * 16 + strpos('0123456789ABCDEF', h[i + 1]) - 17)::BIGINT)),
    lambda c, x: list_reduce(list_prepend(xor(c, x), range(8)), lambda a, i: xor(a >> 1, 3988292384 * (a & 1)))), 4294967295) % 10000 AS bucket FROM named
), counted AS (
  SELECT bucket, count(*) FILTER (kind = 'd') AS s, count(*) FILTER (kind = 'b') AS t FROM features JOIN hashed USING (f) GROUP BY bucket
), gains AS (
  SELECT bucket, floor(1000 * ln((t + 1)::DOUBLE * (sum(s) OVER () + 10000) / ((s + 1) * (sum(t) OVER () + 10000))))::BIGINT AS gain FROM counted
), weights AS (
  SELECT doc_id, count(*) AS n_features, floor(sum(gain)::DOUBLE / count(*))::BIGINT AS weight FROM features JOIN hashed USING (f) JOIN gains USING (bucket) WHERE kind = 'd' GROUP BY doc_id
), scored AS (
  SELECT doc_id, len(w) AS n_words, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight,
    coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || sha256('7:' || doc_id)[:8])::BIGINT + 0.5::DOUBLE) / 4294967296)))::BIGINT AS score
  FROM words LEFT JOIN weights USING (doc_id) WHERE kind = 'd'
), ranked AS (
  SELECT *, CASE WHEN n_words >= 20 THEN row_number() OVER (PARTITION BY n_words >= 20 ORDER BY score DESC, doc_id) END AS r FROM scored
)
SELECT doc_id, n_features, weight, score, CASE WHEN r <= 25 * (SELECT count(*) FROM scored WHERE n_words >= 20) // 100 THEN r END AS rank FROM ranked
"""
