"""Substring dedup: MinHash banding over paragraphs, exact Jaccard, removals by connected components; passages inside paragraphs by content-defined pieces."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from frameflow.llm.common import LOWER_BLANK, partitions_of, phase, save, table
from frameflow.llm.components import connected_components
from frameflow.llm.simjoin import _M1, BROADCAST_IDS, BUCKETS, PACKED, PACKED_ROWS, dealt, digest_rows, met, mix, pack, packed_signatures, pool_rows, pool_schema, shared_signatures, similar_components, small, unpacked, word_hashes

#: A pair at a similarity of 0.8 meets in one of 14 bands of 3 rows with probability 0.99996.
BANDS, ROWS = 14, 3
SHINGLE, NUM, DEN = 5, 4, 5
#: Shorter paragraphs are not banded: headings, list items and notices recur in documents that share nothing else.
MIN_WORDS = 20
#: A cut stands where the value of two neighbouring words is the least within so many words on either side, so it depends on these words alone.
REACH = 4
#: A piece reaches from a cut to the first cut that is so many words on.
PIECE_WORDS = 24
#: Where no value is the least over a stretch of more than twice this many words (a word repeated on and on), cuts stand at this distance.
STEP = 12
#: A piece that recurs so often among those that a task packs at once is dealt in two levels.
HOT_PIECES = 64
#: How words are valued for cuts: fixed numbers that the SQL has too.
CUT_FACTOR, CUT_PRIME, CUT_SPREAD, CUT_RANGE = 40503, 1000003, 2654435761, 2**32

#: A paragraph is named by its document and its number there.
ID = "struct<doc:bigint,no:int>"
_SEEDS = mix(np.arange(1, BANDS * ROWS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)
#: Bytes of text that are signed at once.
_BATCH = 1 << 20
_FULL = np.int64(1) << np.int64(40)
# two polynomials over the words' hashes tell pieces apart by 128 bits; sums from the start are moved to a piece's start by the inverse
_BASES = tuple((m, np.uint64(pow(int(m), -1, 2**64))) for m in (_M1, np.uint64(0xD6E8FEB86659FD93)))


def paragraphs(text: str | None, min_words: int) -> Iterator[tuple[int, bytes]]:
    """(number, words joined by blanks) of the paragraphs (between line ends) with enough words; numbers count all paragraphs."""
    for no, line in enumerate(text.encode().split(b"\n") if text else ()):
        if len(line) >= 2 * min_words - 1 and len(w := line.translate(LOWER_BLANK).split()) >= min_words:
            yield no, b" ".join(w)


def _ids(docs: list[int], nos: list[int]) -> pa.Array:
    return pa.StructArray.from_arrays([pa.array(docs, pa.int64()), pa.array(nos, pa.int32())], ["doc", "no"])


def band_signatures(texts: list[bytes]) -> np.ndarray:
    """A row of BANDS 48-bit signatures for each paragraph, given as words joined by blanks; all are worked on at once. Short ones are filled up to a shingle."""
    texts = [t + b" \0" * max(0, SHINGLE - 1 - t.count(b" ")) for t in texts]
    h = word_hashes(b" ".join(texts))
    count = np.array([t.count(b" ") + 1 for t in texts])
    ends = np.cumsum(count)
    # shingles at every word; those that reach into the next paragraph stand between an end and a start
    acc = np.zeros(len(h) - SHINGLE + 1, np.uint64)
    for i in range(SHINGLE):
        acc = acc * _M1 + h[i : i + len(acc)]
    acc = mix(acc)
    at = np.stack([ends - count, ends - SHINGLE + 1], axis=1).ravel()[:-1]
    # shingles are random values already, so a product with an odd seed is order enough
    least = np.stack([np.minimum.reduceat(acc * seed, at)[::2] for seed in _SEEDS])
    rows = np.repeat(np.arange(BANDS, dtype=np.uint64)[:, None], len(texts), axis=1)
    for r in range(ROWS):
        rows = mix(rows * _M1 + least[r::ROWS])
    # zero bytes take no room in the shuffle, and a chance collision only adds a candidate
    return rows.T & np.uint64(0xFFFFFFFFFFFF0000)


def _signed(min_words: int):
    """Band rows of paragraphs, a text met again by the same task signs only once; and digest rows of all."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()
        words: list[bytes] = []
        signs: list[bool] = []
        keys: list[bytes] = []
        docs: list[int] = []
        nos: list[int] = []
        held = 0

        def flush() -> Iterator[pa.RecordBatch]:
            yield digest_rows(keys, _ids(docs, nos))
            if words:
                of = np.repeat(np.flatnonzero(signs), BANDS)
                yield dealt(band_signatures(words).ravel(), _ids(np.array(docs, np.int64)[of], np.array(nos, np.int32)[of]))

        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                for no, w in paragraphs(text.as_py(), min_words):
                    key = xxhash.xxh3_128_digest(w)
                    fresh = key not in seen
                    signs.append(fresh)
                    keys.append(key)
                    docs.append(doc)
                    nos.append(no)
                    held += 64
                    if fresh:
                        seen.add(key)
                        words.append(w)
                        held += len(w)
                    if held >= _BATCH:
                        yield from flush()
                        words, signs, keys, docs, nos, held = [], [], [], [], [], 0
        if docs:
            yield from flush()

    return run


def _pooled(min_words: int):
    """Of (doc_id, text, nos) the paragraphs that are wanted, with what they are compared by."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            docs: list[int] = []
            nos: list[int] = []
            words: list[bytes] = []
            for doc, text, wanted in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist(), strict=True):
                wanted = set(wanted)
                for no, w in paragraphs(text.as_py(), min_words):
                    if no in wanted:
                        docs.append(doc)
                        nos.append(no)
                        words.append(w)
                if len(words) >= 512:
                    yield from pool_rows(_ids(docs, nos), words, SHINGLE)
                    docs, nos, words = [], [], []
            if words:
                yield from pool_rows(_ids(docs, nos), words, SHINGLE)

    return run


def near_paragraphs(texts: DataFrame, min_words: int) -> DataFrame:
    """texts (doc_id, text) -> (id, component): the paragraphs in a cluster of two or more, each with the smallest of its cluster. Only this table stays; those on the way to it are deleted."""
    with phase(texts.sparkSession):
        return save(_clusters(texts, min_words), "paragraph-clusters", stays=True)


def _clusters(texts: DataFrame, min_words: int) -> DataFrame:
    signed = texts.mapInArrow(packed_signatures(_signed(min_words), BUCKETS * partitions_of(texts)), PACKED)

    members = shared_signatures(signed, ID, "paragraph")

    def pool_of(ids: DataFrame) -> DataFrame:
        # the documents that hold wanted paragraphs; then only those paragraphs are cut out
        wanted = save(ids.groupBy(F.col("id.doc").alias("doc_id")).agg(F.collect_list("id.no").alias("nos")), "wanted")
        size = wanted.agg(F.coalesce(F.sum(F.size("nos") + 2), F.lit(0))).first()[0]
        have = texts.join(F.broadcast(wanted) if size <= BROADCAST_IDS else wanted, "doc_id").select("doc_id", "text", "nos")
        return have.mapInArrow(_pooled(min_words), pool_schema(ID))

    linked = save(similar_components(members.where("sig IS NOT NULL"), pool_of, SHINGLE, NUM, DEN, "paragraph"), "paragraph-links")
    edges = members.where("sig IS NULL").selectExpr("centre a", "id b").unionByName(linked.selectExpr("component a", "id b")).where("a <> b")
    return connected_components(edges, "paragraph-clusters")


def word_cuts(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Where texts are cut, as ascending word numbers. data: bytes of the texts, A-Z lower-cased; starts, ends: of the words in it; first: the number of each text's first word, and that of all words.

    A text's ends are cuts. Word i begins a piece if the value of words i - 1 and i is less than those of the REACH words before and not above those of the REACH words after, as far as
    they are of the same text. A word is valued by its bytes' number, the first and the last; stretches without such a place are cut every STEP words.
    """
    w = np.minimum(ends - starts, 999) * 65536 + data[starts].astype(np.int64) * 256 + data[ends - 1]
    # between texts there is room for the reach, filled with a value that is never the least
    at = np.arange(len(w)) + REACH * np.repeat(np.arange(1, len(first)), np.diff(first))
    wide = np.full(len(w) + REACH * len(first), _FULL)
    wide[at[1:]] = (w[:-1] * CUT_FACTOR + w[1:]) % CUT_PRIME * CUT_SPREAD % CUT_RANGE
    wide[at[first[:-1][np.diff(first) > 0]]] = _FULL
    v, before, after = wide[at], wide[at - 1], wide[at + 1]
    for k in range(2, REACH + 1):
        before, after = np.minimum(before, wide[at - k]), np.minimum(after, wide[at + k])
    cuts = np.union1d(np.flatnonzero((v < before) & (v <= after)), first)
    far = np.flatnonzero(np.diff(cuts) > 2 * STEP)
    if len(far):
        cuts = np.sort(np.concatenate([cuts, *(np.arange(cuts[i] + STEP, cuts[i + 1] - STEP + 1, STEP) for i in far)]))
    return cuts


def _powers(base: np.uint64, n: int) -> np.ndarray:
    return np.cumprod(np.concatenate([[np.uint64(1)], np.full(n, base)]))


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[list[np.ndarray]]:
    """[key, check, doc_id, from, until] of the pieces of whole texts, many texts at a time; from, until are code points."""
    powers = [[_powers(b, 1 << 10) for b in pair] for pair in _BASES]
    docs: list[int] = []
    texts: list[bytes] = []
    held = 0

    def flush() -> list[np.ndarray]:
        lower = b" ".join(texts)
        data = np.frombuffer(lower, np.uint8)
        at = np.flatnonzero(data != 32)
        gaps = np.flatnonzero(np.diff(at) > 1)
        starts, ends = np.concatenate([at[:1], at[gaps + 1]]), np.concatenate([at[gaps] + 1, at[-1:] + 1])
        begin = np.cumsum([0, *(len(t) + 1 for t in texts)])[:-1]
        first = np.append(np.searchsorted(starts, begin), len(starts))
        cuts = word_cuts(data, starts, ends, first)
        until = np.searchsorted(cuts, cuts + PIECE_WORDS)
        one, other = cuts[until < len(cuts)], cuts[until[until < len(cuts)]]
        owner = np.searchsorted(first, one, "right") - 1
        inside = other <= first[owner + 1]
        one, other, owner = one[inside], other[inside], owner[inside]
        h = word_hashes(lower)
        keys = []
        for pair, bases in zip(powers, _BASES, strict=True):
            if len(pair[0]) <= len(h):
                pair[:] = [_powers(b, 2 * len(h)) for b in bases]
            sums = np.concatenate([[np.uint64(0)], np.cumsum(h * pair[0][: len(h)])])
            keys.append(mix((sums[other] - sums[one]) * pair[1][one]).view(np.int64))
        # bytes that start a character, counted up to each place and from the text's own start
        chars = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
        base = chars[begin][owner]
        return [*keys, np.array(docs, np.int64)[owner], (chars[starts[one]] - base).astype(np.int32), (chars[ends[other - 1]] - base).astype(np.int32)]

    for batch in batches:
        for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            lower = (text.as_py() or "").encode().translate(LOWER_BLANK)
            if len(lower) >= 2 * PIECE_WORDS - 1 and not lower.isspace():
                docs.append(doc)
                texts.append(lower)
                held += len(lower)
            if held >= _BATCH:
                yield flush()
                docs, texts, held = [], [], 0
    if held:
        yield flush()


def packed_pieces(columns: list[np.ndarray], parts: int) -> pa.RecordBatch:
    """Pieces [key, check, doc_id, from, until], packed, in two levels where a piece is hot.

    The places of a hot piece go on under a key of these rows' own; only two rows go on under the piece's key, for the first and the last document here, which
    name that own key and have no place (from is -1). So no task gets all places of a passage that a third of the documents holds.
    """
    key, check, docs = columns[:3]
    none = np.zeros(len(key), np.int64)
    columns = [*columns, none, none]
    order = np.lexsort((docs, check, key))
    start = np.flatnonzero(np.append(True, (np.diff(key[order]) != 0) | (np.diff(check[order]) != 0)))
    count = np.diff(start, append=len(order))
    hot = count >= HOT_PIECES
    if not hot.any():
        return pack(columns, parts)
    # told by the rows' content, so that a task that runs again deals alike
    salt = mix(np.array([key.view(np.uint64).sum(dtype=np.uint64)]))[0]
    own = [np.where(v == 0, 1, v) for v in (mix(c[order][start[hot]].view(np.uint64) + salt).view(np.int64) for c in (key, check))]
    first, last = order[start[hot]], order[(start + count - 1)[hot]]
    ends = np.concatenate([first, last])
    local = order[np.repeat(hot, count)]
    far = np.full(len(ends), -1, np.int32)
    heads = [key[ends], check[ends], docs[ends], far, far, *(np.tile(o, 2) for o in own)]
    columns = [c.copy() for c in columns]
    for into, o in zip(((0, 5), (1, 6)), own, strict=True):
        for c in into:
            columns[c][local] = np.repeat(o, count[hot])
    return pack([np.concatenate(c) for c in zip(columns, heads, strict=True)], parts)


def _cut(parts: int):
    """The pieces of texts, packed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = []
        n = 0
        for columns in _pieces(batches):
            held.append(columns)
            n += len(columns[0])
            if n >= PACKED_ROWS:
                yield packed_pieces([np.concatenate(c) for c in zip(*held, strict=True)], parts)
                held, n = [], 0
        if n:
            yield packed_pieces([np.concatenate(c) for c in zip(*held, strict=True)], parts)

    return run


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, from, until, least, own, check) of packed pieces: the places of pieces that several documents hold, with the smallest of these documents.

    Where own is set, the piece is hot: its places come without the smallest document, and that comes in rows without a place.
    """
    for key, check, docs, begin, until, own, own_check in unpacked(batches, [np.dtype(k) for k in ("i8", "i8", "i8", "i4", "i4", "i8", "i8")]):
        local = (own != 0) & (begin >= 0)
        at = np.flatnonzero(~local)
        # most pieces are met once
        order = at[np.argsort(key[at])]
        same = key[order][1:] == key[order][:-1]
        order = order[np.append(same, False) | np.append(False, same)] if len(order) else order
        order = order[np.lexsort((docs[order], check[order], key[order]))]
        if len(order):
            start = np.flatnonzero(np.append(True, (np.diff(key[order]) != 0) | (np.diff(check[order]) != 0)))
            count = np.diff(start, append=len(order))
            least, most = docs[order[start]], docs[order[start + count - 1]]
            keep = np.repeat(least != most, count)
            order, least = order[keep], np.repeat(least, count)[keep]
        else:
            least = docs[:0]
        places = np.flatnonzero(local)
        rows = np.concatenate([order, places])
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(docs[rows]), pa.array(begin[rows]), pa.array(until[rows]), pa.array(np.concatenate([least, np.zeros(len(places), np.int64)]), mask=np.repeat([False, True], [len(order), len(places)])),
                pa.array(own[rows], mask=own[rows] == 0), pa.array(own_check[rows]),
            ],
            names=["doc_id", "from", "until", "least", "own", "check"],
        )


def shared_passages(texts: DataFrame) -> DataFrame:
    """texts (doc_id, text) -> doc_id, start, end, cluster_doc, removed: the passages that other documents hold too, wherever these stand in lines.

    Each text's words are cut where their content says so, so a passage of some fifty words holds the same whole pieces in every document. Equal pieces (128-bit digests of their words) of
    several documents stay in the one with the smallest doc_id; overlapping pieces of a document that stay, or that go, make one passage. Texts are cut once; their pieces meet in one shuffle,
    packed, out of which only those that several documents hold come as rows.
    """
    pieces = texts.mapInArrow(_cut(BUCKETS * partitions_of(texts)), PACKED)
    found = save(met(pieces).mapInArrow(_shared, "doc_id bigint, from int, until int, least bigint, own bigint, check bigint"), "hits")
    place = ["doc_id", "from", "until", "least"]
    least = save(found.where("own IS NOT NULL AND from < 0").select("own", "check", "least").distinct(), "hot-pieces")
    hot = found.where("own IS NOT NULL AND from >= 0").drop("least").join(small(least), ["own", "check"])
    hits = found.where("own IS NULL").select(place).unionByName(hot.select(place)).withColumn("removed", F.col("doc_id") != F.col("least"))
    along = Window.partitionBy("doc_id", "removed").orderBy("from", "until")
    fresh = F.col("from") > F.coalesce(F.max("until").over(along.rowsBetween(Window.unboundedPreceding, -1)), F.lit(-1))
    marked = hits.withColumn("fresh", fresh.cast("long"))
    islands = marked.withColumn("island", F.sum("fresh").over(along.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    return islands.groupBy("doc_id", "removed", "island").agg(F.min("from").alias("start"), F.max("until").alias("end"), F.min("least").alias("cluster_doc")).select("doc_id", "start", "end", "cluster_doc", "removed")


def duplicate_paragraphs(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """docs (doc_id, text) -> a row for each duplicate: doc_id, kind, paragraph, start, end, cluster_doc, cluster_paragraph, removed.

    kind ``paragraph``: paragraphs stand between line ends; those of at least min_words words are compared as sets of five-word shingles (A-Z lower-cased), and
    linked where the exact Jaccard similarity is 0.8 or more. Candidates share a MinHash band. A cluster is a connected component; it
    stays where (doc_id, paragraph) is smallest and is removed elsewhere, within a document too. Equal paragraphs are one class
    by a 128-bit digest and are never paired. start and end are null.

    kind ``passage``: a stretch [start, end) of a text, in code points, of 24 words or more that other documents hold word for word, also inside lines and across them
    (``shared_passages``); it stays in the smallest of these documents. paragraph and cluster_paragraph are null.

    Null and empty texts have no duplicates; rows without doc_id are left
    out; rows that repeat a doc_id are one document, of which equal paragraph numbers are one paragraph. Ids may be any longs. Other columns are ignored.
    """
    texts = docs.where("doc_id IS NOT NULL").select(F.col("doc_id").cast("long"), "text")
    no = lambda c: F.lit(None).cast("int").alias(c)
    lines = near_paragraphs(texts, min_words).select(
        F.col("id.doc").alias("doc_id"), F.lit("paragraph").alias("kind"), F.col("id.no").alias("paragraph"), no("start"), no("end"),
        F.col("component.doc").alias("cluster_doc"), F.col("component.no").alias("cluster_paragraph"), (F.col("id") != F.col("component")).alias("removed"),
    )
    passages = shared_passages(texts).select("doc_id", F.lit("passage").alias("kind"), no("paragraph"), "start", "end", "cluster_doc", no("cluster_paragraph"), "removed")
    return lines.unionByName(passages)


@F.pandas_udf(T.StringType())
def _without(text: pd.Series, lines: pd.Series, spans: pd.Series) -> pd.Series:
    def one(t: str, gone, cut) -> str:
        keep = np.ones(len(t), bool)
        for a, b in cut if cut is not None else ():
            keep[a:b] = False
        out, at, gone = [], 0, set(gone if gone is not None else ())
        for i, line in enumerate(t.split("\n")):
            if i not in gone:
                out.append("".join(c for c, k in zip(line, keep[at : at + len(line)], strict=True) if k))
            at += len(line) + 1
        return "\n".join(out)

    return pd.Series([None if t is None else one(t, g, [(c["start"], c["end"]) for c in s] if s is not None else None) for t, g, s in zip(text, lines, spans, strict=True)])


def without_duplicates(docs: DataFrame, found: DataFrame) -> DataFrame:
    """docs with their removed paragraphs and passages cut out of text; line ends inside a passage stay. All other columns as they are."""
    removed = found.where("removed").groupBy(F.col("doc_id").alias("__gone_doc"))
    lines = F.collect_set("paragraph").alias("__lines")
    spans = F.collect_set(F.when(F.col("kind") == "passage", F.struct("start", "end"))).alias("__spans")
    joined = docs.join(save(removed.agg(lines, spans), "gone"), docs["doc_id"] == F.col("__gone_doc"), "left")
    return joined.withColumn("text", F.when(F.col("__gone_doc").isNull(), F.col("text")).otherwise(_without("text", "__lines", "__spans"))).drop("__gone_doc", "__lines", "__spans")


def op3_paragraph_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return duplicate_paragraphs(table(spark, sf_dir, "documents"))


OP3_SQL = r"""
WITH RECURSIVE l AS (
  SELECT doc_id, generate_subscripts(ls, 1) - 1 AS paragraph, unnest(ls) AS line FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents)
), w AS (
  SELECT doc_id, paragraph, regexp_extract_all(translate(line, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM l
), s AS (
  SELECT DISTINCT doc_id, paragraph, md5(array_to_string(ws[i : i + 4], ' ')) AS g
  FROM (SELECT doc_id, paragraph, ws, unnest(range(1, len(ws) - 3)) AS i FROM w WHERE len(ws) >= 20)
), n AS (SELECT doc_id, paragraph, count(*) AS n FROM s GROUP BY ALL),
pairs AS (
  SELECT a.doc_id AS d1, a.paragraph AS p1, b.doc_id AS d2, b.paragraph AS p2, count(*) AS shared
  FROM s a JOIN s b ON a.g = b.g AND (a.doc_id, a.paragraph) < (b.doc_id, b.paragraph) GROUP BY ALL
), links AS (
  SELECT d1, p1, d2, p2 FROM pairs JOIN n x ON x.doc_id = d1 AND x.paragraph = p1 JOIN n y ON y.doc_id = d2 AND y.paragraph = p2 WHERE 5 * shared >= 4 * (x.n + y.n - shared)
), both_ways AS (SELECT * FROM links UNION ALL SELECT d2, p2, d1, p1 FROM links),
reach AS (
  SELECT DISTINCT d1, p1, d1 AS d, p1 AS p FROM both_ways
  UNION
  SELECT r.d1, r.p1, b.d2, b.p2 FROM reach r JOIN both_ways b ON b.d1 = r.d AND b.p1 = r.p
), c AS (SELECT d1, p1, min(row(d, p)) AS least FROM reach GROUP BY ALL),
tokens AS (
  SELECT doc_id, unnest(ts) AS t, generate_subscripts(ts, 1) AS i
  FROM (SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS ts FROM documents)
), spread AS (SELECT *, sum(length(t)) OVER (PARTITION BY doc_id ORDER BY i) AS upto FROM tokens),
words AS (
  SELECT doc_id, t, CAST(upto - length(t) AS INT) AS a, CAST(upto AS INT) AS z, row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS k,
    count(*) OVER (PARTITION BY doc_id) AS n,
    least(strlen(t), 999) * 65536 + (instr('0123456789ABCDEF', hex(t)[1]) - 1) * 4096 + (instr('0123456789ABCDEF', hex(t)[2]) - 1) * 256
      + (instr('0123456789ABCDEF', hex(t)[-2]) - 1) * 16 + instr('0123456789ABCDEF', hex(t)[-1]) - 1 AS w
  FROM spread WHERE NOT regexp_matches(t, '[\x20\x09-\x0D]')
), valued AS (
  SELECT doc_id, k, n, (lag(w) OVER (PARTITION BY doc_id ORDER BY k) * 40503 + w) % 1000003 * 2654435761 % 4294967296 AS v FROM words
), least_at AS (
  SELECT doc_id, k, n, v,
    min(v) OVER (PARTITION BY doc_id ORDER BY k ROWS BETWEEN 4 PRECEDING AND 1 PRECEDING) AS before,
    min(v) OVER (PARTITION BY doc_id ORDER BY k ROWS BETWEEN 1 FOLLOWING AND 4 FOLLOWING) AS after
  FROM valued
), natural_cuts AS (
  SELECT doc_id, k FROM least_at WHERE k = 0 OR (v < coalesce(before, 1e18) AND v <= coalesce(after, 1e18))
  UNION SELECT doc_id, n FROM words
), gaps AS (SELECT doc_id, k, lead(k) OVER (PARTITION BY doc_id ORDER BY k) AS next FROM natural_cuts),
cuts AS (
  SELECT doc_id, k FROM natural_cuts
  UNION SELECT doc_id, unnest(range(k + 12, next - 11, 12)) FROM gaps WHERE next - k > 24
), pieces AS (
  SELECT x.doc_id, x.k AS k, min(y.k) AS m FROM cuts x JOIN cuts y ON x.doc_id = y.doc_id AND y.k >= x.k + 24 AND y.k <= x.k + 48 GROUP BY ALL
), texts AS (
  SELECT p.doc_id, p.k, min(a) AS a, max(z) AS z, md5(string_agg(t, ' ' ORDER BY words.k)) AS key
  FROM pieces p JOIN words ON words.doc_id = p.doc_id AND words.k >= p.k AND words.k < p.m GROUP BY ALL
), several AS (SELECT key, min(doc_id) AS least FROM texts GROUP BY key HAVING min(doc_id) < max(doc_id)),
hits AS (SELECT doc_id, a, z, least, doc_id <> least AS removed FROM texts JOIN several USING (key)),
starts AS (SELECT *, CASE WHEN a > coalesce(max(z) OVER (PARTITION BY doc_id, removed ORDER BY a, z ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), -1) THEN 1 ELSE 0 END AS fresh FROM hits),
islands AS (SELECT *, sum(fresh) OVER (PARTITION BY doc_id, removed ORDER BY a, z ROWS UNBOUNDED PRECEDING) AS island FROM starts)
SELECT d1 AS doc_id, 'paragraph' AS kind, CAST(p1 AS INT) AS paragraph, CAST(NULL AS INT) AS start, CAST(NULL AS INT) AS "end",
  least[1] AS cluster_doc, CAST(least[2] AS INT) AS cluster_paragraph, (d1, p1) <> least AS removed FROM c
UNION ALL
SELECT doc_id, 'passage', NULL, min(a), max(z), min(least), NULL, removed FROM islands GROUP BY doc_id, removed, island
"""
