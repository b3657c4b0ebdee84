"""Exact top-k by inner product: queries, a tile at a time, scatter weighted postings into dense score arrays."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from frameflow.llm.common import partitions_of, save, table

SCALE, K, EVERY = 256, 5, 50
#: A task holds about so many queries, and scores a tile of them against a block of candidates.
QUERIES, TILE, BLOCK = 16_384, 32, 4_096


def quantized(vectors: DataFrame, scale: int = SCALE) -> DataFrame:
    """vectors (vec_id, embedding) -> vec_id, v: floor(scale * x) of each component x as double. Vectors, ids or components that are null, and components that aren't finite, leave a row out."""
    x = F.transform("embedding", lambda c: c.cast("double"))
    whole = F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & F.forall(x, lambda c: F.coalesce(~F.isnan(c) & (F.abs(c) < float("inf")), F.lit(False)))
    return vectors.where(whole).select(F.col("vec_id").cast("long").alias("vec_id"), F.transform(x, lambda c: F.floor(c * scale)).alias("v"))


def _terms(lists: pa.ListArray, dense: bool) -> dict[int, tuple[np.ndarray | None, np.ndarray]]:
    """Rows of whole numbers -> term: (rows, weights), its postings; with dense, (None, a weight for every row) where most rows hold the term."""
    values = lists.flatten().to_numpy()
    sizes = np.diff(lists.offsets.to_numpy())
    row = np.repeat(np.arange(len(lists)), sizes)
    term = np.arange(len(values)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    some = np.flatnonzero(values)
    some = some[np.argsort(term[some], kind="stable")]
    cuts = np.flatnonzero(np.diff(term[some])) + 1
    out = {}
    for part in np.split(some, cuts) if len(some) else ():
        rows, weights = row[part], values[part]
        if dense and 2 * len(part) > len(lists):
            every = np.zeros(len(lists), values.dtype)
            every[rows] = weights
            rows, weights = None, every
        out[int(term[part[0]])] = rows, weights
    return out


def _most(lists: pa.ListArray) -> tuple[int, int]:
    """The largest amount of a component, and the longest row."""
    values = lists.flatten().to_numpy()
    return (max(abs(int(values.min())), abs(int(values.max()))) if len(values) else 0), int(np.diff(lists.offsets.to_numpy()).max(initial=0))


class Cell:
    """Some queries and the best k candidates each has met. Candidates come in blocks, their ids ascending."""

    def __init__(self, k: int):
        self.k, self.ids, self.vectors, self.tiles, self.best = k, [], [], None, []

    def ask(self, ids: np.ndarray, vectors: pa.ListArray) -> None:
        self.ids.append(ids)
        self.vectors.append(vectors)

    def _prepare(self) -> None:
        ids = np.concatenate(self.ids) if self.ids else np.empty(0, np.int64)
        vectors = pa.concat_arrays(self.vectors) if self.vectors else pa.array([], pa.list_(pa.int64()))
        self.tiles = [(ids[i : i + TILE], _terms(vectors[i : i + TILE], False)) for i in range(0, len(ids), TILE)]
        self.most, self.best = _most(vectors), [[] for _ in range(len(ids))]
        self.vectors = []

    def meet(self, ids: np.ndarray, vectors: pa.ListArray) -> None:
        """Every query against a block: term at a time into scores, then the block's best join those so far; equal scores stay in the order they came."""
        if self.tiles is None:
            self._prepare()
        (most, long), (own_most, own_long) = self.most, _most(vectors)
        bound = most * own_most * min(long, own_long)
        if bound >= 1 << 63:
            raise OverflowError("scores beyond 64 bits")
        kind = np.int32 if bound < (1 << 31) - 1 else np.int64
        postings = {t: (r, w.astype(kind)) for t, (r, w) in _terms(vectors, True).items()}
        for no, (queries, terms) in enumerate(self.tiles):
            scores = np.zeros((len(ids), len(queries)), kind)
            for t, (asking, q) in terms.items():
                if t not in postings:
                    continue
                rows, w = postings[t]
                weight = np.zeros(len(queries), kind)
                weight[asking] = q
                if rows is None:
                    scores += np.multiply.outer(w, weight)
                else:
                    scores[rows] += np.multiply.outer(w, weight)
            self._select(no * TILE, queries, ids, np.ascontiguousarray(scores.T))

    def _select(self, at: int, queries: np.ndarray, ids: np.ndarray, scores: np.ndarray) -> None:
        no_score = np.iinfo(scores.dtype).min
        scores[queries[:, None] == ids] = no_score
        k = min(self.k, len(ids))
        least = np.partition(scores, len(ids) - k, axis=1)[:, len(ids) - k]
        top = scores.max(axis=1)
        for j in range(len(queries)):
            best = self.best[at + j]
            if len(best) == self.k and top[j] <= best[-1][0]:
                continue
            above = np.flatnonzero(scores[j] > least[j])
            ties = np.flatnonzero(scores[j] == least[j])[: k - len(above)] if least[j] > no_score else above[:0]
            found = np.concatenate([above, ties])
            best += zip(scores[j, found].tolist(), ids[found].tolist(), strict=True)
            best.sort(key=lambda b: (-b[0], b[1]))
            del best[self.k :]

    def rows(self) -> Iterator[tuple[int, int, int]]:
        ids = np.concatenate(self.ids).tolist() if self.ids else []
        for q, best in zip(ids, self.best, strict=False):
            for score, vec in best:
                yield q, vec, score


def _searched(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def told(cell: Cell) -> Iterator[pa.RecordBatch]:
            if rows := list(cell.rows()):
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], names=["query_id", "vec_id", "score"])

        name, cell = None, None
        for batch in batches:
            cells, asks, ids = batch.column(0).to_numpy(), batch.column(1).to_numpy(), batch.column(2).to_numpy()
            cuts = (np.flatnonzero((np.diff(cells) != 0) | (np.diff(asks) != 0)) + 1).tolist()
            for lo, hi in zip([0, *cuts], [*cuts, len(ids)], strict=True):
                if lo == hi:
                    continue
                if cells[lo] != name:
                    if cell:
                        yield from told(cell)
                    name, cell = cells[lo], Cell(k)
                if asks[lo] == 0:
                    cell.ask(ids[lo:hi], batch.column(3)[lo:hi])
                    continue
                for i in range(lo, hi, BLOCK):
                    cell.meet(ids[i : min(i + BLOCK, hi)], batch.column(3)[i : min(i + BLOCK, hi)])
        if cell:
            yield from told(cell)

    return run


def top_k(vectors: DataFrame, queries: DataFrame, k: int = K) -> DataFrame:
    """vectors, queries (vec_id, v: whole numbers) -> query_id, rank, vec_id, score: each query's k highest inner products over all vectors of other ids, ties to the smaller vec_id.

    Queries are dealt to groups and vectors to blocks; a cell is one group and one block, so every query meets every vector once, with no
    row held by more than the cells of its row or column. Groups are as many as keep a cell's queries bounded, and otherwise such that
    both sides are repeated about equally. A cell streams its vectors in ascending order of id past its queries and gives k rows a query; a window merges them.

    Shorter vectors count as ending in zeros; an empty one scores 0. Rows that repeat an id are candidates each; of queries that do, the smallest vector
    asks. No queries or no other vectors: no rows. Scores that can't be held in 64 bits raise. Other columns are ignored.
    """
    asked = save(queries.groupBy("vec_id").agg(F.min("v").alias("v")), "queries")
    n, cells = asked.count(), 2 * partitions_of(vectors)
    groups = max(1, -(-n // QUERIES), round(math.sqrt(cells / EVERY)))
    blocks = max(1, -(-cells // groups))
    group = F.pmod(F.xxhash64("vec_id"), F.lit(groups))
    block = F.pmod(F.xxhash64("vec_id", "v"), F.lit(blocks))
    every = lambda m: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(m - 1).cast("long")))
    ask = asked.select("vec_id", "v", group.alias("g"), every(blocks).alias("b"), F.lit(0).alias("kind"))
    met = vectors.select("vec_id", "v", every(groups).alias("g"), block.alias("b"), F.lit(1).alias("kind"))
    both = ask.unionByName(met).select((F.col("g") * blocks + F.col("b")).alias("cell"), "kind", "vec_id", "v")
    dealt = both.repartition(partitions_of(vectors), "cell").sortWithinPartitions("cell", "kind", "vec_id", "v")
    found = dealt.mapInArrow(_searched(k), "query_id bigint, vec_id bigint, score bigint")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id"))
    return found.select("query_id", rank.alias("rank"), "vec_id", "score").where(F.col("rank") <= k)


def op12_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = quantized(table(spark, sf_dir, "embeddings"))
    return top_k(vectors, vectors.where(F.col("vec_id") % EVERY == 0))


OP12_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, coalesce(list_sum(list_transform(range(1, least(len(q.v), len(c.v)) + 1), lambda i: q.v[i] * c.v[i])), 0)::BIGINT AS score
  FROM v q, v c WHERE q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id
)
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank, vec_id, score FROM scored QUALIFY rank <= 5
"""
