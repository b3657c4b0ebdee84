"""Connected components of an edge table by randomised contraction."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from frameflow.llm.common import save

#: What is left of a graph is finished by one task once it has no more edges than this, whatever its size was.
FEW_EDGES = 10_000


def _finished(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(a, b) of at most FEW_EDGES edges -> (id, to): the smallest id reachable, by union and find."""
    up: dict = {}

    def root(x):
        while up.setdefault(x, x) != x:
            up[x] = x = up[up[x]]
        return x

    kind = None
    for batch in batches:
        kind = batch.schema.field(0).type
        ends = [[tuple(v.values()) if isinstance(v, dict) else v for v in batch.column(i).to_pylist()] for i in (0, 1)]
        for a, b in zip(*ends, strict=True):
            a, b = sorted((root(a), root(b)))
            up[b] = a
    if up:
        made = lambda vs: pa.array([dict(zip([f.name for f in kind], v, strict=True)) for v in vs] if pa.types.is_struct(kind) else vs, kind)
        yield pa.RecordBatch.from_arrays([made(list(up)), made([root(x) for x in up])], names=["id", "to"])


def connected_components(edges: DataFrame, name: str = "components", max_rounds: int = 60) -> DataFrame:
    """(id, component) for each vertex of ``edges`` (a, b); component is the smallest id reachable. Ids are of any type that has an order.

    Each round every vertex moves to the neighbour (or itself) that comes first in an order (by id, then drawn
    anew per round), from there on three times, and the edges are renamed, made distinct and freed of loops. A drawn order
    shrinks chains as well as stars by a constant factor, so rounds grow with the logarithm of
    the graph. Only vertices that still have edges take part in a round, and where each ends is put together from the last round
    back to the first, so that all rounds together move a few times the vertices. Only minima are gathered per vertex, and
    renaming joins saved tables, so that a hub with many edges is combined before the shuffle or split by the join.
    Nulls in a or b are no edges; no edges give an empty table. The last FEW_EDGES edges are finished at once.
    """
    live = save(edges.where("a < b or b < a").selectExpr("least(a, b) a", "greatest(a, b) b").distinct(), name)
    steps: list[DataFrame] = []
    kind = live.schema["a"].dataType.simpleString()
    while left := live.count():
        if left <= FEW_EDGES:
            steps.append(save(live.coalesce(1).mapInArrow(_finished, f"id {kind}, to {kind}"), name))
            break
        if len(steps) == max_rounds:
            raise RuntimeError(f"components are not settled after {max_rounds} rounds")
        # by id at first: candidate links point to the smallest id of their bucket, so most stars fold at once
        rank = lambda c: F.xxhash64(F.col(c), F.lit(len(steps))) if steps else F.lit(0).cast("long")  # noqa: B023, E731
        both = live.select(F.col("a").alias("id"), F.col("b").alias("to")).unionByName(live.select(F.col("b").alias("id"), F.col("a").alias("to")))
        first = both.groupBy("id").agg(F.min(F.struct(rank("to").alias("r"), F.col("to"))).alias("m"))
        own = F.struct(rank("id").alias("r"), F.col("id").alias("to"))
        near = save(first.select("id", F.least("m", own)["to"].alias("to")), name)
        # on to where that vertex goes, and once more: ranks fall along the way, so it has no loops
        on, further = near.select(F.col("id").alias("to"), F.col("to").alias("then")), near.select(F.col("id").alias("then"), F.col("to").alias("last"))
        steps.append(save(near.join(on, "to").join(further, "then").select("id", F.col("last").alias("to")), name))
        live = save(
            live.join(steps[-1].select(F.col("id").alias("a"), F.col("to").alias("x")), "a")
            .join(steps[-1].select(F.col("id").alias("b"), F.col("to").alias("y")), "b")
            .where("x <> y").selectExpr("least(x, y) a", "greatest(x, y) b").distinct(),
            name,
        )
    if not steps:
        return live.selectExpr("a id", "b component")
    # from the last round back: each map is joined with the smaller one of the rounds after it
    moved = steps[-1]
    for step in reversed(steps[:-1]):
        later = moved.select(F.col("id").alias("to"), F.col("to").alias("then"))
        moved = save(step.join(later, "to", "left").select("id", F.coalesce("then", "to").alias("to")), name)
    least = moved.groupBy("to").agg(F.min("id").alias("m"))
    return moved.join(least, "to").select("id", F.least("id", "m").alias("component"))
