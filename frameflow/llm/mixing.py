"""Mixing sources to target weights along a time-varying curriculum. DataFrame functions only."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from frameflow.llm.common import partitions_of, save, table

WEIGHTS = (5, 2, 1)
#: Shapes of the weight schedules, repeating over the sources: (time, relative weight) knots, linear between them.
SCHEDULES = (((0.0, 1.0), (1.0, 1.0)), ((0.0, 0.2), (0.5, 1.0), (1.0, 1.8)), ((0.0, 1.8), (0.5, 1.0), (1.0, 0.2)))
SHARE, CAP = 1.5, 2


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def drawn(doc_id: Column, seed: int) -> Column:
    """60 bits of a digest of the id, which order documents. Their first ten bits deal a source's documents to 1,024 stretches of that order."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), doc_id.cast("string"))), 1, 15), 16, 10).cast("long")


def source_targets(sizes: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = SHARE, cap: int = CAP) -> DataFrame:
    """sizes (source, source_size), one row per source -> with weight, number and target.

    Targets share ``share`` times all sizes by weight; none exceeds cap times its source's size, and the excess goes
    to the others by weight until none is above. That end is found at once: in order of cap / weight, a source is at its cap if the rest's
    level would lift it there. Sources are numbered by code point, null last. One row per source is
    ordered in one task; sources are few beside documents.
    """
    by_name = Window.orderBy(F.col("source").isNull(), "source")
    fill = Window.orderBy("ratio", "no")
    before, rest = fill.rowsBetween(Window.unboundedPreceding, -1), fill.rowsBetween(0, Window.unboundedFollowing)
    numbered = sizes.withColumn("no", F.row_number().over(by_name) - 1)
    weighed = numbered.withColumn("weight", F.element_at(F.array(*map(F.lit, map(float, weights))), (F.col("no") % len(weights) + 1).cast("int")))
    ratio = weighed.withColumn("cap", F.col("source_size") * float(cap)).withColumn("ratio", F.col("cap") / F.col("weight"))
    level = (F.lit(share) * F.sum("source_size").over(Window.partitionBy()) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("weight").over(rest)
    levelled = ratio.withColumn("level", level).withColumn("full", F.col("ratio") <= F.col("level"))
    # the level of the first source that isn't full holds for all that aren't
    settled = levelled.withColumn("final", F.min(F.when(~F.col("full"), F.struct("ratio", "no", "level"))).over(Window.partitionBy())["level"])
    return settled.select("source", "source_size", "no", "weight", F.when(F.col("full") | F.col("final").isNull(), F.col("cap")).otherwise(F.col("final") * F.col("weight")).alias("target"))


def inverse_schedule(knots: Sequence[tuple[float, float]], share: Column) -> Column:
    """The time by which ``share`` (0 to 1) of a source's tokens has been asked for: the schedule's integral, inverted piece by piece."""
    areas = [(t1 - t0) * (w0 + w1) / 2 for (t0, w0), (t1, w1) in zip(knots, knots[1:], strict=False)]
    total, done, out = sum(areas), 0.0, None
    for ((t0, w0), (t1, w1)), area in zip(zip(knots, knots[1:], strict=False), areas, strict=True):
        a, need = (w1 - w0) / (t1 - t0), share * total - done
        # w0 x + a x^2 / 2 = need, in the form that is stable for a near 0
        x = 2 * need / (w0 + F.sqrt(F.greatest(F.lit(w0 * w0) + 2 * a * need, F.lit(0.0))))
        here = F.least(F.lit(t0) + F.greatest(x, F.lit(0.0)), F.lit(t1))
        done += area
        out = F.when(share * total <= done, here) if out is None else out.when(share * total <= done, here)
    return out.otherwise(F.lit(float(knots[-1][0])))


def mix(docs: DataFrame, weights: Sequence[float] = WEIGHTS, schedules: Sequence[Sequence[tuple[float, float]]] = SCHEDULES, share: float = SHARE, cap: int = CAP, seed: int = 11) -> DataFrame:
    """docs (doc_id, source, text) -> doc_id, source, size, source_size, target, taken, first_position, last_position.

    A source's documents stand in an order drawn by hash (ties by doc_id and size), so reruns agree. Its token demand goes
    through that order up to ``cap`` times and ends at the whole words of its target: the last document is taken in part. A document's positions are the times (0 to 1) at which its
    source's cumulative demand, the integral of its weight schedule, reaches its middle in the first and last
    pass that take it; null where none does. Sizes are whole words; null and empty texts have size 0 and
    are taken 0. A null source is a source of its own. No text is shuffled, and a source with most of the
    rows is summed in stretches of its order, whose offsets are added.
    """
    sized = save(
        docs.select("doc_id", "source", word_count(F.col("text")).alias("size"), drawn(F.col("doc_id"), seed).alias("h"))
        .withColumn("stretch", F.shiftrightunsigned("h", 50).cast("int")),
        "mix-sizes",
    )
    stretches = save(sized.groupBy("source", "stretch").agg(F.sum("size").alias("n")), "mix-stretches")
    targets = save(source_targets(stretches.groupBy("source").agg(F.sum("n").alias("source_size")), weights, share, cap), "mix-targets")
    earlier = Window.partitionBy("source").orderBy("stretch").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        stretches.select("source", "stretch", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("offset"))
        .join(targets.withColumnRenamed("source", "named"), F.col("source").eqNullSafe(F.col("named"))).drop("named")
        .select(F.struct("source", "stretch").alias("cell"), "source_size", "no", "target", "offset")
    )
    cell = sized.select("*", F.struct("source", "stretch").alias("cell"))
    inside = Window.partitionBy("cell").orderBy("h", "doc_id", "size").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = cell.withColumn("upto", F.sum("size").over(inside)).join(save(offsets, "mix-offsets"), "cell")
    begin = F.col("offset") + F.col("upto") - F.col("size")
    goal = F.floor("target")

    def words(turn: int) -> Column:
        return F.greatest(F.least(goal - (begin + turn * F.col("source_size")), F.col("size")), F.lit(0)).cast("long")

    def position(turn: int) -> Column:
        at = (begin + turn * F.col("source_size") + words(turn) / 2) / F.col("target")
        kind = F.col("no") % len(schedules)
        out = F.when(kind == 0, inverse_schedule(schedules[0], at))
        for i, knots in enumerate(schedules[1:], 1):
            out = out.when(kind == i, inverse_schedule(knots, at))
        return F.when(words(turn) > 0, out)

    turns = range(cap)
    return placed.select(
        "doc_id", "source", "size", "source_size", "target", sum((words(t) for t in turns), F.lit(0)).cast("long").alias("taken"),
        F.coalesce(*(position(t) for t in turns), F.lit(None).cast("double")).alias("first_position"),
        F.coalesce(*(position(t) for t in reversed(turns)), F.lit(None).cast("double")).alias("last_position"),
    )


def in_training_order(mixed: DataFrame, partitions: int | None = None) -> DataFrame:
    """Rows range-sorted by their first position; what isn't taken comes last."""
    key = [F.col("first_position").asc_nulls_last(), F.xxhash64("doc_id"), F.col("doc_id")]
    return mixed.repartitionByRange(partitions or partitions_of(mixed), *key).sortWithinPartitions(*key)


def op4_mix_curriculum(spark: SparkSession, sf_dir: str) -> DataFrame:
    return in_training_order(save(mix(table(spark, sf_dir, "documents")).drop("source", "last_position").withColumn("first_position", F.round("first_position", 6)), "mixed"))


OP4_SQL = r"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size,
    CAST('0x' || substr(md5(concat_ws(':', '11', CAST(doc_id AS VARCHAR))), 1, 15) AS BIGINT) AS h FROM documents
), s AS (
  SELECT *, CAST(CASE no % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS DOUBLE) AS weight, source_size * 2.0::DOUBLE AS cap
  FROM (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source IS NULL, source) - 1 AS no FROM d GROUP BY source)
), l AS (
  SELECT *, (1.5::DOUBLE * CAST(sum(source_size) OVER () AS BIGINT) - coalesce(sum(cap) OVER (ORDER BY cap / weight, no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0))
    / sum(weight) OVER (ORDER BY cap / weight, no ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM s
), f AS (SELECT *, cap / weight <= level AS is_full FROM l),
t AS (
  SELECT source, no, source_size, CASE WHEN is_full THEN cap ELSE (SELECT min_by(level, cap / weight + no * 1e-9) FROM f WHERE NOT is_full) * weight END AS target FROM f
), p AS (
  SELECT d.*, t.no, t.source_size, t.target, CAST(sum(size) OVER (PARTITION BY d.source ORDER BY h, doc_id, size ROWS UNBOUNDED PRECEDING) - size AS BIGINT) AS begun
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source
), k AS (
  SELECT *, CAST(greatest(least(floor(target) - begun, size), 0) AS BIGINT) AS w0, CAST(greatest(least(floor(target) - begun - source_size, size), 0) AS BIGINT) AS w1 FROM p
), q AS (
  SELECT *, CASE WHEN w0 > 0 THEN (begun + w0 / 2.0::DOUBLE) / target WHEN w1 > 0 THEN (begun + source_size + w1 / 2.0::DOUBLE) / target END AS m FROM k
)
SELECT doc_id, size, source_size, target, w0 + w1 AS taken,
  round(CASE WHEN m IS NULL THEN NULL WHEN no % 3 = 0 THEN m
    WHEN no % 3 = 1 AND m <= 0.3 THEN 2 * m / (0.2 + sqrt(0.04 + 3.2 * m))
    WHEN no % 3 = 1 THEN 0.5 + 2 * (m - 0.3) / (1.0 + sqrt(1.0 + 3.2 * (m - 0.3)))
    WHEN m <= 0.7 THEN 2 * m / (1.8 + sqrt(greatest(3.24 - 3.2 * m, 0)))
    ELSE 0.5 + 2 * (m - 0.7) / (1.0 + sqrt(greatest(1.0 - 3.2 * (m - 0.7), 0))) END, 6) AS first_position
FROM q
"""
