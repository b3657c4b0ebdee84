"""The given tables as recordings: frame differences, frames, boxes, spoken text and silences."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from frameflow.functions.numeric import rounded


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def frame_diffs(spark: SparkSession, sf_dir: str) -> DataFrame:
    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    seq = F.row_number().over(order) - 1
    diff = F.coalesce(rounded(F.abs(F.col("value") - F.lag("value").over(order))), F.lit(0.0))
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("recording_id"), seq.cast("long").alias("seq"), (seq * 0.25).cast("double").alias("t"), diff.alias("diff"))


def vector_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("label").cast("long").alias("recording_id"), F.col("vec_id").alias("seq"), F.col("embedding").alias("pixels"))


def of_frames(rows: DataFrame, key: str, frames: DataFrame | None) -> DataFrame:
    """Rows of the frames that are asked for (their number in a column ``still``), before any work on them; all rows without frames."""
    return rows if frames is None else rows.join(frames.select(F.col("still").alias(key)), key, "left_semi")


def gray_frames(spark: SparkSession, sf_dir: str, frames: DataFrame | None = None) -> DataFrame:
    """8 x 8 gray frames out of vectors, in six looks."""
    v = F.pmod("vec_id", F.lit(6))
    base = F.when(v == 1, 20.0).otherwise(128.0)
    gain = F.element_at(F.array(*(F.lit(x) for x in (10.0, 10.0, 600.0, 90.0, 45.0, 0.0))), (v + 1).cast("int"))
    value = lambda x, i: F.when(v == 5, 40.0 + 20.0 * (i % 8)).otherwise(F.least(F.greatest(F.floor(base + x.cast("double") * gain), F.lit(0)), F.lit(255)).cast("double"))
    vectors = of_frames(table(spark, sf_dir, "embeddings"), "vec_id", frames)
    return vectors.select(F.col("label").cast("long").alias("recording_id"), F.col("vec_id").alias("frame_id"), F.transform("embedding", value).alias("pixels"))


def boxes(spark: SparkSession, sf_dir: str, frames: DataFrame | None = None) -> DataFrame:
    li = of_frames(table(spark, sf_dir, "lineitem"), "l_orderkey", frames)
    row = F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_partkey", "l_suppkey", *[x for x in li.columns if x not in ("l_orderkey", "l_partkey", "l_suppkey")]))
    return li.select(
        F.col("l_orderkey").alias("frame_id"), row.cast("long").alias("id"), (F.col("l_linenumber") % 2).cast("long").alias("class"), rounded(0.3 + F.col("l_quantity") / 72).alias("score"),
        ((F.col("l_partkey") % 4) * 6).alias("x"), ((F.col("l_suppkey") % 3) * 6).alias("y"), (30 + (F.col("l_partkey") % 3) * 5).alias("w"), (30 + (F.col("l_suppkey") % 5) * 4).alias("h"),
    )


def speech(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns one after another with small pauses: recording_id, item, s_start, s_end, text."""
    t = table(spark, sf_dir, "conversations")
    spoken = t.select(
        F.col("conv_id").alias("recording_id"), F.col("turn").alias("item"), "text",
        F.greatest(F.lit(5), F.length("text")).cast("long").alias("cs"), (F.pmod(F.col("conv_id") + F.col("turn"), F.lit(4)) * 20).alias("gap"),
    )
    order = Window.partitionBy("recording_id").orderBy("item")
    begin = F.sum(F.col("cs") + F.col("gap")).over(order.rowsBetween(Window.unboundedPreceding, 0)) - F.col("cs")
    return spoken.select("recording_id", "item", (begin / 100.0).alias("s_start"), ((begin + F.col("cs")) / 100.0).alias("s_end"), "text")


def silences(spoken: DataFrame) -> DataFrame:
    before = F.coalesce(F.lag("s_end").over(Window.partitionBy("recording_id").orderBy("item")), F.lit(0.0))
    return spoken.select("recording_id", before.alias("start"), F.col("s_start").alias("end")).where("end > start")


def grid_segments(spoken: DataFrame, width: float = 4.0) -> DataFrame:
    """Every recording cut each ``width`` seconds up to its end."""
    last = spoken.groupBy("recording_id").agg(F.max("s_end").alias("duration"))
    return last.select("recording_id", F.explode(F.sequence(F.lit(1), F.ceil(F.col("duration") / width).cast("int"))).alias("index")).select(
        "recording_id", "index", ((F.col("index") - 1) * width).alias("start"), (F.col("index") * width).alias("end")
    )
