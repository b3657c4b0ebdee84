"""Boxes: intersection over union, non-maximum suppression, decoding of detector output."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from frameflow.functions.media import tensor_layout
from frameflow.functions.numeric import half_up, rounded


#: Width of the stretches in which boxes look for partners.
_STRIPE = 256


def iou(a: str, b: str) -> Column:
    """Of two boxes whose columns carry the suffixes a and b; 0 for empty unions."""
    side = lambda p, d: F.greatest(F.least(F.col(p + a) + F.col(d + a), F.col(p + b) + F.col(d + b)) - F.greatest(p + a, p + b), F.lit(0))
    both = side("x", "w") * side("y", "h")
    either = F.col("w" + a) * F.col("h" + a) + F.col("w" + b) * F.col("h" + b) - both
    return F.when((both > 0) & (either > 0), both / either).otherwise(0.0)


def iou_pairs(boxes: DataFrame) -> DataFrame:
    """boxes (frame_id, id, class, score, x, y, w, h) -> the pairs of a frame and class that overlap, with their IoU; of all others it is 0.

    Boxes meet by frame, class and stretch of the x axis (``_STRIPE`` wide), a pair in the stretch where its overlap begins.
    """
    stripes = F.explode(F.sequence(F.floor(F.col("x") / _STRIPE), F.floor((F.col("x") + F.col("w")) / _STRIPE))).alias("stripe")
    side = lambda s: boxes.where("w > 0 AND h > 0").select("frame_id", "class", stripes, F.col("id").alias("id" + s), *(F.col(c).alias(c + s) for c in "xywh"))
    meet = "id1 < id2 AND x1 < x2 + w2 AND x2 < x1 + w1 AND y1 < y2 + h2 AND y2 < y1 + h1"
    pairs = side("1").join(side("2"), ["frame_id", "class", "stripe"]).where(meet).where(F.col("stripe") == F.floor(F.greatest("x1", "x2") / _STRIPE))
    return pairs.select("frame_id", "class", "id1", "id2", rounded(iou("1", "2")).alias("iou"))


def suppress(boxes: DataFrame, threshold: float = 0.45, limit: int = 50) -> DataFrame:
    """Greedy by score (ties by id): a box goes if a kept one of its class overlaps by more than the threshold; at most ``limit`` stay a frame.

    Frames pass through a task in order; only the boxes kept of one frame are held.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frame, kept = None, []
        for batch in batches:
            stay = []
            columns = [c.to_pylist() for c in batch.columns[:1] + batch.columns[2:3] + batch.columns[4:]]
            for i, (f, kind, x, y, w, h) in enumerate(zip(*columns, strict=True)):
                if f != frame:
                    frame, kept = f, []
                if len(kept) == limit:
                    continue
                for k, kx, ky, kw, kh in kept:
                    if k == kind:
                        wide, high = min(kx + kw, x + w) - max(kx, x), min(ky + kh, y + h) - max(ky, y)
                        if wide > 0 and high > 0 and wide * high / (kw * kh + w * h - wide * high) > threshold:
                            break
                else:
                    kept.append((kind, x, y, w, h))
                    stay.append(i)
            yield batch.select([0, 1, 2, 3]).take(pa.array(stay, pa.int64()))

    plain = boxes.select(*(F.col(c).cast("long") for c in ("frame_id", "id", "class")), F.col("score").cast("double"), "x", "y", "w", "h")
    ordered = plain.repartition("frame_id").sortWithinPartitions("frame_id", F.col("score").desc(), "id")
    return ordered.mapInArrow(run, "frame_id bigint, id bigint, class bigint, score double")


def decode(tensors: DataFrame, min_score: float = 0.35, labels: Sequence[str] | None = None) -> DataFrame:
    """tensors (frame_id, data array, d1, d2: its two axes; pad_x, pad_y, factor, width, height) -> candidates: frame_id, id (the row), class, label, score, x, y, w, h.

    The axis of 5 to 1,024 holds the channels (``media.tensor_layout``); tensors with neither axis so give no rows. A row is cx, cy, w, h, then class scores; where channels come last, or are 85 or 6, an
    objectness stands before the classes and multiplies the score. The first best class counts and must be above 0; the score is compared before it
    is rounded; boxes are scaled back, clipped and rounded. labels name the classes if there are as many; else they are class_0 and on.
    """
    shaped = tensors.withColumn("layout", tensor_layout(F.col("d1"), F.col("d2"))).where("layout IS NOT NULL")
    first = F.col("layout") == "channel_major"
    shaped = shaped.withColumns({"channels": F.when(first, F.col("d1")).otherwise(F.col("d2")), "rows": F.when(first, F.col("d2")).otherwise(F.col("d1"))})
    shaped = shaped.withColumn("skip", F.when(~first | F.col("channels").isin(85, 6), 5).otherwise(4)).where("rows > 0 AND channels > skip")
    at = lambda c: F.get("data", F.when(first, c * F.col("rows") + F.col("id")).otherwise(F.col("id") * F.col("channels") + c).cast("int"))
    rows = shaped.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.col("rows").cast("long") - 1)).alias("id"))
    rows = rows.select("*", F.transform(F.sequence(F.lit(0).cast("long"), F.col("channels").cast("long") - 1), at).alias("r")).drop("data")
    scores = F.slice("r", F.col("skip") + 1, F.col("channels").cast("int") - F.col("skip"))
    best = rows.withColumn("best", F.array_max(scores)).withColumn("class", (F.array_position(scores, F.col("best")) - 1).cast("long"))
    sure = best.withColumn("sure", F.when(F.col("skip") == 5, F.get("r", F.lit(4)) * F.col("best")).otherwise(F.col("best"))).where((F.col("best") > 0) & (F.col("sure") >= min_score))
    edge = lambda c, s, pad, size, sign: F.least(F.greatest((F.get("r", F.lit(c)) + sign * F.get("r", F.lit(s)) / 2 - F.col(pad)) * F.col("factor"), F.lit(0.0)), F.col(size).cast("double"))
    x1, x2, y1, y2 = edge(0, 2, "pad_x", "width", -1), edge(0, 2, "pad_x", "width", 1), edge(1, 3, "pad_y", "height", -1), edge(1, 3, "pad_y", "height", 1)
    plain = F.concat(F.lit("class_"), F.col("class").cast("string"))
    label = F.when(F.col("channels") - F.col("skip") == len(labels), F.get(F.array(*map(F.lit, labels)), F.col("class").cast("int"))).otherwise(plain) if labels else plain
    return sure.select("frame_id", "id", "class", label.alias("label"), rounded(F.col("sure")).alias("score"), half_up(x1).alias("x"), half_up(y1).alias("y"), half_up(x2 - x1).alias("w"), half_up(y2 - y1).alias("h"))


def detections(tensors: DataFrame, min_score: float = 0.35, threshold: float = 0.45, limit: int = 50, labels: Sequence[str] | None = None) -> DataFrame:
    """The candidates of ``decode`` that suppression keeps, with their centres and their rank in the frame, by score and then row."""
    found = decode(tensors, min_score, labels)
    kept = found.join(suppress(found, threshold, limit).select("frame_id", "id"), ["frame_id", "id"])
    rank = F.row_number().over(Window.partitionBy("frame_id").orderBy(F.col("score").desc(), "id"))
    centre = lambda p, s: half_up(F.col(p) + F.col(s) / 2)
    return kept.select("*", centre("x", "w").alias("center_x"), centre("y", "h").alias("center_y"), rank.alias("rank"))


def scored(found: DataFrame, least: float) -> DataFrame:
    """What is scored at least ``least``; a score that is null isn't."""
    return found.where(F.col("score") >= least)


def label_counts(found: DataFrame, key: str) -> DataFrame:
    """found (key, label) -> key, label, n, rank: how often each label is found, the most frequent first, ties in the order of a dictionary. Null labels don't count."""
    counts = found.where("label IS NOT NULL").groupBy(key, "label").agg(F.count(F.lit(1)).alias("n"))
    rank = F.row_number().over(Window.partitionBy(key).orderBy(F.col("n").desc(), F.collate("label", "UNICODE"), "label"))
    return counts.select(key, "label", "n", rank.cast("long").alias("rank"))


def person_score(found: DataFrame, key: str) -> DataFrame:
    """found (key, label, score) -> key, person: the best score of a person, 0 where none is found."""
    return found.groupBy(key).agg(F.coalesce(F.max(F.when((F.col("label") == "person") & ~F.isnan("score"), F.greatest("score", F.lit(0.0)))), F.lit(0.0)).alias("person"))
