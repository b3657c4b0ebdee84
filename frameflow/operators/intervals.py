"""Silences, speech and the joins of intervals with segments."""

from __future__ import annotations

import heapq
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from frameflow.functions.numeric import rounded
from frameflow.functions.strings import has_text, trimmed
from frameflow.operators.timeline import streamed

MIN_SPEECH, MAX_INTERVAL = 0.25, 25.0


def parse_silences(logs: DataFrame) -> DataFrame:
    """logs (recording_id, text) -> start, end (null while open). An end closes the last start before it; of several the last counts; negative starts are dropped."""
    lines = logs.select("recording_id", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    number = lambda name: F.nullif(F.regexp_extract("line", name + r":\s*(-?[0-9.]+)", 1), F.lit("")).cast("double")
    marked = lines.select("recording_id", "pos", number("silence_start").alias("s"), number("silence_end").alias("e")).where("s is not null or e is not null")
    run = F.count("s").over(Window.partitionBy("recording_id").orderBy("pos"))
    grouped = marked.withColumn("run", run).where("run > 0").groupBy("recording_id", "run")
    return grouped.agg(F.max("s").alias("start"), F.max_by("e", F.when(F.col("e").isNotNull(), F.col("pos"))).alias("end")).where("start >= 0").drop("run")


def chop(pieces: DataFrame, longest: float, least: float, inclusive: bool = True) -> DataFrame:
    """Pieces (recording_id, start, end) cut every ``longest`` seconds; a rest below ``least`` is dropped."""
    n = F.greatest(F.ceil((F.col("end") - F.col("start")) / longest) - 1, F.lit(0)).cast("int")
    cut = pieces.select("recording_id", "start", "end", n.alias("n")).select("recording_id", "start", "end", "n", F.explode(F.sequence(F.lit(0), F.col("n"))).alias("i"))
    begin = F.col("start") + F.col("i") * longest
    rest = F.col("end") - begin
    enough = rest >= least if inclusive else rest > least
    return cut.where((F.col("i") < F.col("n")) | enough).select("recording_id", begin.alias("start"), F.when(F.col("i") < F.col("n"), begin + longest).otherwise(F.col("end")).alias("end"))


def speech_intervals(silences: DataFrame, durations: DataFrame, longest: float = MAX_INTERVAL, least: float = MIN_SPEECH) -> DataFrame:
    """The complement of the silences in [0, duration], chopped. durations (recording_id, duration)."""
    known = durations.where("duration > 0")
    inside = silences.join(known, "recording_id").select(
        "recording_id", F.greatest("start", F.lit(0.0)).alias("start"), F.least(F.coalesce("end", "duration"), "duration").alias("end")
    ).where("end > start")
    ends = inside.unionByName(known.select("recording_id", F.col("duration").alias("start"), F.col("duration").alias("end")))
    before = Window.partitionBy("recording_id").orderBy("start", "end").rowsBetween(Window.unboundedPreceding, -1)
    gaps = ends.select("recording_id", F.coalesce(F.max("end").over(before), F.lit(0.0)).alias("from"), F.col("start").alias("end")).where("end > from")
    cut = chop(gaps.withColumnRenamed("from", "start"), longest, least)
    return cut.select("recording_id", rounded(F.col("start")).alias("start"), rounded(F.col("end")).alias("end"), rounded(F.col("end") - F.col("start")).alias("seconds"))


def plan_cuts(recordings: DataFrame, silences: DataFrame, max_seconds: float, lead: float = 25.0) -> DataFrame:
    """recordings (recording_id, duration) -> cut and forced: where to cut so that no piece exceeds max_seconds, at the latest fitting silence."""
    starts = silences.groupBy("recording_id").agg(F.array_sort(F.collect_list("start")).alias("starts"))

    def one(rows):
        for pdf in rows:
            out = []
            for rec, total, s in zip(pdf["recording_id"], pdf["duration"], pdf["starts"], strict=True):
                at = 0.0
                while total - at > max_seconds:
                    limit = at + max_seconds
                    fit = [x for x in (s if s is not None else ()) if at + max_seconds * 0.25 < x <= limit and x >= limit - lead]
                    at = max(fit) if fit else limit
                    out.append((rec, float(at), not fit))
            yield pd.DataFrame(out, columns=["recording_id", "cut", "forced"])

    return recordings.join(starts, "recording_id", "left").select("recording_id", "duration", "starts").mapInPandas(one, "recording_id bigint, cut double, forced boolean")


def merge_intervals(intervals: DataFrame, most: int, max_seconds: float) -> DataFrame:
    """Chops intervals above max_seconds, then joins the closest neighbours of a recording until ``most`` (1 at least) are left or the closest pair would be too long.

    Rows are read in order as they come; of one recording at a time the times of its pieces are held, n log n for n of them.
    """
    most = max(1, most)
    cut = chop(intervals.select("recording_id", "start", "end"), max_seconds, 0.01, inclusive=False)
    schema = "recording_id bigint, start double, end double, seconds double, merged bigint"
    merged = streamed(cut, ["start", "end"], ["start", "end"], schema, lambda pieces: closest_joined(pieces, most, max_seconds))
    return merged.select("recording_id", *(rounded(F.col(c)).alias(c) for c in ("start", "end", "seconds")), "merged")


def closest_joined(pieces: Iterable[tuple[float, float]], most: int, max_seconds: float) -> Iterator[tuple[float, float, float, int]]:
    """(start, end) in order -> (start, end, seconds, joined). Neighbours' costs wait in a heap; a join changes two of them, and costs of pieces that have changed since are passed over when they come up."""
    start, end = map(list, zip(*pieces, strict=True))
    n = left = len(start)
    seconds, joined = [b - a for a, b in zip(start, end, strict=True)], [1] * n
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    alive, version = [True] * n, [0] * n

    def cost(i: int) -> tuple[float, int, int, int]:
        j = after[i]
        return start[j] - end[i] + (seconds[i] + seconds[j]) * 0.01, i, version[i], version[j]

    waiting = [cost(i) for i in range(n - 1)]
    heapq.heapify(waiting)
    while left > most:
        _, i, mine, other = heapq.heappop(waiting)
        j = after[i]
        if not alive[i] or j == n or version[i] != mine or version[j] != other:
            continue
        if end[j] - start[i] > max_seconds:
            break
        end[i], seconds[i], joined[i], after[i] = end[j], end[j] - start[i], joined[i] + joined[j], after[j]
        alive[j], left = False, left - 1
        version[i] += 1
        if after[i] < n:
            before[after[i]] = i
            heapq.heappush(waiting, cost(i))
        if before[i] >= 0:
            heapq.heappush(waiting, cost(before[i]))
    return ((start[i], end[i], seconds[i], joined[i]) for i in range(n) if alive[i])


def _buckets(start: str, end: str, width: float):
    return F.sequence(F.floor(F.col(start) / width), F.floor(F.col(end) / width))


def overlap_join(segments: DataFrame, spoken: DataFrame, least: float = 0.2, bucket: float = 60.0) -> DataFrame:
    """segments (recording_id, index, start, end) x spoken (recording_id, s_start, s_end, text): each pair that overlaps by more than ``least`` seconds.

    An equi join on recording and stretch of time, so long recordings spread over tasks; a pair is kept in the stretch where its overlap begins.
    """
    left = segments.withColumn("b", F.explode(_buckets("start", "end", bucket)))
    right = spoken.withColumn("b", F.explode(_buckets("s_start", "s_end", bucket)))
    overlap = F.least("end", "s_end") - F.greatest("start", "s_start")
    return left.join(right, ["recording_id", "b"]).where((overlap > least) & (F.col("b") == F.floor(F.greatest("start", "s_start") / bucket))).withColumn("overlap", overlap).drop("b")


def text_within(segments: DataFrame, spoken: DataFrame, least: float = 0.2) -> DataFrame:
    """What is said in each segment, in order, and for how long. Segments without text are left out."""
    pairs = overlap_join(segments, spoken, least)
    said = F.array_sort(F.collect_list(F.struct("s_start", "s_end", trimmed(F.col("text")).alias("text"))))
    grouped = pairs.groupBy("recording_id", "index").agg(F.sum(F.col("overlap").cast("decimal(38,12)")).cast("double").alias("seconds"), F.filter(said, lambda s: s["text"] != "").alias("said"))
    return grouped.select("recording_id", "index", rounded(F.col("seconds")).alias("seconds"), F.array_join("said.text", " ").alias("text")).where("text <> ''")


def assign_to_segments(items: DataFrame, segments: DataFrame, bucket: float = 60.0) -> DataFrame:
    """items (recording_id, item, s_start, s_end) -> with index: the segment that holds the midpoint, the last for midpoints past the end, null for none.

    An as-of join: starts and midpoints of a recording are put in one order, and each midpoint takes the last start before it, whose end
    then decides. No item meets more than one segment. The order is that of a stretch of time (``bucket`` seconds), into which a segment that
    reaches over several stands once for each, so a long recording spreads over tasks. Segments of a recording must not overlap. Only the last
    segment of each recording is joined, as a row a recording; Spark broadcasts it or splits a hot recording. Items without times have no segment; items that come twice are placed twice.
    """
    mid = items.select("recording_id", "item", ((F.col("s_start") + F.col("s_end")) / 2).alias("mid"))
    spans = segments.where("end > start").select("recording_id", "index", "start", "end", F.explode(_buckets("start", "end", bucket)).alias("b"))
    opened = spans.select("recording_id", "b", F.greatest("start", F.col("b") * bucket).alias("at"), F.lit(0).alias("kind"), F.lit(None).cast(items.schema["item"].dataType).alias("item"), F.struct("index", "end").alias("segment"))
    points = mid.select("recording_id", F.floor(F.col("mid") / bucket).alias("b"), F.col("mid").alias("at"), F.lit(1).alias("kind"), "item", F.lit(None).cast(opened.schema["segment"].dataType).alias("segment"))
    order = Window.partitionBy("recording_id", "b").orderBy("at", "kind").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = opened.unionByName(points).withColumn("found", F.last("segment", ignorenulls=True).over(order)).where("kind = 1")
    last = segments.groupBy("recording_id").agg(F.max_by("index", "end").alias("last"), F.max("end").alias("finish"))
    inside = F.when(F.col("at") < F.col("found.end"), F.col("found.index"))
    return placed.join(last, "recording_id", "left").select("recording_id", "item", F.col("at").alias("mid"), F.coalesce(inside, F.when(F.col("at") >= F.col("finish"), F.col("last"))).alias("index"))


def transcript(spoken: DataFrame) -> DataFrame:
    said = F.array_sort(F.collect_list(F.struct("s_start", "s_end", "text")))
    return spoken.where(has_text(F.col("text"))).groupBy("recording_id").agg(F.array_join(said["text"], "\n").alias("transcript"), F.count(F.lit(1)).alias("spoken"))
