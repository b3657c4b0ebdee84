"""Ordered operators over frame differences: cutting into segments and merging them. A task reads its recordings in order and holds one open segment at a time."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, replace
from itertools import groupby

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from frameflow.functions.numeric import finite_or_null, number_or, rounded


@dataclass(frozen=True)
class CutRules:
    scene: float = 40.0
    min_seconds: float = 1.0
    max_seconds: float = 3.0
    motion_run: int = 3
    short_seconds: float = 0.7
    max_segments: int = 400
    fps: float = 4.0

    @property
    def motion(self) -> float:
        return int(self.scene / 3 * 10_000 + 0.5) / 10_000

    def end(self, first: float, frames: int) -> float:
        """When a recording of so many frames ends: a frame lasts until the next would come."""
        return first + math.floor(frames / self.fps * 10_000 + 0.5) / 10_000


RAW = "recording_id bigint, start double, end double, reason string, score double, diff_sum double, samples bigint, diff_max double"
COLUMNS = [c.split()[0] for c in RAW.split(", ")]


def luma_difference(frames: DataFrame) -> DataFrame:
    """frames (recording_id, seq, pixels array) -> seq and diff, the mean absolute difference to the frame before; 0 for the first.

    Only the numbers of a recording's frames are put in order; a frame's pixels go to the frame after it, so a long recording spreads over tasks. The seqs of a recording must differ.
    """
    follows = frames.select("recording_id", "seq", F.lead("seq").over(Window.partitionBy("recording_id").orderBy("seq")).alias("next"))
    given = frames.select("recording_id", "seq", "pixels").join(follows.where("next IS NOT NULL"), ["recording_id", "seq"]).select("recording_id", F.col("next").alias("seq"), F.col("pixels").alias("before"))
    met = frames.select("recording_id", "seq", "pixels").join(given, ["recording_id", "seq"], "left")
    return met.select("recording_id", "seq", array_difference(F.col("before"), F.col("pixels")).alias("diff"))


def array_difference(a: Column, b: Column) -> Column:
    n = F.least(F.size(a), F.size(b))
    apart = F.zip_with(F.slice(a, F.lit(1), n), F.slice(b, F.lit(1), n), lambda x, y: F.abs(x.cast("double") - y.cast("double")))
    return F.when(a.isNull() | b.isNull() | (n < 1), 0.0).otherwise(rounded(F.aggregate(apart, F.lit(0.0), lambda s, x: s + x) / n))


@dataclass
class Open:
    """The segment that a recording is in, with the number of frames in a row that moved."""

    start: float
    reason: str
    score: float
    run: int
    diff_sum: float = 0.0
    samples: int = 0
    diff_max: float = 0.0

    def frame(self, t: float, d: float, rules: CutRules) -> tuple[tuple | None, Open]:
        """What frame (t, d) closes, if anything, and the segment open after it. A cadence frame counts in both segments."""
        moved, age = d >= rules.motion, t - self.start
        if d >= rules.scene and age >= rules.min_seconds:
            return self.closed(t), Open(t, "motion" if self.run >= rules.motion_run else "scene_change", d, int(moved))
        now = replace(self, run=self.run + 1 if moved else 0, diff_sum=self.diff_sum + d, samples=self.samples + 1, diff_max=max(self.diff_max, d))
        return (now.closed(t), Open(t, "cadence", d, int(moved))) if age >= rules.max_seconds else (None, now)

    def closed(self, end: float) -> tuple:
        return self.start, max(end, self.start), self.reason, self.score, self.diff_sum, self.samples, self.diff_max


_ROWS = 4096
MERGED = "recording_id bigint, start double, end double, reason string, score double, diff_sum double, samples bigint, merged bigint"


def streamed(rows: DataFrame, order: list[str], names: list[str], schema: str, one: Callable[[Iterator[tuple]], Iterable[tuple]]) -> DataFrame:
    """Each recording's rows (names, without recording_id) in their order, as they come, through ``one``; no recording is gathered anywhere."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        columns = [c.split()[0] for c in schema.split(", ")]
        kinds = [{"bigint": pa.int64(), "double": pa.float64(), "string": pa.string()}[c.split()[1]] for c in schema.split(", ")]

        def flush() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names=columns)

        every = (r for batch in batches for r in zip(*(c.to_pylist() for c in batch.columns), strict=True))
        for recording, own in groupby(every, lambda r: r[0]):
            for made in one(r[1:] for r in own):
                out.append((recording, *made))
                if len(out) >= _ROWS:
                    yield flush()
                    out = []
        if out:
            yield flush()

    return rows.select("recording_id", *names).repartition("recording_id").sortWithinPartitions("recording_id", *order).mapInArrow(run, schema)


def _cut(frames: Iterator[tuple], rules: CutRules) -> Iterator[tuple]:
    now, n, first = None, 0, 0.0
    for n, (_, t, d) in enumerate(frames, 1):
        if now is None:
            first, now = t, Open(t, "start", 0.0, int(d >= rules.motion))
            continue
        done, now = now.frame(t, d, rules)
        if done:
            yield done
    if now is not None:
        yield now.closed(rules.end(first, n))


def _merged(segments: Iterable[tuple], joins: Callable[[tuple, tuple], bool]) -> Iterator[tuple]:
    """Walks segments (start, end, reason, score, diff_sum, samples, merged) in order; joins(last kept, next) says whether the next goes into the last."""
    last = None
    for s in segments:
        if s[1] <= s[0]:
            continue
        if last is None or not joins(last, s):
            if last is not None:
                yield last
            last = s
        else:
            last = (last[0], max(last[1], s[1]), *last[2:4], last[4] + s[4], last[5] + s[5], last[6] + s[6])
    if last is not None:
        yield last


def _grows(rules: CutRules) -> Callable[[tuple, tuple], bool]:
    return lambda last, s: last[1] - last[0] < rules.min_seconds


def _absorbs(rules: CutRules) -> Callable[[tuple, tuple], bool]:
    floor = max(rules.min_seconds, rules.short_seconds)
    return lambda last, s: s[1] - s[0] < floor and last[1] - last[0] + (s[1] - s[0]) <= rules.max_seconds


def cut_segments(diffs: DataFrame, rules: CutRules = CutRules()) -> DataFrame:
    """diffs (recording_id, seq, t, diff) -> raw segments. The last one ends as many frames after the first as the recording has, at ``fps`` a second."""
    return streamed(diffs, ["seq"], ["seq", "t", "diff"], RAW, lambda frames: _cut(frames, rules))


def _fold(segments: DataFrame, joins: Callable[[tuple, tuple], bool]) -> DataFrame:
    names = ["start", "end", "reason", "score", "diff_sum", "samples", "merged"]
    rows = segments.withColumn("merged", F.lit(1).cast("long")) if "merged" not in segments.columns else segments
    return streamed(rows, ["start", "end"], names, MERGED, lambda own: _merged(own, joins))


def grow_short(segments: DataFrame, rules: CutRules = CutRules()) -> DataFrame:
    """A segment below min_seconds swallows those after it until it is long enough."""
    return _fold(segments, _grows(rules))


def absorb_short(segments: DataFrame, rules: CutRules = CutRules()) -> DataFrame:
    """A short segment goes into the one before, unless their lengths together exceed max_seconds."""
    return _fold(segments, _absorbs(rules))


def cut_and_merge(diffs: DataFrame, rules: CutRules = CutRules()) -> DataFrame:
    """cut_segments, grow_short and absorb_short in one walk over the frames."""

    def one(frames: Iterator[tuple]) -> Iterator[tuple]:
        raw = ((*s[:6], 1) for s in _cut(frames, rules))
        return _merged(_merged(raw, _grows(rules)), _absorbs(rules))

    return streamed(diffs, ["seq"], ["seq", "t", "diff"], MERGED, one)


def cap_segments(segments: DataFrame, limit: int) -> DataFrame:
    """At most ``limit`` segments a recording: all from the limit on are one."""
    order = Window.partitionBy("recording_id").orderBy("start")
    slot = F.least(F.row_number().over(order), F.lit(limit))
    return segments.withColumn("slot", slot).groupBy("recording_id", "slot").agg(
        F.min("start").alias("start"), F.max("end").alias("end"), F.min_by("reason", "start").alias("reason"), F.min_by("score", "start").alias("score"),
        F.sum("diff_sum").alias("diff_sum"), F.sum("samples").alias("samples"), F.sum("merged").alias("merged"),
    ).drop("slot")


def final_segments(capped: DataFrame) -> DataFrame:
    index = F.row_number().over(Window.partitionBy("recording_id").orderBy("start"))
    return capped.select(
        "recording_id", index.alias("index"), segment_id(index).alias("id"), rounded(F.col("start")).alias("start"), rounded(F.col("end")).alias("end"),
        rounded(F.col("end") - F.col("start")).alias("seconds"), "reason", rounded(F.col("score")).alias("score"),
        F.when(F.col("samples") > 0, rounded(F.col("diff_sum") / F.col("samples"))).otherwise(0.0).alias("motion"), "merged", "samples",
    )


def segment_id(index: Column, letter: str = "s") -> Column:
    text = index.cast("string")
    return F.concat(F.lit(letter), F.lpad(text, F.greatest(F.lit(3), F.length(text)), F.lit("0")))


def segments(diffs: DataFrame, rules: CutRules = CutRules()) -> DataFrame:
    return final_segments(cap_segments(cut_and_merge(diffs, rules), rules.max_segments))


def even_sample(rows: DataFrame, limit: int) -> DataFrame:
    """Of each recording's rows (index 1 to n) about ``limit`` spread evenly, first and last among them."""
    n = F.count(F.lit(1)).over(Window.partitionBy("recording_id"))
    if limit <= 1:
        return rows.where("index = 1")
    counted = rows.withColumn("n", n)
    steps = F.transform(F.sequence(F.lit(0), F.lit(limit - 1)), lambda i: F.floor(i * (F.col("n") - 1) / (limit - 1) + 0.5) + 1)
    return counted.where((F.col("n") <= limit) | F.array_contains(steps, F.col("index").cast("long"))).drop("n")


def head(rows: DataFrame, limit: int) -> DataFrame:
    return rows.where(F.col("index") <= limit)


def keyframe_plan(segs: DataFrame, limit: int) -> DataFrame:
    """When the still of each of a recording's first segments is taken."""
    return head(segs, limit).select("recording_id", "index", "id", rounded((F.col("start") + F.col("end")) / 2, 3).alias("at"))


def time_grid(durations: DataFrame, frames: int = 8) -> DataFrame:
    """durations (recording_id, duration) -> i, at: ``frames`` times spread evenly from 0 to the end; a single one is in the middle. Unknown durations and those not above 0 have none."""
    known = durations.where("duration > 0").select("recording_id", "duration", F.explode(F.sequence(F.lit(0), F.lit(max(1, frames) - 1))).alias("i"))
    return known.select("recording_id", "i", rounded(F.col("duration") / 2 if frames <= 1 else F.col("i") * F.col("duration") / (frames - 1), 3).alias("at"))


def valid_segments(segments: DataFrame) -> DataFrame:
    """Segments that have an end above their start, with what is absent filled in: start 0, reason start, numbers 0."""
    zero = [c for c in ("score", "diff_sum", "samples", "diff_max") if c in segments.columns]
    numbers = {c: number_or(F.col(c), 0).cast(segments.schema[c].dataType) for c in zero}
    filled = segments.withColumns({"start": number_or(F.col("start"), 0), "end": finite_or_null(F.col("end")), "reason": F.coalesce("reason", F.lit("start")), **numbers})
    return filled.where(F.coalesce("end", "start") > F.col("start"))


def chapters(segs: DataFrame, label: str | None = None) -> DataFrame:
    """One ffmetadata text a recording; a chapter's title is the segment's id, its label (a column; blank where null) and its times."""
    ms = lambda c: F.floor(F.col(c) * 1000 + 0.5).cast("long").cast("string")
    seconds = lambda c: F.format_string("%.2fs", c)
    title = F.concat("id", F.lit(" "), F.coalesce(F.col(label), F.lit("")) if label else F.lit(""), F.lit(" "), seconds("start"), F.lit("-"), seconds("end"))
    part = F.concat(F.lit("[CHAPTER]\nTIMEBASE=1/1000\nSTART="), ms("start"), F.lit("\nEND="), ms("end"), F.lit("\ntitle="), title, F.lit("\n"))
    parts = F.array_sort(F.collect_list(F.struct("index", part.alias("part"))))
    return segs.groupBy("recording_id").agg(parts.alias("p")).select("recording_id", F.concat(F.lit(";FFMETADATA1\n# a chapter for each segment\n"), F.array_join("p.part", "")).alias("chapters"))
