"""One document per recording out of what was read from its segments, with what is missing named and never made up."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from frameflow.functions.documents import json_of
from frameflow.functions.numeric import finite_or_null, rounded, share
from frameflow.operators import rules, text, timeline
from frameflow.operators.intervals import text_within
from frameflow.operators.tiles import LABELS

VERSION = 1
SECTIONS = ("regions", "text", "objects", "speech")
KEY = ["recording_id", "index"]


@dataclass(frozen=True)
class Limits:
    """How many of a recording's segments are read for text (the first), for objects (spread evenly), and how many blocks a segment shows."""

    text_frames: int = 60
    object_frames: int = 40
    blocks: int = 12
    keywords: int = 40
    overlap: float = 0.2


def available(rows: DataFrame, status: DataFrame, section: str) -> DataFrame:
    """Rows of the recordings whose section is available. status (recording_id, section, available, reason); a recording without a row for the section has it."""
    off = status.where((F.col("section") == section) & ~F.coalesce("available", F.lit(False))).select("recording_id").distinct()
    return rows.join(off, "recording_id", "left_anti")


def per_segment(rows: DataFrame, name: str, order: list[str], limit: int | None = None) -> DataFrame:
    """Rows (recording_id, index, ...) -> one row a segment with the others' columns as an ordered array ``name``, its first ``limit`` entries."""
    fields = [c for c in rows.columns if c not in KEY]
    all_ = F.array_sort(F.collect_list(F.struct(*order, *(c for c in fields if c not in order))))
    plain = F.transform(all_, lambda r: F.struct(*(r[c].alias(c) for c in fields)))
    return rows.groupBy(*KEY).agg((F.slice(plain, 1, limit) if limit else plain).alias(name))


def lines_read(lines: DataFrame, stills: DataFrame, status: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """The lines of the first segments, of those with a still, where text is available."""
    return available(lines, status, "text").where(F.col("index") <= limits.text_frames).join(stills.select(*KEY), KEY, "left_semi")


def until_failure(rows: DataFrame, failures: DataFrame, section: str) -> DataFrame:
    """Rows of the segments before the first at which the section failed: what stops at a failure reads nothing after it."""
    stop = failures.where(F.col("section") == section).groupBy("recording_id").agg(F.min("index").alias("stop"))
    return rows.join(stop, "recording_id", "left").where("stop IS NULL OR index < stop").drop("stop")


def classified(fused: DataFrame) -> DataFrame:
    """With kind, kind_reason and evidence: the first rule that a segment's appearances, text, objects and motion meet."""
    found = text.text_evidence(F.col("text"))
    person = F.array_max(F.transform(F.filter("objects", lambda o: o["label"] == "person"), lambda o: F.coalesce(finite_or_null(o["score"].cast("double")), F.lit(0.0))))
    facts = {
        **{k: found[k] for k in ("shell_hits", "code_hits", "line_count")}, **{f"share_{k}": share(F.col("appearances")[k]) for k in LABELS},
        "person": F.greatest(F.coalesce(person, F.lit(0.0)), F.lit(0.0)), "n_objects": F.size("objects"), "moved": F.coalesce(finite_or_null(F.col("motion")), F.lit(0.0)),
    }
    known = fused.withColumns(facts)
    shown = known.select(
        *KEY, "shell_hits", "code_hits", "line_count", *(F.col(f"share_{k}").alias(k) for k in LABELS), "person", F.col("n_objects").alias("objects"), F.col("moved").alias("motion"), F.struct(*fused.columns).alias("row")
    ).withColumn("kind", rules.first_kind())
    evidence = F.struct("shell_hits", "code_hits", "line_count", *LABELS, "person", "objects", "motion")
    return shown.select("row.*", "kind", rules.reason(F.col("kind")).alias("kind_reason"), evidence.alias("evidence"))


def fuse(segments: DataFrame, stills: DataFrame, regions: DataFrame, lines: DataFrame, objects: DataFrame, spoken: DataFrame, status: DataFrame, failures: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """segments (as ``timeline.final_segments``) -> the same with what was read from each; everything by recording_id and index.

    stills: at, of those that could be taken; regions: shares, blocks; lines: line (its number), text, confidence, x, y, w, h; objects: id, label, score, x, y, w, h; spoken: s_start, s_end, text.
    What has no still isn't read. A section that is not available, or a segment that wasn't read, is null (objects: an empty list); text is read from the first
    segments, objects from an even sample and up to the first failure. failures: section, message.
    """
    read = stills.select(*KEY)
    seen = read.join(timeline.even_sample(segments, limits.object_frames).select(*KEY), KEY, "left_semi")
    texts = per_segment(lines_read(lines, stills, status, limits), "text_lines", ["line"]).select(*KEY, "text_lines", F.array_join("text_lines.text", "\n").alias("text"))
    blank = available(timeline.head(read, limits.text_frames), status, "text").withColumn("was_read", F.lit(True))
    found = per_segment(until_failure(available(objects, status, "objects"), failures, "objects"), "objects", ["id"]).join(seen, KEY, "left_semi")
    said = text_within(segments.select(*KEY, "start", "end"), available(spoken, status, "speech"), limits.overlap)
    fused = (
        segments.select(*KEY, "id", "start", "end", "seconds", "reason", "score", "motion").join(stills.select(*KEY, F.col("at").alias("keyframe_at")), KEY, "left")
        .join(regions.join(read, KEY, "left_semi").select(*KEY, F.col("shares").alias("appearances"), F.slice("blocks", 1, limits.blocks).alias("region_blocks")), KEY, "left")
        .join(texts, KEY, "left").join(blank, KEY, "left").join(found, KEY, "left")
        .join(said.select(*KEY, F.struct("text", F.col("seconds").alias("overlap_seconds")).alias("speech")), KEY, "left")
    )
    kind = fused.schema["text_lines"].dataType
    filled = fused.withColumns({
        "objects": F.coalesce("objects", F.array().cast(fused.schema["objects"].dataType)),
        "text": F.coalesce("text", F.when(F.col("was_read"), "")), "text_lines": F.coalesce("text_lines", F.when(F.col("was_read"), F.array().cast(kind))),
    }).drop("was_read")
    return classified(filled)


def _warnings(stills: Column, segments: Column, intervals: Column, placed: Column, failed: Column) -> Column:
    few = F.when(stills < segments, F.concat(stills.cast("string"), F.lit(" stills of "), segments.cast("string"), F.lit(" segments")))
    lost = F.when((intervals > 0) & (placed == 0), F.lit("speech was found, but none of it within a segment"))
    one = lambda section: F.transform(F.filter(failed, lambda f: f["section"] == section), lambda f: F.concat(F.lit(section), F.lit(" failed ("), f["id"], F.lit("): "), f["message"]))
    return F.concat(F.filter(F.array(few), lambda w: w.isNotNull()), *(one(s) for s in SECTIONS), F.filter(F.array(lost), lambda w: w.isNotNull()))


def sections(recordings: DataFrame, status: DataFrame) -> DataFrame:
    """recordings (recording_id) -> a row for each section: available, and the reason where it isn't. What the status doesn't name is available."""
    told = recordings.select("recording_id").join(_told(status), "recording_id", "left").select("recording_id", _availability(F.col("told")).alias("s"))
    return told.select("recording_id", F.explode("s")).select("recording_id", F.col("key").alias("section"), "value.available", "value.reason")


def _told(status: DataFrame) -> DataFrame:
    off = status.where(~F.coalesce("available", F.lit(False))).groupBy("recording_id", "section").agg(F.min("reason").alias("reason"))
    return off.groupBy("recording_id").agg(F.map_from_entries(F.collect_list(F.struct("section", "reason"))).alias("told"))


def _availability(told: Column) -> Column:
    """Every section's state out of a map of what is off, and why."""
    off = lambda section: F.coalesce(F.array_contains(F.map_keys(told), section), F.lit(False))
    pairs = ((F.lit(section), F.struct((~off(section)).alias("available"), F.when(off(section), told[section]).alias("reason"))) for section in SECTIONS)
    return F.create_map(*(c for pair in pairs for c in pair))


def _counted(labels: Column) -> Column:
    """Labels of one recording -> (label, n), the most frequent first, ties in the order of a dictionary."""
    distinct = F.array_distinct(F.filter(labels, lambda x: x.isNotNull()))
    ranked = F.transform(distinct, lambda x: F.struct((-F.size(F.filter(labels, lambda y: y == x))).alias("down"), F.collate(x, "UNICODE").alias("place"), x.alias("label")))
    return F.transform(F.array_sort(ranked), lambda r: F.struct(r["label"].alias("label"), (-r["down"]).cast("long").alias("n")))


def documents(fused: DataFrame, lines: DataFrame, spoken: DataFrame, status: DataFrame, failures: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """The rows of ``fuse`` and the lines, spoken, status and failures it was given (lines: those that were read) -> a row per recording: its segments as an array, its sections with their availability, the summary and the warnings.

    A recording has at most as many segments as its rules allow, so its document is bounded; the segments are put together once and what else is told of a recording comes as a row each.
    """
    found = [c for c in fused.columns if c != "recording_id"]
    listed = F.array_sort(F.collect_list(F.struct("index", *(c for c in found if c != "index"))))
    by_recording = fused.groupBy("recording_id").agg(listed.alias("segments"), F.max("end").alias("duration"), F.count("keyframe_at").alias("stills"), F.count("speech").alias("placed"), *(rounded(F.avg(F.col("appearances")[k])).alias(f"mean_{k}") for k in LABELS))
    said = available(spoken, status, "speech").groupBy("recording_id").agg(F.count(F.lit(1)).alias("intervals"))
    failed = failures.groupBy("recording_id").agg(F.array_sort(F.collect_list(F.struct("section", "index", timeline.segment_id(F.col("index")).alias("id"), "message"))).alias("failed"))
    words = text.top_keywords(text.keywords(lines.select("recording_id", "text"), "recording_id"), "recording_id", limits.keywords)
    words = words.groupBy("recording_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "term", "n"))), lambda r: F.struct(r["term"].alias("term"), r["n"].alias("n"))).alias("keywords"))
    joined = by_recording
    for other in (said, _told(status), failed, words):
        joined = joined.join(other, "recording_id", "left")
    joined = joined.withColumn("counts", _counted(F.flatten(F.transform("segments", lambda s: F.transform(s["objects"], lambda o: o["label"])))))
    kinds = F.transform(F.array_sort(F.array_distinct(F.transform("segments", lambda s: s["kind"]))), lambda k: F.struct(k.alias("key"), F.transform(F.filter("segments", lambda s: s["kind"] == k), lambda s: s["index"]).alias("value")))
    n_lines = F.aggregate("segments", F.lit(0).cast("long"), lambda a, s: a + F.coalesce(F.array_size(s["text_lines"]), F.lit(0)))
    empty = lambda name: F.coalesce(F.col(name), F.array().cast(joined.schema[name].dataType))
    summary = F.struct(
        F.size("segments").cast("long").alias("segment_count"), F.map_from_entries(kinds).alias("kinds"), n_lines.alias("text_lines"), F.size("counts").cast("long").alias("objects"),
        F.coalesce("intervals", F.lit(0)).alias("speech_intervals"), F.col("duration"),
    )
    shares = F.when(F.col("mean_text").isNotNull(), F.struct(*(F.col(f"mean_{k}").alias(k) for k in LABELS)))
    warned = _warnings(F.col("stills"), F.size("segments").cast("long"), F.coalesce("intervals", F.lit(0)), F.col("placed"), empty("failed"))
    return joined.select("recording_id", summary.alias("summary"), "segments", _availability(F.col("told")).alias("sections"), shares.alias("shares"), "counts", empty("keywords").alias("keywords"), warned.alias("warnings"))


def as_json(made: DataFrame, pretty: bool = False) -> DataFrame:
    """recording_id, document: the rows of ``documents`` as JSON, null fields kept, numbers lossless."""
    kinds = {f.name: f.dataType for f in made.schema}
    status = lambda section, **more: F.struct(F.col("sections")[section]["available"].alias("available"), F.col("sections")[section]["reason"].alias("reason"), *(c.alias(n) for n, c in more.items()))
    lines = F.flatten(F.transform("segments", lambda s: F.coalesce(F.transform(s["text_lines"], lambda line: F.struct(s["id"].alias("segment_id"), s["keyframe_at"].alias("at"), line.alias("line"))), F.array().cast("array<struct<segment_id:string,at:double,line:" + _line_type(kinds) + ">>"))))
    shaped = made.select(
        "recording_id", F.lit(VERSION).alias("structure_version"), "summary", F.struct(F.size("segments").alias("segment_count"), F.col("segments")).alias("timeline"),
        status("regions", shares=F.col("shares")).alias("regions"), status("text", line_count=F.size(lines), lines=lines, keywords=F.col("keywords")).alias("text"),
        status("objects", counts=F.when(F.size("counts") > 0, F.map_from_entries("counts")).otherwise(F.create_map().cast("map<string,bigint>"))).alias("objects"),
        status("speech", interval_count=F.col("summary.speech_intervals")).alias("speech"), "warnings",
    )
    return shaped.select("recording_id", json_of({f.name: (F.col(f.name), f.dataType) for f in shaped.schema}, pretty).alias("document"))


def _line_type(kinds: dict) -> str:
    return kinds["segments"].elementType["text_lines"].dataType.elementType.simpleString()
