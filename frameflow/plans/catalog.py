"""Queries over the given tables: each operator applied to a whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from frameflow.functions import documents, media, settings, tables
from frameflow.functions.numeric import clamped_or, finite_or_null, half_up, number_or, share
from frameflow.operators import boxes as bx
from frameflow.operators import fusion, intervals, rules, text, tiles, timeline
from frameflow.plans.sql import SQL  # noqa: F401
from frameflow.sources import fixtures as fx
from frameflow.sources import media as sources
from frameflow.sources.scratch import written

RULES = timeline.CutRules()


def _diffs(s, d):
    return fx.frame_diffs(s, d)


def segments_raw(s: SparkSession, d: str) -> DataFrame:
    return timeline.cut_segments(_diffs(s, d), RULES)


def segments_grown(s, d):
    return timeline.grow_short(segments_raw(s, d), RULES)


def segments_merged(s, d):
    return timeline.absorb_short(segments_grown(s, d), RULES)


def segments_capped(s, d):
    return timeline.cap_segments(segments_merged(s, d), 5)


def segments_final(s, d):
    return timeline.segments(_diffs(s, d), RULES)


def frame_diffs(s, d):
    return _diffs(s, d)


def luma_diff(s, d):
    return timeline.luma_difference(fx.vector_frames(s, d))


def keyframe_plan(s, d):
    return timeline.keyframe_plan(segments_final(s, d), 3)


def keyframe_left_join(s, d):
    segs = segments_final(s, d).select("recording_id", "index", "id")
    return segs.join(keyframe_plan(s, d).select("recording_id", "index", "at"), ["recording_id", "index"], "left")


def spread_sample(s, d):
    return timeline.even_sample(segments_final(s, d), 4).select("recording_id", "index", "start")


def head_limit(s, d):
    return timeline.head(segments_final(s, d), 2).select("recording_id", "index", "start")


def chapters(s, d):
    return timeline.chapters(segments_final(s, d), "reason")


def _tiles(s, d, frames=None):
    return tiles.tile_stats(fx.gray_frames(s, d, frames), 8, 8, 4)


def tile_stats(s, d):
    return _tiles(s, d)


def _colour_frames(s, d):
    """Gray frames as red, their pixels from last to first as green, a row further down as blue."""
    g = fx.gray_frames(s, d)
    at = lambda i: F.get("pixels", i)
    pixel = F.transform(F.sequence(F.lit(0), F.lit(63)), lambda i: F.array(at(i), at(63 - i), at((i + 8) % 64)))
    return g.select("frame_id", F.flatten(pixel).alias("pixels"))


def tile_stats_color(s, d):
    return tiles.tile_stats(_colour_frames(s, d), 8, 8, 3, channels=3)


def tile_label(s, d):
    return _tiles(s, d).groupBy("label").agg(F.count(F.lit(1)).alias("n"))


def area_shares(s, d):
    return tiles.area_shares(_tiles(s, d))


def mean_shares(s, d):
    ids = fx.gray_frames(s, d).select("frame_id", "recording_id")
    return tiles.mean_shares(tiles.area_shares(_tiles(s, d)).join(ids, "frame_id"))


def tile_blocks(s, d):
    return tiles.frame_blocks(fx.gray_frames(s, d), 8, 8, 2)


def iou_pairs(s, d):
    return bx.iou_pairs(fx.boxes(s, d))


def nms(s, d):
    return bx.suppress(fx.boxes(s, d))


def _labelled(s, d, frames=None):
    return fx.boxes(s, d, frames).withColumn("label", F.when(F.col("class") == 1, "person").otherwise("TV"))


def object_counts(s, d):
    return bx.label_counts(_labelled(s, d), "frame_id")


def person_score(s, d):
    return bx.person_score(_labelled(s, d), "frame_id")


def score_filter(s, d):
    return bx.scored(fx.boxes(s, d), 0.5).groupBy("frame_id").agg(F.count(F.lit(1)).alias("kept"), F.max("score").alias("best"))


def _tensors(s, d):
    """Vectors read as 8 rows of 8 channels (objectness fourth), as 6 channels of 10 rows (objectness too) or as 5 channels of 12 rows."""
    v = fx.table(s, d, "embeddings")
    kind = F.pmod("vec_id", F.lit(3))
    data = F.transform("embedding", lambda x, i: F.floor(x.cast("double") * 64) / 16 + F.pmod(i * 13, F.lit(40)))
    return v.select(
        F.col("vec_id").alias("frame_id"), data.alias("data"), F.when(kind == 0, 3).when(kind == 1, 6).otherwise(5).alias("d1"), F.when(kind == 0, 20).when(kind == 1, 4).otherwise(3).alias("d2"),
        F.lit(4).alias("pad_x"), F.lit(8).alias("pad_y"), F.lit(2.0).alias("factor"), F.lit(60).alias("width"), F.lit(50).alias("height"),
    )


def decode_candidates(s, d):
    return bx.decode(_tensors(s, d), 30.0)


def decode_detections(s, d):
    return bx.detections(_tensors(s, d), 30.0)


def speech_intervals(s, d):
    spoken = fx.speech(s, d)
    return intervals.speech_intervals(fx.silences(spoken), spoken.groupBy("recording_id").agg(F.max("s_end").alias("duration")), 10.0)


def parse_silences(s, d):
    sil = fx.silences(fx.speech(s, d))
    line = F.concat(F.lit("[s] silence_start: "), F.col("start").cast("string"), F.lit("\nframe=1\n[s] silence_end: "), F.col("end").cast("string"))
    logs = sil.groupBy("recording_id").agg(F.array_join(F.array_sort(F.collect_list(F.struct("start", line.alias("line"))))["line"], "\n").alias("text"))
    return intervals.parse_silences(logs)


def plan_cuts(s, d):
    spoken = fx.speech(s, d)
    return intervals.plan_cuts(spoken.groupBy("recording_id").agg(F.max("s_end").alias("duration")), fx.silences(spoken), 8.0, 6.0)


def merge_intervals(s, d):
    return intervals.merge_intervals(speech_intervals(s, d), 4, 20.0)


def speech_overlap(s, d):
    spoken = fx.speech(s, d)
    return intervals.text_within(fx.grid_segments(spoken), spoken)


def assign_segments(s, d):
    """Speech placed in the stretches between the silences, which have gaps of their own."""
    index = F.row_number().over(Window.partitionBy("recording_id").orderBy("start"))
    segs = speech_intervals(s, d).select("recording_id", index.cast("long").alias("index"), "start", "end")
    return intervals.assign_to_segments(fx.speech(s, d), segs)


def assign_unplaced(s, d):
    return assign_segments(s, d).where("index is null").select("recording_id", "item")


def transcript_text(s, d):
    return intervals.transcript(fx.speech(s, d))


def _evidence_texts(s, d):
    """Whole texts; shell lines before two fifths of them or code before a fifth, as the tables hold neither."""
    doc = fx.table(s, d, "documents")
    shell = "$ npm run build\nerror: failed\n> git status\n# done\n"
    code = "function a() {\n  return b === c;\n}\nconst x = () => y;\n"
    v = F.pmod("doc_id", F.lit(5))
    return doc.select("doc_id", F.concat(F.when(v.isin(1, 3), shell).when(v == 2, code).otherwise(""), F.col("text")).alias("text"))


def text_evidence(s, d):
    return _evidence_texts(s, d).select("doc_id", *(c.cast("long").alias(k) for k, c in text.text_evidence(F.col("text")).items()))


def _facts(s, d):
    e = _evidence_texts(s, d).select("doc_id", *(c.alias(k) for k, c in text.text_evidence(F.col("text")).items()))
    part = lambda m, by: F.pmod(F.col("doc_id") * m, F.lit(by)) / float(by)
    return e.select(
        "doc_id", "shell_hits", "code_hits", "line_count", share(part(3, 11)).alias("text"), share(part(5, 13)).alias("picture"), share(part(7, 17)).alias("flat"), share(part(2, 7)).alias("dark"),
        share(part(11, 19)).alias("person"), F.pmod("doc_id", F.lit(3)).alias("objects"), part(13, 23).alias("motion"),
    )


def segment_kind(s, d):
    return _facts(s, d).select("doc_id", rules.first_kind().alias("kind"))


def kind_reason(s, d):
    named = _facts(s, d).withColumn("kind", rules.first_kind())
    return named.select("doc_id", "kind", rules.reason(F.col("kind")).alias("reason"))


def group_kinds(s, d):
    named = segment_kind(s, d).select(F.pmod("doc_id", F.lit(20)).alias("recording_id"), F.floor(F.col("doc_id") / 20).alias("index"), "kind")
    return rules.group_kinds(named)


def keywords(s, d):
    return text.keywords(fx.table(s, d, "documents").select(F.lit(1).alias("k"), "text"), "k").select("term", "n")


def top_keywords(s, d):
    return text.top_keywords(text.keywords(fx.table(s, d, "documents").select("source", "text"), "source"), "source", 40, 2)


def keywords_cjk(s, d):
    """Documents with their lower-case letters as Chinese characters, so that words are runs of these."""
    chinese = "".join(chr(0x4E00 + i) for i in range(26))
    runs = fx.table(s, d, "documents").select("source", F.translate("text", "abcdefghijklmnopqrstuvwxyz", chinese).alias("text"))
    return text.keywords(runs, "source").where(F.col("term") >= chr(0x4E00))


def _lines(s, d):
    row = fx.boxes(s, d).select("frame_id", "id", "x", "y", "w", "h", F.when(F.col("class") == 0, F.col("score")).alias("confidence"))
    return row.withColumn("text", F.when(F.pmod(F.col("id"), F.lit(4)) == 0, " ").otherwise(F.concat(F.lit("line "), F.col("id").cast("string"))))


def region_filter(s, d):
    return text.in_region(_lines(s, d), 12, 6, 20, 3).select("frame_id", "id")


def confidence_filter(s, d):
    return text.confident(_lines(s, d), 0.6).select("frame_id", "id")


def map_lines(s, d):
    corners = F.array(*(F.array(F.col("x") + a * F.col("w"), F.col("y") + b * F.col("h")) for a, b in ((0, 0), (1, 0), (1, 1))))
    moved = text.map_lines(_lines(s, d).withColumn("polygon", corners), 0.75, -20, 3)
    shown = F.array_join(F.transform(F.flatten("polygon"), lambda v: v.cast("string")), " ")
    return moved.select("frame_id", "id", "x", "y", "w", "h", "cx", "cy", shown.alias("polygon"))


def line_confidence(s, d):
    score = F.when(F.col("id") % 5 == 0, F.lit(float("nan"))).otherwise(F.col("score") * 1.7 - 0.6)
    return _lines(s, d).join(fx.boxes(s, d).select("frame_id", "id", "score"), ["frame_id", "id"]).select("frame_id", "id", media.confidence(F.col("confidence"), score).alias("confidence"))


def valid_segments(s, d):
    """Raw segments, some with a start, a reason or a score that is missing or no number."""
    raw = segments_raw(s, d)
    spoiled = raw.withColumns({"start": F.nullif("start", F.lit(0.0)), "reason": F.nullif("reason", F.lit("start")), "score": F.when(F.col("score") > 60, float("nan")).otherwise(F.col("score"))})
    return timeline.valid_segments(spoiled)


def reading_order(s, d):
    return text.reading_order(_lines(s, d), "frame_id").withColumn("ids", F.array_join(F.col("ids").cast("array<string>"), ","))


def attach_lines(s, d):
    """Lines of the frames that are an order's still."""
    o = fx.table(s, d, "orders")
    stills = o.select(F.col("o_orderkey").alias("still"), timeline.segment_id(F.col("o_custkey")).alias("segment_id"), (F.col("o_orderkey") / 4).alias("at"))
    return text.attach_lines(_lines(s, d).select(F.col("frame_id").alias("still"), "id"), stills)


def polygon_bbox(s, d):
    pts = F.array(F.array(F.col("x"), F.col("y") + 1), F.array(F.col("x") + F.col("w"), F.col("y")), F.array(F.col("x") + 2, F.col("y") + F.col("h")))
    return _lines(s, d).select("frame_id", "id", *(c.alias(k) for k, c in text.polygon_box(pts).items()))


def _sizes(s, d):
    return fx.table(s, d, "part").select("p_partkey", (F.col("p_partkey") % 1931 + 1).alias("w"), (F.col("p_size") * 37 + F.col("p_partkey") % 11 + 1).cast("long").alias("h"))


def fit_inside(s, d):
    w, h, scaled = media.fit_inside(F.col("w"), F.col("h"), 320)
    return _sizes(s, d).select("p_partkey", w.alias("width"), h.alias("height"), scaled.alias("scaled"))


def analysis_size(s, d):
    w, h = media.analysis_size(F.col("w"), F.col("h"), 320)
    return _sizes(s, d).select("p_partkey", w.alias("width"), h.alias("height"))


def letterbox(s, d):
    return _sizes(s, d).select("p_partkey", media.letterbox_pad(F.col("w"), 640).alias("pad_x"), media.letterbox_pad(F.col("h"), 640).alias("pad_y"))


def ocr_scale(s, d):
    return _sizes(s, d).select("p_partkey", media.read_scale(F.col("w"), F.col("h")).alias("scale"))


def half_decode(s, d):
    bits = F.pmod(F.col("p_partkey") * 7919, F.lit(31744)) + F.when(F.col("p_size") % 2 == 0, 32768).otherwise(0)
    return fx.table(s, d, "part").select("p_partkey", finite_or_null(media.half_to_float(bits.cast("int"))).alias("value"))


def parse_rate(s, d):
    r = F.col("p_partkey") % 6
    text_ = F.when(r == 0, "30000/1001").when(r == 1, "0/0").when(r == 2, "").when(r == 3, F.concat(F.col("p_size").cast("string"), F.lit("/1"))).when(r == 4, "25").otherwise(F.concat(F.lit("24000/"), (F.col("p_size") + 990).cast("string")))
    return fx.table(s, d, "part").select("p_partkey", media.parse_rate(text_).alias("rate"))


def rotation(s, d):
    tag = F.when(F.col("p_size") % 3 == 0, (F.col("p_size") * 90).cast("int"))
    side = F.when(F.col("p_size") % 3 == 1, (F.col("p_size") * 90 - 900).cast("int"))
    return fx.table(s, d, "part").select("p_partkey", media.rotation(tag, side).cast("long").alias("degrees"))


def rate_check(s, d):
    rate = F.when(F.col("p_size") % 10 != 0, F.col("p_size").cast("double"))
    return fx.table(s, d, "part").select("p_partkey", media.constant_rate(rate, F.col("p_size") + (F.col("p_partkey") % 5) * 0.1).alias("constant"))


def language_tag(s, d):
    names = F.element_at(F.array(*map(F.lit, ("ch", " EN ", "japan", "fr-FR", "??", "", "zh-TW", "de"))), (F.col("p_partkey") % 8 + 1).cast("int"))
    return fx.table(s, d, "part").select("p_partkey", media.language_tag(names).alias("tag"))


def container_for(s, d):
    names = F.element_at(F.array(*map(F.lit, ("a.mp4", "b.M4V", "c.x.mov", "d.mkv", "e.wav", "f", "g.txt", "dir.mp3/h"))), (F.col("p_partkey") % 8 + 1).cast("int"))
    return fx.table(s, d, "part").select("p_partkey", media.container_for(names).alias("container"))


def escape_value(s, d):
    return fx.table(s, d, "part").select("p_partkey", media.escaped(F.concat(F.lit("C:\\"), F.col("p_name"), F.lit("'s"))).alias("escaped"))


def tail_lines(s, d):
    return fx.table(s, d, "documents").select("doc_id", media.tail_lines(F.col("text"), 2).alias("tail"))


def last_json_line(s, d):
    body = F.concat(F.lit("log\n{\"k\": 1}\n"), F.col("props"), F.lit("\n{broken\nend"))
    return fx.table(s, d, "events").select("event_id", media.last_json_line(body).alias("json"))


def tensor_layout(s, d):
    a, b = F.col("p_partkey") % 40, F.col("p_size").cast("long") * 30
    return fx.table(s, d, "part").select("p_partkey", media.tensor_layout(a, b).alias("layout"))


def _dealt_parts(s, d):
    """The parts dealt over the tasks of a shuffle: their file is small, so a few tasks would read it, but each row makes a text that takes long to read."""
    return fx.table(s, d, "part").select("p_partkey", "p_size", "p_retailprice").repartition(int(s.conf.get("spark.sql.shuffle.partitions")), "p_partkey")


def _reports(s, d):
    """Reports of a prober, some with turned, missing or odd facts, some that are no JSON."""
    k = F.col("p_partkey")
    told = lambda when, name, value: F.when(when, F.concat(F.lit(f'"{name}":"'), value.cast("string"), F.lit('",'))).otherwise("")
    tags = F.when(k % 4 == 1, '"tags":{"rotate":"90"},').when(k % 4 == 2, '"side_data_list":[{"type":"x"},{"rotation":-270}],').otherwise("")
    size = F.concat(F.when(k % 7 == 0, "").otherwise(F.concat(F.lit('"width":'), (F.col("p_size") * 10).cast("string"), F.lit(","))), F.lit('"height":100,'))
    rates = F.concat(told(k % 3 != 0, "avg_frame_rate", F.when(k % 5 == 0, "25/1").otherwise("30/1")), F.lit('"r_frame_rate":"30/1"'))
    video = F.concat(F.lit('{"index":1,"codec_type":"video","codec_name":"h264",'), tags, size, rates, F.lit("}"))
    audio = F.lit('{"index":0,"codec_type":"audio","codec_name":"aac","sample_rate":"48000","channels":2},')
    streams = F.when(k % 13 == 0, "").otherwise(F.concat(F.when(k % 2 == 0, audio).otherwise(""), video))
    length = told(k % 11 != 0, "duration", F.when(k % 19 == 0, F.lit("0")).otherwise(F.col("p_retailprice").cast("string")))
    report = F.concat(F.lit('{"streams":['), streams, F.lit('],"format":{'), length, F.lit('"format_name":"mov"}}'))
    return _dealt_parts(s, d).select("p_partkey", F.when(k % 17 == 0, "{broken").otherwise(report).alias("report"))


def probe_facts(s, d):
    shown = ("readable", "container", "duration", "video_codec", "width", "height", "coded_width", "rotation", "rate", "real_rate", "constant", "video_seconds", "audio_codec", "sample_rate", "channels")
    facts = _reports(s, d).select("p_partkey", sources.probe_struct(F.col("report")).alias("facts"))
    return facts.select("p_partkey", *(f"facts.{k}" for k in shown), F.array_join("facts.problems", ";").alias("problems"))


def parse_devices(s, d):
    c = fx.table(s, d, "supplier")
    kind = F.when(F.col("s_suppkey") % 2 == 0, "video").otherwise("audio")
    line = F.concat(
        F.lit('[dshow @ 01]  "'), F.col("s_name"), F.lit('" ('), kind, F.lit(")\n[dshow @ 01] noise"),
        F.when(F.col("s_suppkey") % 3 == 0, F.concat(F.lit('\n[dshow @ 01]    Alternative name "@device_'), F.col("s_suppkey").cast("string"), F.lit('"'))).otherwise(""),
    )
    logs = c.groupBy(F.col("s_nationkey").alias("log_id")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("s_suppkey", line.alias("line")))), lambda r: r["line"]), "\n").alias("text"))
    return sources.parse_devices(logs)


def wav_header(s, d):
    """Texts as the data of a WAV whose sizes are not filled in, after a chunk of odd size; every tenth has no chunk of data."""
    data = F.encode(F.coalesce("text", F.lit("")), "utf-8")
    empty = F.unhex(F.lit("FFFFFFFF"))
    name = F.when(F.col("doc_id") % 10 == 9, F.lit("note")).otherwise(F.lit("data"))
    head = F.concat(F.encode(F.lit("RIFF"), "utf-8"), empty, F.encode(F.lit("WAVELIST"), "utf-8"), F.unhex(F.lit("0300000041424300")), F.encode(name, "utf-8"), empty)
    made = sources.repair_wav(fx.table(s, d, "documents").select("doc_id", F.concat(head, data).alias("content")))
    return made.select("doc_id", "data_offset", "data_bytes", "problem", F.hex(F.substring("repaired", 5, 4)).alias("riff_size"), F.hex(F.substring("repaired", 29, 4)).alias("data_size"))


def half_encode(s, d):
    """Values a little above those of a half: what is beyond its ten digits is cut off."""
    bits = F.pmod(F.col("p_partkey") * 7919, F.lit(31744)) + F.when(F.col("p_size") % 2 == 0, 32768).otherwise(0)
    value = media.half_to_float(bits.cast("int")) * (1 + 2.0**-12)
    return fx.table(s, d, "part").select("p_partkey", media.float_to_half(value).alias("bits"))


def input_tensor(s, d):
    made = _colour_frames(s, d).select("frame_id", F.posexplode(media.input_tensor(F.col("pixels"), 8, 8, 12, 2, 2)).alias("i", "value"))
    return made.where("value > 0").select("frame_id", "i", F.col("value").cast("double").alias("value"))


def scale_factor(s, d):
    return _sizes(s, d).select("p_partkey", media.scale_factor(F.col("w"), F.col("h") % 5).alias("factor"))


def merged_options(s, d):
    defaults = F.create_map(*map(F.lit, ("codec", "h264", "crf", "23", "preset", "fast")))
    given = F.create_map(F.lit("crf"), F.when(F.col("p_size") % 3 == 0, "").when(F.col("p_size") % 3 == 1, F.col("p_size").cast("string")), F.lit("fps"), F.nullif(F.col("p_size") % 2, F.lit(0)).cast("string"))
    merged = media.merged_options(defaults, F.when(F.col("p_partkey") % 5 != 0, given))
    shown = F.transform(F.array_sort(F.map_entries(merged)), lambda e: F.concat(e["key"], F.lit("="), e["value"]))
    return fx.table(s, d, "part").select("p_partkey", F.array_join(shown, " ").alias("options"))


def clamped_numbers(s, d):
    """Numbers as texts, some that are none, with what holds instead and a floor."""
    said = F.when(F.col("p_partkey") % 4 == 0, "NaN").when(F.col("p_partkey") % 4 == 1, "").when(F.col("p_partkey") % 4 == 2, F.col("p_size").cast("string")).otherwise(F.concat(F.lit("-"), F.col("p_size").cast("string"), F.lit(".5")))
    return fx.table(s, d, "part").select("p_partkey", number_or(said, 7).alias("number"), clamped_or(said, 7, 10).alias("clamped"))


def resolve_setting(s, d):
    call = F.when(F.col("p_size") % 3 == 0, float("nan")).when(F.col("p_size") % 3 == 1, F.col("p_retailprice").cast("double"))
    config = F.when(F.col("p_partkey") % 2 == 0, F.col("p_size").cast("double")).otherwise(float("-inf"))
    return fx.table(s, d, "part").select("p_partkey", media.setting(call, config, F.lit(4.0)).alias("value"))


def parse_region(s, d):
    said = F.concat_ws(", ", (F.col("p_size") - 10.5).cast("string"), (F.col("p_partkey") % 7).cast("string"), (F.col("p_size") + 0.5).cast("string"), F.lit("4.4"))
    t = fx.table(s, d, "part").select("p_partkey", media.region(F.when(F.col("p_partkey") % 9 != 0, said)).alias("r"))
    return t.select("p_partkey", "r.x", "r.y", "r.width", "r.height")


def analysis_notes(s, d):
    c, n = F.col("p_partkey"), F.col("p_size").cast("long")
    notes = media.analysis_notes(n % 5, c % 3, n, F.lit(30), (c % 4) / 2, (n % 5) / 4, F.lit(1.0))
    return fx.table(s, d, "part").select("p_partkey", F.array_join(notes, "; ").alias("notes"))


def capture_verdict(s, d):
    o = fx.table(s, d, "orders").select("o_orderkey", "o_custkey", (F.col("o_totalprice") / 1000).alias("asked"), (F.lit(0.8) + (F.col("o_orderkey") % 26) / 100).alias("part"), (F.lit(0.85) + (F.col("o_custkey") % 16) / 100).alias("kept"))
    c = o.withColumn("dur", F.when(F.col("o_orderkey") % 17 != 0, F.col("asked") * F.col("part"))).withColumn("frames", F.when(F.col("o_orderkey") % 19 != 0, F.floor(half_up(F.col("asked") * F.col("part") * 30) * F.col("kept") * (F.col("o_custkey") % 23 != 0).cast("int"))))
    verdict = media.capture_verdict(F.col("asked"), F.col("dur"), F.col("frames"), F.lit(30.0), F.col("o_custkey") % 2 == 0, F.col("o_custkey") % 3 != 0, F.col("o_orderkey") % 29 != 0)
    return c.select("o_orderkey", *(v.alias(k) for k, v in verdict.items() if k != "notes"), F.array_join(verdict["notes"], "; ").alias("notes"))


def missing_needs(s, d):
    have = fx.table(s, d, "lineitem").select("l_orderkey", "l_returnflag").distinct()
    needs = F.array(F.lit("A"), F.lit("N"), F.lit("R"))
    return have.groupBy("l_orderkey").agg(F.collect_list("l_returnflag").alias("have")).select("l_orderkey", F.array_join(media.missing_needs(F.col("have"), needs), ",").alias("missing"))


def time_grid(s, d):
    dur = fx.speech(s, d).groupBy("recording_id").agg(F.max("s_end").alias("duration"))
    return timeline.time_grid(dur, 8)


def parse_list(s, d):
    line = F.concat(F.lit(" V..... "), F.col("event_type"), F.lit("   text of it"))
    rows = F.transform(F.array_sort(F.collect_list(F.struct("event_id", line.alias("line")))), lambda r: r["line"])
    listings = fx.table(s, d, "events").groupBy(F.col("user_id").alias("list_id")).agg(F.concat(F.lit("Encoders:\n ------\n"), F.array_join(rows, "\n")).alias("text"))
    return sources.parse_list(listings)


def analysis_probe(s, d):
    size = sources.try_stream_size(F.col("report"))
    return _reports(s, d).select("p_partkey", size.alias("size")).select("p_partkey", *(c.alias(k) for k, c in sources.probed_analysis_size(F.col("size"), 320).items()))


def lossless_json(s, d):
    v = F.when(F.col("event_id") % 4 == 0, float("nan")).when(F.col("event_id") % 4 == 1, float("inf")).when(F.col("event_id") % 4 == 2, F.lit(-0.0)).otherwise(F.floor("value").cast("double"))
    return fx.table(s, d, "events").select("event_id", documents.json_of({"v": (v, T.DoubleType()), "t": (F.col("event_type"), T.StringType())}).alias("json"))


def frame_split(s, d):
    """Conversations as streams of bytes, a chunk a turn, cut into frames of 64 bytes that reach over turns."""
    chunks = fx.table(s, d, "conversations").select(F.col("conv_id").alias("stream_id"), F.col("turn").alias("seq"), F.encode(F.coalesce("text", F.lit("")), "utf-8").alias("content"))
    return sources.split_frames(chunks, 64).select("stream_id", "i", F.sha2("frame", 256).alias("frame"))


def _configs(s, d):
    """Configurations out of parts: numbers in and out of bounds, texts for numbers, unknown choices, some that are no JSON."""
    k, size = F.col("p_partkey"), F.col("p_size")
    fps = F.when(k % 5 == 0, '"4"').when(k % 5 == 1, "null").otherwise((size / 4).cast("string"))
    provider = F.when(k % 7 == 0, '"other"').when(k % 7 == 1, "3").otherwise('"off"')
    scale = F.when(k % 6 == 0, '"auto"').when(k % 6 == 1, '"big"').otherwise((size % 5).cast("string"))
    analysis = F.concat(F.lit('{"fps":'), fps, F.lit(',"maxSide":'), (size * 10).cast("string"), F.lit(',"tileSize":'), (size % 3).cast("string"), F.lit(".5}"))
    text_ = F.concat(F.lit('{"maxConcurrent":'), (size % 10).cast("string"), F.lit(',"analysis":'), F.when(k % 13 == 0, "7").otherwise(analysis), F.lit(',"ocr":{"provider":'), provider, F.lit(',"scale":'), scale, F.lit('},"asr":{"enabled":'), F.when(k % 4 == 0, "1").otherwise("false"), F.lit("}}"))
    return _dealt_parts(s, d).select("p_partkey", F.when(k % 17 == 0, "{broken").when(k % 17 != 1, text_).alias("config"))


def config_violations(s, d):
    return _configs(s, d).select("p_partkey", F.posexplode(settings.violations(F.col("config"))).alias("no", "v")).select("p_partkey", "no", "v.field", "v.problem")


def config_completed(s, d):
    sound = _configs(s, d).where(F.size(settings.violations(F.col("config"))) == 0)
    shown = ("maxConcurrent", "analysis_fps", "analysis_maxSide", "analysis_tileSize", "analysis_mergeShortSec", "ocr_provider", "ocr_scale", "asr_enabled", "asr_language")
    asked = tuple(x for x in settings.SETTINGS if x.field.replace(".", "_") in shown)
    return sound.select("p_partkey", settings.completed_struct(F.col("config"), asked).alias("holds")).select("p_partkey", "holds.*")


def _silence_rows(s, d):
    """A row a silence with the recording's duration; one without start for recordings that have none."""
    spoken = fx.speech(s, d)
    return spoken.groupBy("recording_id").agg(F.max("s_end").alias("duration")).join(fx.silences(spoken), "recording_id", "left")


def speech_intervals_sql(s, d):
    tables.register(s)
    return s.sql("SELECT * FROM speech_intervals(TABLE({rows}), 10.0D, 0.25D)", rows=_silence_rows(s, d))


def plan_cuts_sql(s, d):
    tables.register(s)
    return s.sql("SELECT * FROM plan_cuts(TABLE({rows}), 8.0D, 6.0D)", rows=_silence_rows(s, d))


LIMITS = fusion.Limits(text_frames=5, object_frames=4)


def _parts(s, d) -> dict[str, DataFrame]:
    """The sections' rows. A segment's still is number recording * 7 + index, taken if there is a vector of that number; the vector is its frame, the document of that number
    its text, the boxes of that frame its objects. Some sections are switched off for some recordings, some stills fail."""
    key, c = fusion.KEY, F.col
    segs = written(segments_final(s, d), "segments")
    still = timeline.keyframe_plan(segs, 6).select(*key, "at", (c("recording_id") * 7 + c("index")).alias("still"))
    stills = written(still.join(fx.table(s, d, "embeddings").select(c("vec_id").alias("still")), "still", "left_semi"), "stills")
    number = stills.select(*key, "still")
    # tiles, lines and boxes are worked out for the frames that are stills; no other frame meets a segment
    shares = tiles.area_shares(_tiles(s, d, number)).select(c("frame_id").alias("still"), F.struct(*tiles.LABELS).alias("shares"))
    blocks = fusion.per_segment(tiles.frame_blocks(fx.gray_frames(s, d, number), 8, 8, 4).select(F.lit(0).alias("recording_id"), c("frame_id").alias("index"), "y", "x", "label", "width", "height", "tiles", "area_ratio"), "blocks", ["y", "x"]).select(c("index").alias("still"), "blocks")
    regions = number.where("still % 11 <> 0").join(shares, "still").join(blocks, "still").select(*key, "shares", "blocks")
    page = fx.of_frames(fx.table(s, d, "documents"), "doc_id", number).select(c("doc_id").alias("still"), F.posexplode(F.split("text", "\n")).alias("line", "text")).where(text.has_text(c("text")))
    lines = number.join(page, "still").select(*key, "line", "text", F.lit(None).cast("double").alias("confidence"), F.lit(0).alias("x"), (c("line") * 20).alias("y"), (F.length("text") * 8).alias("w"), F.lit(16).alias("h"))
    labelled = _labelled(s, d, number)
    kept = labelled.join(bx.suppress(labelled).select("frame_id", "id"), ["frame_id", "id"])
    objects = number.join(kept.withColumnRenamed("frame_id", "still"), "still").select(*key, "id", "label", "score", "x", "y", "w", "h")
    spoken = fx.speech(s, d).where("recording_id % 4 <> 2").select("recording_id", "item", (c("s_start") + F.when(c("recording_id") % 9 == 5, 10_000.0).otherwise(0.0)).alias("s_start"), (c("s_end") + F.when(c("recording_id") % 9 == 5, 10_000.0).otherwise(0.0)).alias("s_end"), "text")
    recordings = segs.select("recording_id").distinct()
    off = lambda section, when, reason: recordings.where(when).select("recording_id", F.lit(section).alias("section"), F.lit(False).alias("available"), F.lit(reason).alias("reason"))
    silent = recordings.join(spoken, "recording_id", "left_anti").select("recording_id", F.lit("speech").alias("section"), F.lit(False).alias("available"), F.lit("no audio").alias("reason"))
    status = off("text", "recording_id % 7 = 3", "the reader is off").unionByName(off("objects", "recording_id % 5 = 4", "no model")).unionByName(silent)
    failed = lambda section, when, message: number.where(when).select(*key, F.lit(section).alias("section"), F.lit(message).alias("message"))
    failures = failed("regions", "still % 11 = 0", "no pixels").unionByName(failed("objects", "still % 13 = 5 AND recording_id % 5 <> 4", "out of memory"))
    return {"segments": segs, "stills": stills, "regions": regions, "lines": lines, "objects": objects, "spoken": spoken, "status": status, "failures": failures}


def _fused(s, d):
    parts = _parts(s, d)
    return fusion.fuse(**parts, limits=LIMITS), parts


def _documents(s, d):
    fused, p = _fused(s, d)
    return fusion.documents(fused, fusion.lines_read(p["lines"], p["stills"], p["status"], LIMITS), p["spoken"], p["status"], p["failures"], LIMITS)


def fuse_segments(s, d):
    c = F.col
    return _fused(s, d)[0].select(
        *fusion.KEY, "id", "start", "end", "keyframe_at", *(c("appearances")[k].alias(f"share_{k}") for k in tiles.LABELS), F.size("region_blocks").alias("blocks"), F.size("text_lines").alias("text_lines"), F.sha2("text", 256).alias("text_sha256"),
        F.size("objects").alias("objects"), c("evidence.person").alias("person"), c("speech.text").alias("speech"), c("speech.overlap_seconds").alias("overlap_seconds"), "kind", "kind_reason",
    )


def doc_summary(s, d):
    kinds = F.transform(F.map_entries("summary.kinds"), lambda e: F.concat(e["key"], F.lit(":"), F.array_join(F.transform(e["value"], lambda i: i.cast("string")), ",")))
    counts = F.transform("counts", lambda x: F.concat(x["label"], F.lit(":"), x["n"].cast("string")))
    return _documents(s, d).select("recording_id", *(F.col(f"summary.{k}").alias(k) for k in ("segment_count", "text_lines", "objects", "speech_intervals", "duration")), F.array_join(kinds, ";").alias("kinds"), F.array_join(counts, ";").alias("counts"), *(F.col("shares")[k].alias(f"share_{k}") for k in tiles.LABELS))


def doc_sections(s, d):
    p = _parts(s, d)
    return fusion.sections(p["segments"].select("recording_id").distinct(), p["status"])


def doc_keywords(s, d):
    return _documents(s, d).select("recording_id", F.posexplode("keywords").alias("no", "k")).select("recording_id", "no", "k.term", "k.n")


def doc_warnings(s, d):
    return _documents(s, d).select("recording_id", F.array_join("warnings", "; ").alias("warnings"))


def structure_document(s, d):
    return fusion.as_json(_documents(s, d))


QUERIES = {
    f.__name__: f
    for f in (
        frame_diffs, luma_diff, segments_raw, segments_grown, segments_merged, segments_capped, segments_final, keyframe_plan, keyframe_left_join, spread_sample, head_limit, chapters,
        tile_stats, tile_stats_color, tile_label, area_shares, mean_shares, tile_blocks, iou_pairs, nms, object_counts, person_score, score_filter, decode_candidates, decode_detections, speech_intervals, parse_silences, plan_cuts, merge_intervals, speech_overlap,
        assign_segments, assign_unplaced, transcript_text, text_evidence, segment_kind, kind_reason, group_kinds, keywords, top_keywords, keywords_cjk, region_filter, confidence_filter, map_lines, line_confidence, valid_segments, reading_order, attach_lines,
        polygon_bbox, fit_inside, analysis_size, letterbox, ocr_scale, half_decode, half_encode, input_tensor, scale_factor, merged_options, clamped_numbers, resolve_setting, parse_region, analysis_notes, parse_devices, wav_header, parse_rate, rotation, rate_check, language_tag, container_for, escape_value, tail_lines, last_json_line, tensor_layout,
        probe_facts, capture_verdict, missing_needs, time_grid, parse_list, analysis_probe, lossless_json, frame_split, fuse_segments, config_violations, config_completed, speech_intervals_sql, plan_cuts_sql, doc_summary, doc_sections, doc_keywords, doc_warnings, structure_document,
    )
}
