"""Known values of the operators, and the stream against the batch."""

import pandas as pd
import pytest
from pyspark.sql import functions as F

from frameflow.functions import media
from frameflow.operators import boxes, intervals, text, tiles, timeline
from frameflow.sources import media as sources

RULES = timeline.CutRules(scene=40.0, min_seconds=1.0, max_seconds=30.0)


def cut(spark, frames, rules=RULES):
    rows = [(1, i, float(t), float(d)) for i, (t, d) in enumerate(frames)]
    return [tuple(r) for r in timeline.cut_segments(spark.createDataFrame(rows, "recording_id bigint, seq bigint, t double, diff double"), rules).orderBy("start").collect()]


def test_scene_change_does_not_count_its_frame(spark):
    got = cut(spark, [(0, 0), (0.25, 0), (0.5, 0), (0.75, 0), (1, 50), (2, 0)])
    assert [(r[1], r[2], r[3], r[4], r[5], r[6]) for r in got] == [(0, 1, "start", 0, 0, 3), (1, 1.5, "scene_change", 50, 0, 1)]


def test_short_segments_are_not_cut(spark):
    assert [(r[5], r[6]) for r in cut(spark, [(0, 0), (0.25, 60), (0.5, 0)])] == [(60, 2)]


def test_cadence(spark):
    got = cut(spark, [(i / 4, 0) for i in range(10)], timeline.CutRules(40.0, 1.0, 2.0))
    assert (got[0][2], got[0][6], got[1][3], got[1][1]) == (2, 8, "cadence", 2)


def test_motion_before_a_cut(spark):
    rules = timeline.CutRules(scene=12.0, min_seconds=0.5)
    assert cut(spark, [(0, 0), (0.25, 5), (0.5, 5), (0.75, 5), (1, 50)], rules)[1][3] == "motion"
    assert cut(spark, [(0, 0), (0.25, 5), (0.5, 5), (0.75, 0), (1, 50)], rules)[1][3] == "scene_change"


def merged(spark, spans, rules):
    rows = [(1, a, b, "scene_change", 0.0, 0.0, 0, 0.0) for a, b in spans]
    df = spark.createDataFrame(rows, timeline.RAW)
    return [(r.start, r.end) for r in timeline.absorb_short(timeline.grow_short(df, rules), rules).orderBy("start").collect()]


def test_merging(spark):
    assert merged(spark, [(0.0, 2.0), (2.0, 2.4), (2.4, 6.0)], timeline.CutRules(max_seconds=30.0)) == [(0, 2), (2, 6)]
    assert merged(spark, [(0.0, 2.0), (2.0, 2.8), (2.8, 5.0)], timeline.CutRules(min_seconds=0.5, max_seconds=30.0, short_seconds=1.0)) == [(0, 2.8), (2.8, 5)]
    assert merged(spark, [(0.0, 2.0), (2.0, 2.5)], timeline.CutRules(min_seconds=0.5, max_seconds=2.2, short_seconds=1.0)) == [(0, 2), (2, 2.5)]
    assert merged(spark, [(5.0, 5.0)], RULES) == []


def test_speech_intervals(spark):
    def got(silences, duration, longest=25.0):
        s = spark.createDataFrame([(1, float(a), float(b)) for a, b in silences], "recording_id bigint, start double, end double")
        d = spark.createDataFrame([(1, float(duration))], "recording_id bigint, duration double")
        return sorted((r.start, r.end) for r in intervals.speech_intervals(s, d, longest).collect())

    assert got([(2, 3), (6, 8)], 10) == [(0, 2), (3, 6), (8, 10)]
    assert [a for a, _ in got([(0.5, 0.95)], 1)] == [0]
    assert len(got([], 30, 10.0)) == 3


def test_merge_intervals(spark):
    rows = [(1, 2.0 * i, 2.0 * i + 1) for i in range(10)] + [(2, 0.0, 100.0)]
    df = spark.createDataFrame(rows, "recording_id bigint, start double, end double")
    got = intervals.merge_intervals(df, 3, 60.0).collect()
    one = sorted((r.start, r.end) for r in got if r.recording_id == 1)
    assert len(one) <= 3 and one[0][0] == 0 and one[-1][1] == 19
    assert sorted(r.seconds for r in intervals.merge_intervals(df.where("recording_id = 2"), 60, 30.0).collect()) == [10, 30, 30, 30]


def test_plan_cuts(spark):
    d = spark.createDataFrame([(1, 25.0), (2, 25.0)], "recording_id bigint, duration double")
    s = spark.createDataFrame([(1, 9.0, 9.5)], "recording_id bigint, start double, end double")
    got = sorted(tuple(r) for r in intervals.plan_cuts(d, s, 10.0).collect())
    assert got == [(1, 9.0, False), (1, 19.0, True), (2, 10.0, True), (2, 20.0, True)]


def test_overlap_text(spark):
    seg = spark.createDataFrame([(1, 1, 1.0, 3.0), (1, 2, 4.1, 6.0)], "recording_id bigint, index int, start double, end double")
    said = spark.createDataFrame([(1, 0.0, 2.0, "a"), (1, 2.0, 4.0, "b"), (1, 10.0, 12.0, "c")], "recording_id bigint, s_start double, s_end double, text string")
    assert [tuple(r) for r in intervals.text_within(seg, said).collect()] == [(1, 1, 2.0, "a b")]


def test_silence_log(spark):
    log = spark.createDataFrame([(1, "x\nsilence_end: 0.5\nsilence_start: 1.5\nsilence_end: 2.5 | d: 1\nsilence_start: 9\n")], "recording_id bigint, text string")
    assert sorted(tuple(r) for r in intervals.parse_silences(log).collect()) == [(1, 1.5, 2.5), (1, 9.0, None)]


def frame(spark, w, h, paint, tile):
    df = spark.createDataFrame([(1, [float(paint(i % w, i // w)) for i in range(w * h)])], "frame_id bigint, pixels array<double>")
    return tiles.tile_stats(df, w, h, tile)


def test_tiles(spark):
    flat = frame(spark, 32, 32, lambda x, y: 128, 16)
    assert [r.label for r in flat.collect()] == ["flat"] * 4 and tiles.area_shares(flat).first().flat == 1.0
    block = tiles.merge_blocks(flat).collect()
    assert len(block) == 1 and (block[0].width, block[0].height, block[0].area_ratio) == (32, 32, 1.0)
    checker = frame(spark, 8, 8, lambda x, y: 255 * ((x + y) % 2), 16).first()
    assert (checker.label, checker.edge_density) == ("text", 0.875)
    odd = sorted((r.x, r.y, r.width, r.height) for r in frame(spark, 40, 20, lambda x, y: 0, 16).collect())
    assert odd == [(0, 0, 16, 20), (16, 0, 24, 20)]
    thirds = tiles.area_shares(frame(spark, 48, 16, lambda x, y: 128 if x < 16 else 0 if x < 32 else 255 * ((x + y) % 2), 16)).first()
    assert (thirds.text, thirds.flat, thirds.dark) == (0.3334, 0.3333, 0.3333)


def test_suppression(spark):
    df = spark.createDataFrame([(1, 1, 0, 0.9, 0, 0, 10, 10), (1, 2, 0, 0.8, 1, 0, 10, 10), (1, 3, 1, 0.7, 1, 0, 10, 10), (1, 4, 0, 0.6, 5, 0, 10, 10)], "frame_id bigint, id bigint, class bigint, score double, x long, y long, w long, h long")
    assert sorted(r.id for r in boxes.suppress(df).collect()) == [1, 3, 4]


def test_keywords(spark):
    df = spark.createDataFrame([(1, "npm run build. the build failed. 开始 开始演示 演示")], "k int, text string")
    got = {r.term: r.n for r in text.keywords(df, "k").collect()}
    assert got["build"] == 2 and got["开始"] == 2 and got["演示"] == 2 and "the" not in got and sorted(got.values()).count(2) == 3


def test_scalars(spark):
    row = spark.range(1).select(
        media.parse_rate(F.lit("30000/1001")).alias("a"), media.parse_rate(F.lit("0/0")).alias("b"), media.rotation(F.lit(None).cast("int"), F.lit(-90)).alias("c"),
        media.half_to_float(F.lit(0x3C00)).alias("d"), media.half_to_float(F.lit(0x7C00)).alias("e"), *media.fit_inside(F.lit(1920), F.lit(1080), 320), *media.analysis_size(F.lit(101), F.lit(51), 320),
        timeline.array_difference(F.array(F.lit(0), F.lit(100)), F.array(F.lit(10), F.lit(150))).alias("f"),
    ).first()
    assert (row[0], row[1], row[2], row[3], row[4]) == (29.97003, None, 90, 1.0, float("inf")) and tuple(row)[5:10] == (320, 180, True, 100, 50) and row.f == 30


def _tensor(spark, data, d1, d2, pads=(0, 0), factor=1.0, size=(1920, 1080)):
    schema = "frame_id bigint, data array<double>, d1 int, d2 int, pad_x int, pad_y int, factor double, width int, height int"
    return spark.createDataFrame([(1, [float(x) for x in data], d1, d2, *pads, factor, *size)], schema)


def test_decode_channel_major(spark):
    data = [0.0] * (84 * 3)
    for channel, value in ((0, 320), (1, 320), (2, 100), (3, 100), (4, 0.9)):
        data[channel * 3] = value
    (r,) = boxes.detections(_tensor(spark, data, 84, 3)).collect()
    assert (r["class"], r.label, r.score, r.x, r.y, r.w, r.h, r.center_x, r.center_y, r["rank"]) == (0, "class_0", 0.9, 270, 270, 100, 100, 320, 320, 1)


def test_decode_objectness(spark):
    """Row major rows have an objectness; without it the second row's score would stand."""
    rows = [[0.0] * 85 for _ in range(2)]
    rows[0][:5], rows[0][5 + 2] = [100, 100, 40, 20, 0.5], 0.8
    rows[1][:5], rows[1][5] = [300, 300, 40, 20, 0.1], 0.9
    (r,) = boxes.decode(_tensor(spark, sum(rows, []), 2, 85, factor=2.0), labels=[f"name {i}" for i in range(80)]).collect()
    assert (r["class"], r.label, r.score, r.x, r.y, r.w, r.h) == (2, "name 2", 0.4, 160, 180, 80, 40)


def test_decode_padding_clip_and_layout(spark):
    one = lambda cx, cy, w, h: [cx, cy, w, h, 0.9, *[0.0] * 79]
    flat = lambda *rows: [r[c] for c in range(84) for r in rows]
    got = boxes.decode(_tensor(spark, flat(one(330, 330, 100, 100), one(0, 0, 1, 1)), 84, 2, (10, 20), 2.0)).where("id = 0").first()
    assert (got.x, got.y, got.w, got.h) == (540, 520, 200, 200)
    got = boxes.decode(_tensor(spark, flat(one(5, 5, 100, 100), one(0, 0, 1, 1)), 84, 2)).where("id = 0").first()
    assert (got.x, got.y, got.w, got.h) == (0, 0, 55, 55)
    assert boxes.decode(_tensor(spark, [1.0] * 6, 2, 3)).isEmpty()


def test_detections_keep_what_suppression_keeps(spark, sf_dir):
    from frameflow.plans import catalog

    tensors = catalog._tensors(spark, sf_dir)
    found = [tuple(r) for r in boxes.decode(tensors, 30.0).select("frame_id", "id", "class", "score", "x", "y", "w", "h").collect()]
    kept = set()
    for frame in {r[0] for r in found}:
        stay = []
        for r in sorted((r for r in found if r[0] == frame), key=lambda r: (-r[3], r[1])):
            def over(k, r=r):
                w, h = min(k[4] + k[6], r[4] + r[6]) - max(k[4], r[4]), min(k[5] + k[7], r[5] + r[7]) - max(k[5], r[5])
                return k[2] == r[2] and w > 0 and h > 0 and w * h / (k[6] * k[7] + r[6] * r[7] - w * h) > 0.45
            if len(stay) < 50 and not any(map(over, stay)):
                stay.append(r)
        kept |= {(r[0], r[1], i + 1) for i, r in enumerate(stay)}
    got = boxes.detections(tensors, 30.0)
    assert {(r.frame_id, r.id, r["rank"]) for r in got.collect()} == kept and kept


def test_confidence_and_capture(spark):
    df = spark.createDataFrame([(None, 1.7), (0.123456, None), (None, None), (-1.0, 0.5)], "c double, s double")
    assert [r[0] for r in df.select(media.confidence(F.col("c"), F.col("s"))).collect()] == [1.0, 0.1235, None, 0.0]
    takes = [(10.0, 10.0, 200, 30.0, False, False, True), (10.0, 8.0, 240, 30.0, False, False, True), (10.0, None, None, 30.0, True, True, True), (10.0, 10.0, 0, 30.0, False, True, True), (10.0, 10.0, 300, 30.0, True, False, True), (10.0, 10.0, 300, 30.0, False, False, False)]
    df = spark.createDataFrame(takes, "a double, d double, f long, r double, w boolean, h boolean, ok boolean")
    v = media.capture_verdict(*map(F.col, "adfrwh"), F.col("ok"))
    got = [tuple(r) for r in df.select(v["short_take"], v["dropped"], v["ok"], F.size(v["notes"])).collect()]
    assert got == [(False, True, True, 2), (True, False, False, 1), (None, False, True, 1), (False, True, False, 3), (False, False, False, 2), (None, False, False, 1)]


def test_merge_intervals_to_one_at_least(spark):
    df = spark.createDataFrame([(1, 0.0, 1.0), (1, 2.0, 3.0)], "recording_id bigint, start double, end double")
    assert [(r.start, r.end) for r in intervals.merge_intervals(df, 0, 30.0).collect()] == [(0.0, 3.0)]


def test_tiles_in_color(spark):
    frames = spark.createDataFrame([(1, [200.0, 100.0, 100.0] * 16), (2, [])], "frame_id bigint, pixels array<double>")
    got = tiles.tile_stats(frames, 4, 4, 4, channels=3).collect()
    assert [(r.frame_id, r.luma, r.std, r.saturation, r.label) for r in got] == [(1, 121.26, 0.0, 0.5, "flat")]
    strong = spark.createDataFrame([(1, [v for i in range(16) for v in ((255.0, 0.0, 0.0) if i % 2 else (0.0, 0.0, 255.0))])], "frame_id bigint, pixels array<double>")
    assert [r.label for r in tiles.tile_stats(strong, 4, 4, 4, channels=3).collect()] == ["picture"]
    with pytest.raises(Exception, match="a frame of 3 values where 48"):
        tiles.tile_stats(spark.createDataFrame([(1, [1.0, 2.0, 3.0])], frames.schema), 4, 4, 4, channels=3).collect()


@pytest.mark.parametrize(
    "value, bits",
    [(1.0, 0x3C00), (-2.0, 0xC000), (1.0009, 0x3C00), (65504.0, 0x7BFF), (65535.9, 0x7BFF), (65536.0, 0x7C00), (6e-5, 0), (2.0**-14, 0x0400), (-0.0, 0x8000), (float("nan"), 0x7C00), (float("-inf"), 0xFC00), (None, None)],
)
def test_half_encoding(spark, value, bits):
    df = spark.createDataFrame([(value,)], "v double")
    assert df.select(media.float_to_half(F.col("v"))).first()[0] == bits


@pytest.mark.parametrize("said, box", [("1,2,3,4", (1, 2, 3, 4)), (" -5 ,2.5, 10.5,4.4", (0, 3, 11, 4)), (",,5,5", (0, 0, 5, 5)), (None, None)])
def test_region_of_text(spark, said, box):
    got = spark.createDataFrame([(said,)], "t string").select(media.region(F.col("t")).alias("r")).first().r
    assert (tuple(got) if got else None) == box


@pytest.mark.parametrize("said", ["1,2,3", "1,2,x,4", "1,2,0,4", "1,2,3,-4", "", "1,2,3,4,5"])
def test_no_region(spark, said):
    with pytest.raises(Exception, match="no region"):
        spark.createDataFrame([(said,)], "t string").select(media.region(F.col("t")).alias("r")).collect()


def test_frames_reach_over_chunks(spark):
    chunks = spark.createDataFrame([(1, 0, b"ab"), (1, 1, b""), (1, 2, b"cdefghij"), (1, 3, None), (1, 4, b"klm"), (2, 0, b"x")], "stream_id bigint, seq bigint, content binary")
    got = sorted((r.stream_id, r.i, bytes(r.frame)) for r in sources.split_frames(chunks, 4).collect())
    assert got == [(1, 0, b"abcd"), (1, 1, b"efgh"), (1, 2, b"ijkl")]


def test_wav(spark):
    head = b"RIFF\xff\xff\xff\xffWAVEfmt \x02\0\0\0abdata\xff\xff\xff\xff"
    rows = [(1, head + b"12345"), (2, head), (3, b"RIFX"), (4, None), (5, b"RIFF0000WAVEnone\0\0\0\0")]
    got = {r.id: r for r in sources.repair_wav(spark.createDataFrame(rows, "id bigint, content binary")).collect()}
    assert bytes(got[1].repaired) == b"RIFF\x1b\0\0\0WAVEfmt \x02\0\0\0abdata\x05\0\0\0" + b"12345" and (got[1].data_offset, got[1].data_bytes) == (30, 5)
    assert [got[i].problem for i in range(1, 6)] == [None, "no data", "no WAV", "no WAV", "no data chunk"] and got[2].repaired is None


def test_probe_of_odd_reports(spark):
    rows = [(1, "null"), (2, None), (3, "{}"), (4, '{"streams":[{"codec_type":"video","tags":{"rotate":"-90"},"width":4,"height":3}],"format":{"duration":"N/A"}}')]
    facts = sources.probe_facts(F.col("t"))
    got = {r.id: r for r in spark.createDataFrame(rows, "id bigint, t string").select("id", *(c.alias(k) for k, c in facts.items())).collect()}
    assert [got[i].readable for i in (1, 2, 3, 4)] == [False, False, True, True]
    assert got[3].problems == ["no streams", "duration not told"] and (got[4].width, got[4].height, got[4].rotation, got[4].problems) == (3.0, 4.0, 270, ["duration not told"])
