"""As-of joins, interval merging, rectangles, counts and blanks: against plain versions on random and odd rows, and in time."""

import random
import time

import pytest
from pyspark.sql import functions as F

from frameflow.functions import media
from frameflow.functions.strings import has_text, trimmed
from frameflow.operators import boxes, fusion, intervals, text, tiles, timeline
from frameflow.sources import media as sources

ITEMS, SEGMENTS = "recording_id bigint, item bigint, s_start double, s_end double", "recording_id bigint, index bigint, start double, end double"


def placed(items, segments):
    """The segment of each midpoint, by looking at all segments of its recording."""
    out = []
    for rec, item, a, b in items:
        own = sorted((s for s in segments if s[0] == rec), key=lambda s: s[2])
        mid = (a + b) / 2 if a is not None and b is not None else None
        index = next((s[1] for s in own if mid is not None and s[2] <= mid < s[3]), None)
        if index is None and mid is not None and own and mid >= own[-1][3]:
            index = own[-1][1]
        out.append((rec, item, mid, index))
    return sorted(out, key=repr)


def test_midpoints_in_segments(spark):
    """Gaps, borders, midpoints before, past and far past the segments, recordings without segments, missing times, repeated items."""
    r = random.Random(3)
    segments, items = [], []
    for rec in range(4):
        at = r.uniform(0, 5)
        for index in range(1, 9):
            end = at + r.choice([0.5, 30.0, 200.0])
            segments.append((rec, index, at, end))
            at = end + r.choice([0.0, 0.0, 7.0])
    items = [(rec, i, x, x + r.choice([0.0, 4.0])) for rec in range(5) for i, x in enumerate(r.uniform(0, 900) for _ in range(60))]
    items += [(s[0], 1000 + s[1], s[2], s[2]) for s in segments] + [(s[0], 2000 + s[1], s[3], s[3]) for s in segments] + [(0, 5000, None, 1.0), (1, 5001, 1e7, 1e7), (2, 5002, -3.0, -1.0), (2, 5002, -3.0, -1.0)]
    got = intervals.assign_to_segments(spark.createDataFrame(items, ITEMS), spark.createDataFrame(segments, SEGMENTS)).collect()
    assert sorted(map(tuple, got), key=repr) == placed(items, segments)


def test_a_long_recording(spark):
    """100,000 items and 20,000 segments of one recording: no pair of an item and a foreign segment is made."""
    segments = spark.range(20_000).select(F.lit(1).cast("long").alias("recording_id"), (F.col("id") + 1).alias("index"), (F.col("id") * 3.0).alias("start"), (F.col("id") * 3.0 + 2).alias("end"))
    items = spark.range(100_000).select(F.lit(1).cast("long").alias("recording_id"), F.col("id").alias("item"), (F.col("id") * 0.6).alias("s_start"), (F.col("id") * 0.6 + 0.2).alias("s_end"))
    began = time.time()
    got = {r.item: r["index"] for r in intervals.assign_to_segments(items, segments).collect()}
    assert time.time() - began < 60 and len(got) == 100_000
    for i in range(0, 100_000, 997):
        n, rest = divmod(i * 0.6 + 0.1, 3.0)
        assert got[i] == (int(n) + 1 if rest < 2 else None)


def joined(pieces, most, longest):
    """The closest neighbours first, all costs anew for each join."""
    parts = [[a, b, b - a, 1] for a, b in pieces]
    while len(parts) > most:
        costs = [y[0] - x[1] + (x[2] + y[2]) * 0.01 for x, y in zip(parts, parts[1:])]
        i = costs.index(min(costs))
        x, y = parts[i], parts[i + 1]
        if y[1] - x[0] > longest:
            break
        parts[i : i + 2] = [[x[0], y[1], y[1] - x[0], x[3] + y[3]]]
    return [tuple(p) for p in parts]


@pytest.mark.parametrize("seed", range(40))
def test_closest_joined(seed):
    """Equal costs, touching and overlapping pieces, joins that would be too long."""
    r, at, pieces = random.Random(seed), 0.0, []
    for _ in range(r.randint(1, 60)):
        end = at + r.choice([0.5, 1.0, 2.0])
        pieces.append((at, end))
        at = end + r.choice([-0.25, 0.0, 0.5, 0.5, 3.0])
    most, longest = r.randint(1, 12), r.choice([2.0, 8.0, 1000.0])
    assert list(intervals.closest_joined(iter(pieces), most, longest)) == joined(pieces, most, longest)


def test_many_pieces():
    """200,000 pieces down to ten, in n log n."""
    r = random.Random(1)
    pieces, at = [], 0.0
    for _ in range(200_000):
        pieces.append((at, at + 1))
        at += 1 + r.random()
    began = time.time()
    assert len(list(intervals.closest_joined(pieces, 10, 1e9))) == 10 and time.time() - began < 20


def test_merge_intervals_of_recordings(spark):
    """Long intervals are chopped, and where the closest pair would be too long no other is joined; recordings don't meet; no rows, no rows out."""
    rows = [(1, 0.0, 50.0), (1, 51.0, 52.0), (2, 0.0, 1.0), (2, 1.5, 2.0), (2, 9.0, 10.0), (3, 5.0, 5.005)]
    df = spark.createDataFrame(rows, "recording_id bigint, start double, end double")
    got = sorted(map(tuple, intervals.merge_intervals(df, 2, 20.0).collect()))
    assert got == [(1, 0.0, 20.0, 20.0, 1), (1, 20.0, 40.0, 20.0, 1), (1, 40.0, 50.0, 10.0, 1), (1, 51.0, 52.0, 1.0, 1), (2, 0.0, 2.0, 2.0, 2), (2, 9.0, 10.0, 1.0, 1)]
    assert intervals.merge_intervals(df.limit(0), 2, 20.0).collect() == []


def covered(grid):
    """Rectangles by walking tiles: right, then down, over what is not taken."""
    rows, columns, taken, out = len(grid), len(grid[0]), set(), []
    for y in range(rows):
        for x in range(columns):
            if (y, x) in taken:
                continue
            free = lambda r, c: r < rows and c < columns and (r, c) not in taken and grid[r][c] == grid[y][x]  # noqa: B023, E731
            wide = next(w for w in range(1, columns + 1) if not free(y, x + w))
            high = next(h for h in range(1, rows + 1) if not all(free(y + h, c) for c in range(x, x + wide)))
            taken |= {(r, c) for r in range(y, y + high) for c in range(x, x + wide)}
            out.append((grid[y][x], x, y, wide, high))
    return out


@pytest.mark.parametrize("seed", range(30))
def test_rectangles(seed):
    r = random.Random(seed)
    columns, labels = r.randint(1, 90), r.choice([1, 2, 4])
    grid = [[r.randrange(labels) for _ in range(columns)] for _ in range(r.randint(1, 9))]
    rows = [{k: sum(1 << x for x in range(columns) if line[x] == k) for k in set(line)} for line in grid]
    assert list(tiles.rectangles(rows, columns)) == covered(grid)


def test_blocks_from_pixels_and_from_tiles(spark):
    """Both ways to the same rectangles, with uneven last tiles; a frame without pixels has none."""
    r = random.Random(7)
    frames = spark.createDataFrame([(i, [float(r.choice([0, 0, 120, 250])) for _ in range(11 * 7 * 3)]) for i in range(30)] + [(99, []), (98, None)], "frame_id bigint, pixels array<double>")
    direct = tiles.frame_blocks(frames, 11, 7, 2, channels=3)
    assert sorted(map(tuple, direct.collect())) == sorted(map(tuple, tiles.merge_blocks(tiles.tile_stats(frames, 11, 7, 2, channels=3)).collect()))
    areas = direct.groupBy("frame_id").agg(F.sum(F.col("width") * F.col("height")).alias("a")).collect()
    assert {x.a for x in areas} == {77} and len(areas) == 30


def test_label_counts_and_person(spark):
    """Ties in the order of a dictionary: small and capital letters together."""
    rows = [(1, x, s) for x, s in (("tv", 0.9), ("Book", 0.2), ("apple", 0.3), ("person", 0.4), ("person", 0.6), (None, 0.9))] + [(2, "person", float("nan")), (2, "person", -1.0)]
    found = spark.createDataFrame(rows, "frame_id bigint, label string, score double")
    assert [(r.label, r.n) for r in boxes.label_counts(found.where("frame_id = 1"), "frame_id").orderBy("rank").collect()] == [("person", 2), ("apple", 1), ("Book", 1), ("tv", 1)]
    assert {r.frame_id: r.person for r in boxes.person_score(found, "frame_id").collect()} == {1: 0.6, 2: 0.0}
    assert boxes.scored(spark.createDataFrame([(1, 0.5), (2, None), (3, 0.4)], "i int, score double"), 0.5).count() == 1


def test_keyword_ties(spark):
    """Marks before digits before letters, as Unicode's root collation has them; not the order of code points."""
    terms = spark.createDataFrame([(1, t, 2) for t in ("ab", "a+", "a1", "a_b", "a-b", "a.b", "a#", "émile", "zz")], "k int, term string, n int")
    assert [r.term for r in text.top_keywords(terms, "k").orderBy("rank").collect()] == ["a_b", "a-b", "a.b", "a#", "a+", "a1", "ab", "émile", "zz"]


def test_blanks(spark):
    """Tabs, no-break and wide spaces, separators and byte order marks are blanks."""
    said = ["\t", " 　", "﻿ ", "\x0b", "", None, "\t a b \n", "x"]
    rows = spark.createDataFrame([(i, s) for i, s in enumerate(said)], "i int, text string").select("i", has_text(F.col("text")).alias("has"), trimmed(F.col("text")).alias("t")).orderBy("i").collect()
    assert [r.has for r in rows] == [False] * 6 + [True, True] and [r.t for r in rows] == ["", "", "", "", "", None, "a b", "x"]
    spoken = spark.createDataFrame([(1, 0.0, 1.0, "\t"), (1, 1.0, 2.0, " word\t"), (2, 0.0, 1.0, " ")], "recording_id bigint, s_start double, s_end double, text string")
    segments = spark.createDataFrame([(1, 1, 0.0, 5.0), (2, 1, 0.0, 5.0)], SEGMENTS)
    assert [tuple(r) for r in intervals.text_within(segments, spoken).collect()] == [(1, 1, 2.0, "word")]
    assert [(r.recording_id, r.spoken) for r in intervals.transcript(spoken).collect()] == [(1, 1)]


def test_small_functions(spark):
    def one(column):
        return spark.range(1).select(column.alias("v")).first().v

    nan = F.lit(float("nan"))
    assert one(media.confidence(nan, F.lit(0.5))) is None and one(media.confidence(F.lit(None).cast("double"), F.lit(1.5))) == 1.0
    assert one(media.missing_needs(F.array(F.lit("b")), F.array(F.lit("c"), F.lit("b"), F.lit("a")))) == ["c", "a"] and one(media.missing_needs(F.lit(None).cast("array<string>"), F.array(F.lit("a")))) == ["a"]
    grid = timeline.time_grid(spark.createDataFrame([(1, 9.0), (2, None), (3, 0.0)], "recording_id bigint, duration double"), 1)
    assert [tuple(r) for r in grid.collect()] == [(1, 0, 4.5)]
    sizes = {'{"streams":[{"width":641.9,"height":"480"},{"width":1,"height":1}]}': (641, 480), '{"streams":[]}': None, "{": None, '{"streams":[{"width":0,"height":4}]}': None}
    for report, want in sizes.items():
        got = one(sources.try_stream_size(F.lit(report)))
        assert (tuple(got) if got else None) == want
    with pytest.raises(Exception, match="no size"):
        one(sources.stream_size(F.lit("{}")))
    listing = "Encoders:\n V..... = Video\n ------\n V....D libx264   H.264\n A....D aac  AAC\n V....D libx264   again\n D  dshow  DirectShow\n\nnonsense line\n"
    got = sources.parse_list(spark.createDataFrame([(1, listing), (2, None)], "list_id int, text string")).orderBy("no").collect()
    assert [r.name for r in got] == ["=", "libx264", "aac", "dshow"]


def test_valid_segments(spark):
    rows = [(None, 2.0, None, float("nan")), (1.0, 1.0, "motion", 1.0), (float("inf"), 3.0, "motion", 1.0), (1.0, None, "x", 1.0), (5.0, 9.0, "cadence", 2.0), (0.0, float("nan"), "x", 0.0)]
    df = spark.createDataFrame(rows, "start double, end double, reason string, score double")
    assert sorted(map(tuple, timeline.valid_segments(df).collect())) == [(0.0, 2.0, "start", 0.0), (0.0, 3.0, "motion", 1.0), (5.0, 9.0, "cadence", 2.0)]


def test_lines_move_with_their_polygons(spark):
    df = spark.createDataFrame([(1, 10, 4, 8, 2, [[10, 4], [18, 5], [17, 7]]), (2, 0, 0, 1, 1, None)], "id int, x int, y int, w int, h int, polygon array<array<int>>")
    got = {r.id: r for r in text.map_lines(df, 0.5, 3, -1).collect()}
    assert got[1].polygon == [[8, 1], [12, 2], [12, 3]] and (got[1].x, got[1].y, got[1].w, got[1].h) == (8, 1, 4, 1) and got[2].polygon is None


def test_last_segment_ends_after_its_last_frame(spark):
    """A frame lasts until the next would come: one frame of a recording is a segment of a quarter of a second."""
    df = spark.createDataFrame([(1, 0, 5.0, 0.0)] + [(2, i, i / 4, 0.0) for i in range(3)], "recording_id bigint, seq bigint, t double, diff double")
    assert sorted((r.recording_id, r.start, r.end) for r in timeline.cut_segments(df).collect()) == [(1, 5.0, 5.25), (2, 0.0, 0.75)]


def test_document_of_little(spark):
    """A recording without stills, text, objects or speech, whose sections aren't told of: nothing is made up."""
    segs = spark.createDataFrame([(1, 1, "s001", 0.0, 2.0, 2.0, "start", 0.0, None), (1, 2, "s002", 2.0, 4.0, 2.0, "motion", 9.0, float("nan"))], "recording_id bigint, index int, id string, start double, end double, seconds double, reason string, score double, motion double")
    none = lambda schema: spark.createDataFrame([], schema)
    key = "recording_id bigint, index int, "
    parts = {
        "segments": segs, "stills": none(key + "at double"), "regions": none(key + "shares struct<text:double,picture:double,texture:double,flat:double,dark:double>, blocks array<struct<x:int>>"),
        "lines": none(key + "line int, text string, confidence double, x int, y int, w int, h int"), "objects": none(key + "id bigint, label string, score double, x int, y int, w int, h int"),
        "spoken": none("recording_id bigint, item bigint, s_start double, s_end double, text string"), "status": none("recording_id bigint, section string, available boolean, reason string"),
        "failures": none(key + "section string, message string"),
    }
    fused = fusion.fuse(**parts)
    assert [(r.kind, r.text, r.appearances, r.objects, r.speech) for r in fused.collect()] == [("idle", None, None, [], None)] * 2
    (doc,) = fusion.documents(fused, parts["lines"], parts["spoken"], parts["status"], parts["failures"]).collect()
    assert (doc.summary.segment_count, doc.summary.kinds, doc.summary.text_lines, doc.shares, doc.keywords, doc.counts) == (2, {"idle": [1, 2]}, 0, None, [], [])
    assert doc.warnings == ["0 stills of 2 segments"] and all(s.available for s in doc.sections.values())
    (row,) = fusion.as_json(fusion.documents(fused, parts["lines"], parts["spoken"], parts["status"], parts["failures"])).collect()
    assert '"keyframe_at":null' in row.document and '"motion":null' in row.document and "NaN" not in row.document
