"""Raw frames as a source, documents as files, table functions in SQL, configurations: known values, errors and round trips."""

import json
import re
import random

import pytest
from pyspark.sql import functions as F

from frameflow.functions import settings, tables
from frameflow.operators import intervals
from frameflow.plans import catalog
from frameflow.sinks.documents import read_documents, write_documents
from frameflow.sources.rawframes import RawFrames


@pytest.fixture
def frames(spark, tmp_path):
    """Three files of 4 x 3 gray frames: ten and five bytes of an eleventh, two, none."""
    spark.dataSource.register(RawFrames)
    folder = tmp_path / "frames"
    folder.mkdir()
    data = {"a.raw": bytes(i % 251 for i in range(125)), "b.raw": bytes(range(24)), "empty.raw": b"", "_skipped": b"x" * 12}
    for name, content in data.items():
        (folder / name).write_bytes(content)
    return folder, data


def read(spark, folder, **options):
    return spark.read.format("rawframes").options(width=4, height=3, **options).load(str(folder))


def test_raw_frames(spark, frames):
    folder, data = frames
    df = read(spark, folder, stretch=36, start=1.5, fps=2)
    assert df.rdd.getNumPartitions() == 5  # three frames a task: 3, 3, 3 and 1 with the rest; 2
    got = sorted((r.path.rsplit("/", 1)[1], r.i, r.t, bytes(r.pixels) if r.pixels is not None else None, r.leftover) for r in df.collect())
    want = [(name, i, 1.5 + i / 2, data[name][12 * i : 12 * i + 12], None) for name, n in (("a.raw", 10), ("b.raw", 2)) for i in range(n)]
    assert got == sorted([*want, ("a.raw", 10, 6.5, None, 5)])
    assert read(spark, folder / "b.raw").count() == 2 and read(spark, folder / "empty.raw").count() == 0


def test_raw_frames_of_a_time(spark, frames):
    """Bounds of time reach the source where they are pushed, and hold in any case."""
    folder, _ = frames
    for pushed in ("false", "true"):
        spark.conf.set("spark.sql.python.filterPushdown.enabled", pushed)
        df = read(spark, folder / "a.raw", stretch=12, filters=pushed).where("t >= 0.5 AND t < 1.5")
        assert sorted(r.i for r in df.collect()) == [2, 3, 4, 5] and df.rdd.getNumPartitions() == (7 if pushed == "true" else 10)
    spark.conf.unset("spark.sql.python.filterPushdown.enabled")


def test_raw_frames_errors(spark, frames, tmp_path):
    with pytest.raises(Exception, match="width and height"):
        spark.read.format("rawframes").load(str(tmp_path)).collect()
    with pytest.raises(Exception, match="nowhere"):
        read(spark, tmp_path / "nowhere").collect()


def test_raw_frames_as_they_come(spark, frames, tmp_path):
    """A stream reads new files and what files have grown by; each frame once."""
    folder, data = frames
    stream = spark.readStream.format("rawframes").options(width=4, height=3, stretch=36).load(str(folder))

    def rows():
        query = stream.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start(str(tmp_path / "out"))
        assert query.awaitTermination(60)
        return sorted((r.path.rsplit("/", 1)[1], r.i, bytes(r.pixels)) for r in spark.read.parquet(str(tmp_path / "out")).collect())

    of = lambda name, content: [(name, i, content[12 * i : 12 * i + 12]) for i in range(len(content) // 12)]
    assert rows() == of("a.raw", data["a.raw"]) + of("b.raw", data["b.raw"])
    grown = data["a.raw"] + bytes(19)
    (folder / "a.raw").write_bytes(grown)
    (folder / "c.raw").write_bytes(bytes(12))
    assert rows() == of("a.raw", grown) + of("b.raw", data["b.raw"]) + of("c.raw", bytes(12))


def test_documents_as_files(spark, sf_dir, tmp_path):
    """A file for each recording, read back equal; recordings that come again are replaced, the others stay."""
    made = catalog.structure_document(spark, sf_dir).where("recording_id < 6").cache()
    path = str(tmp_path / "documents")
    write_documents(made, path)
    want = {r.recording_id: r.document for r in made.collect()}
    back = {r.recording_id: r.document for r in read_documents(spark, path).collect()}
    assert back == want and len(want) > 2
    assert len(list((tmp_path / "documents").rglob("part-*"))) == len(want)
    write_documents(spark.createDataFrame([(1, '{"new":\n 1}'), (99, "{}"), (None, "{}"), (98, None)], "recording_id bigint, document string"), path)
    back = {r.recording_id: r.document for r in read_documents(spark, path).collect()}
    assert back == want | {1: '{"new":\n 1}', 99: "{}"}
    with pytest.raises(Exception, match="several documents of recording 1"):
        write_documents(spark.createDataFrame([(1, "{}"), (1, "[]")], "recording_id bigint, document string"), path)
    assert {r.recording_id: r.document for r in read_documents(spark, path).collect()} == back


def test_document_holds_its_parts(spark, sf_dir):
    """The JSON holds what the flat queries tell."""
    docs = {r.recording_id: json.loads(r.document) for r in catalog.structure_document(spark, sf_dir).collect()}
    summary = {r.recording_id: r for r in catalog.doc_summary(spark, sf_dir).collect()}
    assert docs.keys() == summary.keys()
    for rec, d in docs.items():
        s = summary[rec]
        assert (d["summary"]["segment_count"], d["summary"]["text_lines"], d["summary"]["speech_intervals"]) == (s.segment_count, s.text_lines, s.speech_intervals) == (len(d["timeline"]["segments"]), len(d["text"]["lines"]), d["speech"]["interval_count"])
        assert ";".join(f"{k}:{','.join(map(str, v))}" for k, v in sorted(d["summary"]["kinds"].items())) == s.kinds
        assert ";".join(f"{k}:{v}" for k, v in d["objects"]["counts"].items()) == s.counts
        assert d["text"]["available"] == (rec % 7 != 3) and (d["text"]["reason"] is None) == d["text"]["available"]
        for seg in d["timeline"]["segments"]:
            assert seg["keyframe_at"] is not None or (seg["appearances"] is None and seg["text"] is None and seg["objects"] == [])


def test_table_functions(spark):
    """Overlapping, open, negative and empty silences, unknown durations, several recordings: as the operators have it."""
    r = random.Random(2)
    rows = [(rec, s, s + r.choice([0.1, 3.0, 30.0]), 200.0) for rec in range(6) for s in (r.uniform(-5, 210) for _ in range(rec * 3))] + [(6, 10.0, None, 90.0), (7, None, None, 61.0), (8, None, None, None), (9, None, None, 0.0), (10, 5.0, 5.0, 12.0)]
    given = spark.createDataFrame(rows, "recording_id bigint, start double, end double, duration double").unionByName(spark.createDataFrame([(0, None, None, 200.0)], "recording_id bigint, start double, end double, duration double"))
    tables.register(spark)
    durations, silences = given.groupBy("recording_id").agg(F.max("duration").alias("duration")), given.where("start IS NOT NULL").select("recording_id", "start", "end")
    got = spark.sql("SELECT * FROM speech_intervals(TABLE({given}), 20.0D, 0.5D)", given=given).collect()
    assert sorted(got) == sorted(intervals.speech_intervals(silences, durations, 20.0, 0.5).collect()) and len(got) > 20
    got = spark.sql("SELECT * FROM plan_cuts(TABLE({given}), 25.0D, 10.0D)", given=given).collect()
    assert sorted(got) == sorted(intervals.plan_cuts(durations.where("duration IS NOT NULL"), silences, 25.0, 10.0).collect()) and len(got) > 20


def test_table_function_errors(spark):
    tables.register(spark)
    spark.range(1).createOrReplaceTempView("no_silences")
    with pytest.raises(Exception, match="the table needs the columns recording_id, start, duration"):
        spark.sql("SELECT * FROM plan_cuts(TABLE(no_silences), 8.0D)").collect()
    with pytest.raises(Exception, match="is a table"):
        spark.sql("SELECT * FROM speech_intervals(1)").collect()


def test_every_setting(spark):
    """Each setting meets its rule: a value of another kind, bounds and what lies beyond, defaults, and the error that names the first."""
    def wrong(config):
        return [(v.field, v.problem) for v in spark.range(1).select(settings.violations(F.lit(config)).alias("v")).first().v]

    configs, want = [], []
    for s in settings.SETTINGS:
        section, _, name = s.field.rpartition(".")
        of = lambda value: json.dumps({section: {name: value}} if section else {name: value})  # noqa: B023, E731
        good = {"text": ["x", None], "switch": [True, False], "number": [s.low, s.high], "count": [1, 100_000, 2.5], "choice": list(s.choices), "scale": ["auto", 1, 3, 1.5]}[s.kind]
        bad = {"text": [1, True, {}], "switch": [1, "true"], "number": [s.low - 0.001, s.high + 1, "3", True], "count": [0, 100_001, "5"], "choice": ["none", 3], "scale": ["big", 0, 4]}[s.kind]
        configs += [of(v) for v in good + bad]
        want += [None] * len(good) + [f"config.{s.field}"] * len(bad)
    rows = spark.createDataFrame(list(enumerate(configs)), "i int, config string").select("i", settings.violations(F.col("config")).alias("v")).collect()
    assert [r.v[0].field if r.v else None for r in sorted(rows)] == want
    assert [wrong(c) for c in (None, "", "{}", '{"analysis": 5, "more": 1}')] == [[], [], [], []] and wrong("{") == [("config", "must be JSON")]
    assert wrong('{"asr": {"enabled": 1}, "maxConcurrent": 9}') == [("config.maxConcurrent", "must be a number between 1 and 8"), ("config.asr.enabled", "must be a boolean")]
    assert spark.range(1).select(settings.checked(F.lit('{"maxConcurrent": 2}')).alias("c")).first().c == '{"maxConcurrent": 2}'
    with pytest.raises(Exception, match="config.ocr.provider must be one of auto, sibling, winrt, off"):
        spark.range(1).select(settings.checked(F.lit('{"ocr": {"provider": "x"}}'))).collect()
    full = spark.range(1).select(*(c.alias(k) for k, c in settings.completed(F.lit('{"analysis": {"maxSide": 99.9}, "asr": {"enabled": false}}')).items())).first()
    assert (full.analysis_maxSide, full.analysis_fps, full.asr_enabled, full.ocr_scale, full.asr_language, full.maxConcurrent) == (99.0, 4.0, False, "auto", None, 2.0)


@pytest.mark.parametrize("name,most", [("config_violations", 1), ("config_completed", 2), ("probe_facts", 2)])
def test_json_is_read_once(spark, sf_dir, name, most):
    """The text of a row is parsed once in each step of the plan, not once for each fact or rule."""
    from frameflow.plans import catalog

    plan = catalog.QUERIES[name](spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    assert len(re.findall("parsejson|parse_json|from_json", plan.lower())) <= most


def test_documents_work_on_their_stills_only(spark, sf_dir, monkeypatch):
    """Of all frames with boxes only those that are stills are ordered and suppressed, and all of their boxes are."""
    from frameflow.plans import catalog

    given, plain = [], catalog.bx.suppress
    monkeypatch.setattr(catalog.bx, "suppress", lambda boxes, *more: given.append(boxes) or plain(boxes, *more))
    stills = catalog._parts(spark, sf_dir)["stills"].select(F.col("still").alias("frame_id")).distinct()
    want = catalog._labelled(spark, sf_dir).join(stills, "frame_id")
    assert given[0].join(stills, "frame_id", "left_anti").isEmpty() and given[0].count() == want.count() > 0
