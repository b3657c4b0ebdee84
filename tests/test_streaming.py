"""Streams against the batch: rows in any order, repeated files, ends, idle recordings, freed state, progress."""

import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from frameflow.operators import timeline
from frameflow.sources import fixtures
from frameflow.sources import media as sources
from frameflow.streaming import segments as st
from frameflow.streaming.ordered import ROCKSDB
from frameflow.streaming.progress import Progress, observed

DIFFS = "recording_id bigint, seq bigint, t double, diff double"


@pytest.fixture(autouse=True)
def rocksdb(spark):
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key, None)
    spark.conf.set(key, ROCKSDB)
    yield
    spark.conf.set(key, before) if before else spark.conf.unset(key)


def shuffled(spark, rows, schema, tmp_path, files, seed=1):
    """Rows dealt to files at random, read a file at a time."""
    r = random.Random(seed)
    rows = r.sample(rows, len(rows))
    for i in range(files):
        spark.createDataFrame(rows[i::files], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))


def ran(frame, tmp_path, spark):
    """All there is to read, then the end: without batches for the timers alone."""
    key = "spark.sql.streaming.noDataMicroBatches.enabled"
    spark.conf.set(key, "false")
    try:
        query = frame.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "c")).outputMode("append").trigger(availableNow=True).start(str(tmp_path / "out"))
        assert query.awaitTermination(90)
    finally:
        spark.conf.unset(key)
    return spark.read.parquet(str(tmp_path / "out"))


def left(spark, tmp_path, name):
    """Rows of a state variable after the last batch."""
    read = spark.read.format("statestore").option("stateVarName", name)
    return (read.option("flattenCollectionTypes", "true").load(str(tmp_path / "c"))).count()


def as_rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


@pytest.mark.parametrize("files", [1, 4])
def test_segments_equal_batch(spark, sf_dir, tmp_path, files):
    """Frames in any order over the files; nothing is left in the state once every recording has ended."""
    diffs = fixtures.frame_diffs(spark, sf_dir).where("recording_id < 40")
    rows = [tuple(r) for r in diffs.select("recording_id", "seq", "t", "diff").collect()]
    ends = {}
    for rec, seq, *_ in rows:
        ends[rec] = max(seq, ends.get(rec, 0))
    stream = shuffled(spark, rows + [(rec, seq + 1, 0.0, -1.0) for rec, seq in ends.items()] + [(0, None, 0.0, 99.0), (0, -5, 0.0, 99.0)], DIFFS, tmp_path, files)
    got = ran(st.stream_segments(stream, idle=0, remember=0), tmp_path, spark)
    assert as_rows(got) == as_rows(timeline.cut_segments(diffs))
    assert [left(spark, tmp_path, v) for v in ("position", "late", "fold")] == [0, 0, 0]


def test_a_recording_that_comes_again(spark, tmp_path):
    """A file that is read twice, after its end mark, changes nothing; only the mark of the end is kept."""
    rows = [(1, i, i * 0.25, 50.0 if i == 6 else 1.0) for i in range(12)] + [(1, 12, 3.0, -1.0)]
    source = str(tmp_path / "in")
    for _ in range(2):
        spark.createDataFrame(rows, DIFFS).coalesce(1).write.mode("append").parquet(source)
    read = spark.readStream.schema(DIFFS).option("maxFilesPerTrigger", 1).parquet(source)
    assert ran(st.stream_segments(read), tmp_path, spark).count() == 2
    assert [left(spark, tmp_path, v) for v in ("position", "fold", "ended")] == [0, 0, 1]


def test_frames_equal_batch(spark, sf_dir, tmp_path):
    """Chunks of bytes in any order -> the frames of the batch, and what is left at the end of each stream."""
    chunks = spark.read.parquet(f"{sf_dir}/conversations.parquet").select(F.col("conv_id").alias("stream_id"), (F.row_number().over(timeline.Window.partitionBy("conv_id").orderBy("turn")) - 1).cast("long").alias("seq"), F.encode(F.coalesce("text", F.lit("")), "utf-8").alias("content"))
    rows = [(r.stream_id, r.seq, bytes(r.content), None) for r in chunks.collect()]
    sizes = {}
    for s, *_, content, _ in rows:
        sizes[s] = sizes.get(s, 0) + len(content)
    last = {}
    for s, seq, *_ in rows:
        last[s] = max(seq, last.get(s, 0))
    rows += [(s, seq + 1, None, True) for s, seq in last.items()]
    stream = shuffled(spark, rows, "stream_id bigint, seq bigint, content binary, last boolean", tmp_path, 3)
    got = ran(st.stream_frames(stream, 64, remember=0), tmp_path, spark)
    batch = sources.split_frames(chunks, 64).select("stream_id", "i", F.sha2("frame", 256))
    assert as_rows(got.where("frame IS NOT NULL").select("stream_id", "i", F.sha2("frame", 256))) == as_rows(batch)
    assert {r.stream_id: r.leftover for r in got.where("frame IS NULL").collect()} == {s: n % 64 for s, n in sizes.items() if n % 64}
    assert left(spark, tmp_path, "fold") == 0


def test_recordings_equal_batch(spark, tmp_path):
    """Bytes of gray frames, cut anywhere -> the segments of the frames' differences."""
    rng = np.random.default_rng(4)
    rows, diffs = [], []
    for rec in (1, 2):
        frames = [np.full(12, v, np.uint8) + rng.integers(0, 3, 12, np.uint8) for v in rng.choice([10, 60, 200], 40)]
        diffs += [(rec, n, n * 0.25, 0.0 if n == 0 else float(np.floor(np.abs(f.astype(int) - frames[n - 1]).mean() * 10_000 + 0.5) / 10_000)) for n, f in enumerate(frames)]
        data = b"".join(f.tobytes() for f in frames) + b"rest"
        cuts = sorted(rng.integers(0, len(data), 20).tolist())
        pieces = [data[a:b] for a, b in zip([0, *cuts], [*cuts, len(data)], strict=True)]
        rows += [(rec, i, p, i == len(pieces) - 1) for i, p in enumerate(pieces)]
    stream = shuffled(spark, rows, "recording_id bigint, seq bigint, content binary, last boolean", tmp_path, 3)
    got = ran(st.stream_recordings(stream, 12), tmp_path, spark)
    assert as_rows(got) == as_rows(timeline.cut_segments(spark.createDataFrame(diffs, DIFFS)))


def test_idle_recording(spark, tmp_path):
    """Without its end and with a frame missing, a recording is ended by its timer: the frames behind the gap are folded in order."""
    rows = [(1, i, i * 0.25, 1.0) for i in (0, 1, 2, 4, 6, 5)]
    stream = shuffled(spark, rows, DIFFS, tmp_path, 2)
    out = st.stream_segments(stream, idle=1, remember=0)
    query = out.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "c")).outputMode("append").trigger(processingTime="500 milliseconds").start(str(tmp_path / "out"))
    try:
        began, got = time.time(), []
        while not got and time.time() - began < 90:
            time.sleep(1)
            got = as_rows(spark.read.schema(timeline.RAW).parquet(str(tmp_path / "out"))) if (tmp_path / "out").exists() else []
    finally:
        query.stop()
    assert got == [(1, 0.0, 1.5, "start", 0.0, 5.0, 5, 1.0)]
    assert [left(spark, tmp_path, v) for v in ("position", "late", "fold")] == [0, 0, 0]


def test_progress(spark, tmp_path):
    """The observer is told after every two seconds of media and at the end; what it raises ends nothing."""
    told = []

    def observer(p):
        told.append((p["frames"], p["seconds"]))
        raise RuntimeError("not the query's concern")

    rows = [(1, i, i * 0.25, 1.0) for i in range(30)]
    source = str(tmp_path / "in")
    for i in range(6):
        spark.createDataFrame(rows[i * 5 : i * 5 + 5], DIFFS).coalesce(1).write.mode("append").parquet(source)
    listener = Progress(observer, fps=4.0)
    spark.streams.addListener(listener)
    try:
        stream = observed(spark.readStream.schema(DIFFS).option("maxFilesPerTrigger", 1).parquet(source))
        assert ran(stream, tmp_path, spark).count() == 30
        began = time.time()
        while len(told) < 4 and time.time() - began < 30:
            time.sleep(0.2)
    finally:
        spark.streams.removeListener(listener)
    assert told == [(10, 2.5), (20, 5.0), (25, 6.25), (30, 7.5)] and listener.frames == {}
