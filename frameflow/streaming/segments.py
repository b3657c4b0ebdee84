"""Segmentation of recordings as they arrive: of frame differences, of frames, and of bytes."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from frameflow.operators.timeline import RAW, CutRules, Open
from frameflow.streaming.ordered import InOrder, in_order

_OPEN = "start double, reason string, score double, run bigint, diff_sum double, samples bigint, diff_max double, first double, frames bigint"


def _cut(now: tuple | None, t: float, d: float, rules: CutRules) -> tuple[list[tuple], tuple]:
    """One frame more: what it closes, and the open segment with the recording's first time and number of frames."""
    if now is None:
        return [], (float(t), "start", 0.0, int(d >= rules.motion), 0.0, 0, 0.0, float(t), 1)
    *fields, first, frames = now
    done, o = Open(*fields).frame(float(t), float(d), rules)
    return [done] if done else [], (o.start, o.reason, o.score, int(o.run), o.diff_sum, int(o.samples), o.diff_max, first, frames + 1)


def _last(now: tuple | None, rules: CutRules) -> list[tuple]:
    return [] if now is None else [Open(*now[:-2]).closed(rules.end(now[-2], now[-1]))]


class Differences(InOrder):
    columns, state, schema = {"t": "double", "diff": "double"}, _OPEN, RAW

    def __init__(self, rules: CutRules, **clock: float):
        super().__init__(**clock)
        self.rules = rules

    def step(self, now, row):
        t, d = row
        if d < 0:
            return self.finish(now), None, True
        out, now = _cut(now, t, d, self.rules)
        return out, now, False

    def finish(self, now):
        return _last(now, self.rules)


def stream_segments(diffs: DataFrame, rules: CutRules = CutRules(), idle: float = 3600.0, remember: float = 3600.0) -> DataFrame:
    """A stream of (recording_id, seq, t, diff) -> raw segments as they close, equal to ``cut_segments`` of all rows; a negative diff marks the end of a recording.

    Frames may come in any order and more than once: see InOrder. Of an open recording the state holds one segment and the frames behind a gap; of one that has ended nothing.
    """
    return in_order(diffs, "recording_id", Differences(rules, idle=idle, remember=remember))


def split_bytes(rest: bytes, content: bytes | None, size: int) -> tuple[list[bytes], bytes]:
    """What was left and a chunk -> whole frames and what is left now."""
    data = rest + bytes(content or b"")
    whole = len(data) // size * size
    return [data[i : i + size] for i in range(0, whole, size)], data[whole:]


class Frames(InOrder):
    columns, state = {"content": "binary", "last": "boolean"}, "rest binary, i bigint"
    schema = "stream_id bigint, i bigint, frame binary, leftover bigint"

    def __init__(self, size: int, **clock: float):
        if size <= 0:
            raise ValueError(f"frames of {size} bytes")
        super().__init__(**clock)
        self.size = size

    def step(self, now, row):
        rest, i = now or (b"", 0)
        frames, rest = split_bytes(bytes(rest), row[0], self.size)
        out, now = [(i + k, f, None) for k, f in enumerate(frames)], (rest, i + len(frames))
        return (out + self.finish(now), None, True) if row[1] else (out, now, False)

    def finish(self, now):
        return [(now[1], None, len(now[0]))] if now and now[0] else []


def stream_frames(chunks: DataFrame, size: int, idle: float = 3600.0, remember: float = 3600.0) -> DataFrame:
    """A stream of chunks (stream_id, seq, content, last) -> frames (stream_id, i, frame) of ``size`` bytes, however they are cut into chunks.

    The bytes that don't fill a frame wait for the next chunk; those left when a stream ends are a row without frame, with their number as ``leftover``.
    A null content is empty; ``last`` marks the last chunk (null: false).
    """
    return in_order(chunks.withColumn("last", F.coalesce("last", F.lit(False))), "stream_id", Frames(size, idle=idle, remember=remember))


class Recording(InOrder):
    """Chunks of gray frames -> segments: frames, their difference to the frame before and the cuts in one fold."""

    columns = {"content": "binary", "last": "boolean"}
    state, schema = f"rest binary, before binary, n bigint, {_OPEN}", RAW

    def __init__(self, size: int, rules: CutRules, **clock: float):
        super().__init__(**clock)
        self.size, self.rules = size, rules

    def step(self, now, row):
        rest, before, n, *opened = now or (b"", None, 0, *[None] * 9)
        opened = tuple(opened) if opened[1] else None
        frames, rest = split_bytes(bytes(rest), row[0], self.size)
        out = []
        for frame in frames:
            apart = np.abs(np.frombuffer(frame, np.uint8).astype(np.int64) - np.frombuffer(bytes(before), np.uint8)).sum() if before is not None else 0
            done, opened = _cut(opened, n / self.rules.fps, float(np.floor(apart / self.size * 10_000 + 0.5) / 10_000), self.rules)
            out, before, n = out + done, frame, n + 1
        now = (rest, before, n, *(opened or (0.0, "", 0.0, 0, 0.0, 0, 0.0, 0.0, 0)))
        return (out + self.finish(now), None, True) if row[1] else (out, now, False)

    def finish(self, now):
        return _last(tuple(now[3:]) if now and now[4] else None, self.rules)


def stream_recordings(chunks: DataFrame, size: int, rules: CutRules = CutRules(), idle: float = 3600.0, remember: float = 3600.0) -> DataFrame:
    """A stream of chunks (recording_id, seq, content, last) of gray frames of ``size`` bytes at ``rules.fps`` -> raw segments as they close."""
    return in_order(chunks.withColumn("last", F.coalesce("last", F.lit(False))), "recording_id", Recording(size, rules, idle=idle, remember=remember))
