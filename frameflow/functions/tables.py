"""Table functions for SQL: folds over a recording's rows in order, a row at a time."""

from __future__ import annotations

import math
from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.functions import AnalyzeArgument, AnalyzeResult, OrderingColumn, PartitioningColumn, udtf
from pyspark.sql.types import BooleanType, DataType, DoubleType, LongType, StructField, StructType


def _analyzed(rows: AnalyzeArgument, needs: tuple[str, ...], order: tuple[str, ...], schema: dict[str, DataType], numbers: dict[str, AnalyzeArgument | None]) -> AnalyzeResult:
    """The function's columns, dealt by recording and in order, whatever the caller says; clear errors for missing columns and arguments that aren't constants."""
    if not rows.isTable:
        raise ValueError("the first argument is a table: TABLE(...)")
    missing = [c for c in needs if c not in {f.name for f in rows.dataType.fields}]
    if missing:
        raise ValueError(f"the table needs the columns {', '.join(needs)}; it has no {', '.join(missing)}")
    for name, given in numbers.items():
        if given is not None and (given.isTable or not given.isConstantExpression):
            raise ValueError(f"{name} must be a constant")
    return AnalyzeResult(StructType([StructField(c, kind) for c, kind in schema.items()]), partitionBy=[PartitioningColumn("recording_id")], orderBy=[OrderingColumn(c) for c in order])


def _round(x: float) -> float:
    return math.floor(x * 10_000 + 0.5) / 10_000


class SpeechIntervals:
    """TABLE(recording_id, start, end, duration: a row a silence, or one with null start) -> the speech between the silences, in pieces of at most ``longest`` seconds; rests below ``least`` are dropped."""

    @staticmethod
    def analyze(rows: AnalyzeArgument, longest: AnalyzeArgument | None = None, least: AnalyzeArgument | None = None) -> AnalyzeResult:
        return _analyzed(rows, ("recording_id", "start", "end", "duration"), ("start", "end"), {"recording_id": LongType(), "start": DoubleType(), "end": DoubleType(), "seconds": DoubleType()}, {"longest": longest, "least": least})

    def __init__(self):
        self.at, self.recording, self.duration, self.longest, self.least = 0.0, None, None, 25.0, 0.25

    def _spoken(self, until: float) -> Iterator[tuple]:
        n = max(math.ceil((until - self.at) / self.longest) - 1, 0)
        for i in range(n + 1):
            begin = self.at + i * self.longest
            end = begin + self.longest if i < n else until
            if i < n or until - begin >= self.least:
                yield self.recording, _round(begin), _round(end), _round(end - begin)

    def eval(self, row, longest: float = 25.0, least: float = 0.25) -> Iterator[tuple]:
        self.recording, self.duration, self.longest, self.least = row["recording_id"], row["duration"], float(longest), float(least)
        if row["start"] is None or not (self.duration or 0) > 0:
            return
        start, end = max(row["start"], 0.0), min(row["end"] if row["end"] is not None else self.duration, self.duration)
        if end > start:
            if start > self.at:
                yield from self._spoken(start)
            self.at = max(self.at, end)

    def terminate(self) -> Iterator[tuple]:
        if (self.duration or 0) > self.at:
            yield from self._spoken(self.duration)


class PlanCuts:
    """TABLE(recording_id, start, duration: a row a silence, or one with null start) -> cut, forced: where to cut so that no piece exceeds max_seconds, at the latest silence
    that starts past a quarter of it and at most ``lead`` seconds before the limit. Of the silences only the best so far is kept."""

    @staticmethod
    def analyze(rows: AnalyzeArgument, max_seconds: AnalyzeArgument | None = None, lead: AnalyzeArgument | None = None) -> AnalyzeResult:
        return _analyzed(rows, ("recording_id", "start", "duration"), ("start",), {"recording_id": LongType(), "cut": DoubleType(), "forced": BooleanType()}, {"max_seconds": max_seconds, "lead": lead})

    def __init__(self):
        self.at, self.best, self.recording, self.duration, self.longest, self.lead = 0.0, None, None, None, 25.0, 25.0

    def _cut(self) -> tuple:
        forced = self.best is None
        self.at, self.best = self.at + self.longest if forced else self.best, None
        return self.recording, float(self.at), forced

    def _more(self) -> bool:
        return self.duration is not None and self.duration - self.at > self.longest

    def eval(self, row, max_seconds: float = 25.0, lead: float = 25.0) -> Iterator[tuple]:
        self.recording, self.duration, self.longest, self.lead = row["recording_id"], row["duration"], float(max_seconds), float(lead)
        start = row["start"]
        while start is not None and self._more():
            limit = self.at + self.longest
            if start <= limit:
                if start > self.at + self.longest * 0.25 and start >= limit - self.lead:
                    self.best = start
                return
            yield self._cut()

    def terminate(self) -> Iterator[tuple]:
        while self._more():
            yield self._cut()


def register(spark: SparkSession) -> None:
    """speech_intervals(TABLE(...), longest, least) and plan_cuts(TABLE(...), max_seconds, lead) for this session's SQL."""
    spark.udtf.register("speech_intervals", udtf(SpeechIntervals))
    spark.udtf.register("plan_cuts", udtf(PlanCuts))
