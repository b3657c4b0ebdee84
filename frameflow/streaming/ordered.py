"""Rows of a key put in order as they arrive: what a stateful stream of recordings is built on."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class InOrder(StatefulProcessor):
    """Takes each key's rows in the order of seq (0, 1, 2, ...), whatever the order they arrive in, and folds them.

    Rows before the next seq have been seen and are left out; rows beyond it wait in a map of the state until the gap closes. A fold says when its key has
    ended: then all of the key's state is removed, and only a mark of the end stays, for ``remember`` seconds, so that files that come again soon change nothing. A key that
    gets no rows for ``idle`` seconds is ended by a timer: what waits is folded in its order, without what is missing. 0 leaves either out. Rows of a micro-batch are read a piece at a time.

    A subclass names the rows' columns (``columns``), the fold's state (``state``) and what comes out (``schema``, the key first).
    """

    columns: dict[str, str] = {}
    state, schema = "", ""

    def __init__(self, idle: float = 3600.0, remember: float = 3600.0):
        self.idle, self.remember = int(idle * 1000), int(remember * 1000)

    def step(self, now: tuple | None, row: tuple) -> tuple[list[tuple], tuple | None, bool]:
        """The state before and a row -> what comes out, the state after, whether the key has ended."""
        raise NotImplementedError

    def finish(self, now: tuple | None) -> list[tuple]:
        """What comes out when a key ends."""
        raise NotImplementedError

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.position = handle.getValueState("position", "seq bigint, waiting bigint")
        self.late = handle.getMapState("late", "seq bigint", ", ".join(f"{c} {kind}" for c, kind in self.columns.items()))
        self.fold = handle.getValueState("fold", self.state)
        self.ended = handle.getValueState("ended", "seq bigint", self.remember) if self.remember else None

    def _out(self, key: tuple, rows: list[tuple]) -> pd.DataFrame:
        names = [c.split()[0] for c in self.schema.split(", ")]
        return pd.DataFrame([(key[0], *r) for r in rows], columns=names)

    def _close(self, seq: int) -> None:
        for state in (self.position, self.late, self.fold):
            state.clear()
        if self.ended:
            self.ended.update((seq,))

    def _restart_clock(self, now: int | None) -> None:
        if not self.idle:
            return
        for due in list(self.handle.listTimers()):
            self.handle.deleteTimer(due)
        if now is not None:
            self.handle.registerTimer(now + self.idle)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        if self.ended and self.ended.exists():
            for _ in rows:
                pass
            return
        seq, waiting = self.position.get() if self.position.exists() else (0, 0)
        now, over = (tuple(self.fold.get()) if self.fold.exists() else None), False
        for piece in rows:
            out: list[tuple] = []
            piece = piece.sort_values("seq")
            for n, *row in zip(piece["seq"], *(piece[c] for c in self.columns), strict=True):
                if over or n < seq:
                    continue
                if n > seq:
                    waiting += not self.late.containsKey((int(n),))
                    self.late.updateValue((int(n),), tuple(row))
                    continue
                while True:
                    made, now, over = self.step(now, tuple(row))
                    out += made
                    seq += 1
                    if over or not waiting or not self.late.containsKey((seq,)):
                        break
                    row = self.late.getValue((seq,))
                    self.late.removeKey((seq,))
                    waiting -= 1
            if out:
                yield self._out(key, out)
        if over:
            self._close(seq)
            self._restart_clock(None)
            return
        self.position.update((int(seq), int(waiting)))
        if now is not None:
            self.fold.update(now)
        self._restart_clock(timerValues.getCurrentProcessingTimeInMs() if self.idle else None)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        if not self.position.exists():
            return
        now, over, out = (tuple(self.fold.get()) if self.fold.exists() else None), False, []
        seqs = sorted(k[0] for k in self.late.keys())
        for n in seqs:
            if not over:
                made, now, over = self.step(now, tuple(self.late.getValue((n,))))
                out += made
        if not over:
            out += self.finish(now)
        self._close(seqs[-1] if seqs else self.position.get()[0])
        if out:
            yield self._out(key, out)


def in_order(rows: DataFrame, key: str, processor: InOrder) -> DataFrame:
    """A stream of (key, seq, the processor's columns) through it. The session's state store must be RocksDB (``ROCKSDB``), which holds state outside the heap. Rows without seq are left out.

    Timers and the marks of ended keys need batches without data, so with an availableNow trigger such a query only ends if ``spark.sql.streaming.noDataMicroBatches.enabled`` is false, or idle and remember are 0.
    """
    plain = rows.where("seq >= 0").select(key, F.col("seq").cast("long").alias("seq"), *processor.columns)
    clock = "ProcessingTime" if processor.idle or processor.remember else "None"
    return plain.groupBy(key).transformWithStateInPandas(processor, processor.schema, "Append", clock)
