"""Progress of running queries: metrics observed on the rows, told to an observer whose failures change nothing."""

from __future__ import annotations

import logging
import time
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener

_log = logging.getLogger(__name__)


def observed(frames: DataFrame, name: str = "frames") -> DataFrame:
    """The same rows, a frame each; how many pass is a metric of the query."""
    return frames.observe(name, F.count(F.lit(1)).alias("frames"))


class Progress(StreamingQueryListener):
    """Tells ``observer`` the frames, seconds of media and elapsed milliseconds of each query that reads ``observed`` rows: whenever another ``every`` seconds of media have passed, and at the end.

    What the observer raises is logged and goes no further: to watch a query must not end it. Register with ``spark.streams.addListener``.
    """

    def __init__(self, observer: Callable[[dict], None], fps: float, every: float = 2.0, name: str = "frames"):
        self.observer, self.fps, self.step, self.name = observer, fps, max(1, round(fps * every)), name
        self.frames: dict[str, int] = {}
        self.began: dict[str, float] = {}

    def _tell(self, run: str) -> None:
        frames = self.frames.get(run, 0)
        seconds = int(frames / self.fps * 10_000 + 0.5) / 10_000
        try:
            self.observer({"run": run, "frames": frames, "seconds": seconds, "elapsed_ms": int((time.time() - self.began.get(run, time.time())) * 1000)})
        except Exception:
            _log.warning("an observer of progress failed", exc_info=True)

    def onQueryStarted(self, event) -> None:  # noqa: N802
        self.began[str(event.runId)] = time.time()

    def onQueryProgress(self, event) -> None:  # noqa: N802
        run = str(event.progress.runId)
        row = (event.progress.observedMetrics or {}).get(self.name)
        if row is None:
            return
        before = self.frames.get(run, 0)
        self.frames[run] = before + row["frames"]
        if self.frames[run] // self.step > before // self.step:
            self._tell(run)

    def onQueryIdle(self, event) -> None:  # noqa: N802
        pass

    def onQueryTerminated(self, event) -> None:  # noqa: N802
        run = str(event.runId)
        if run in self.frames:
            self._tell(run)
        self.frames.pop(run, None)
        self.began.pop(run, None)
