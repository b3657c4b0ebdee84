"""Files of raw frames as a data source, read in parallel by ranges of bytes, in batch and as a stream."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, Filter, GreaterThan, GreaterThanOrEqual, InputPartition, LessThan, LessThanOrEqual

SCHEMA = "path string, i bigint, t double, pixels binary, leftover bigint"
_BATCH = 8 << 20


@dataclass
class Stretch(InputPartition):
    """Some frames of a file; leftover: the bytes of a last frame that is too short, told by the stretch that ends the file."""

    path: str
    first: int
    frames: int
    leftover: int = 0

    def __post_init__(self):
        super().__init__(self.path)


class Layout:
    """What the options say: width, height, channels (1), fps (4), start (seconds of the first frame), stretch (bytes of a task's share, 64 MB)."""

    def __init__(self, options: dict[str, str]):
        if "path" not in options:
            raise ValueError("a path of raw frames is needed: load(path)")
        size = [int(options.get(k, default)) for k, default in (("width", "0"), ("height", "0"), ("channels", "1"))]
        if min(size) < 1:
            raise ValueError("width and height of the frames are needed, and channels of 1 or more")
        self.size = size[0] * size[1] * size[2]
        self.fps, self.start = float(options.get("fps", "4")), float(options.get("start", "0"))
        self.path, self.per = options["path"], max(1, int(options.get("stretch", str(64 << 20))) // self.size)

    def files(self) -> Iterator[tuple[str, int]]:
        """(path, bytes) of the file, or of all files below the folder, in order of their paths."""
        system, base = pafs.FileSystem.from_uri(self.path) if "://" in self.path else (pafs.LocalFileSystem(), self.path)
        info = system.get_file_info(base)
        if info.type == pafs.FileType.NotFound:
            raise FileNotFoundError(self.path)
        found = [info] if info.is_file else system.get_file_info(pafs.FileSelector(base, recursive=True))
        prefix = self.path.split("://")[0] + "://" if "://" in self.path else ""
        hidden = lambda path: path.rsplit("/", 1)[-1].startswith(("_", "."))
        yield from sorted((prefix + f.path, f.size) for f in found if f.is_file and not hidden(f.path))

    def stretches(self, path: str, first: int, end: int, leftover: int) -> Iterator[Stretch]:
        for at in range(first, end, self.per):
            last = at + self.per >= end
            yield Stretch(path, at, min(self.per, end - at), leftover if last else 0)
        if leftover and first >= end:
            yield Stretch(path, end, 0, leftover)

    def read(self, part: Stretch | None) -> Iterator[pa.RecordBatch]:
        """The rows of a stretch; none where Spark asks for no stretch, as there are no frames."""
        if part is None:
            return
        system, base = pafs.FileSystem.from_uri(part.path) if "://" in part.path else (pafs.LocalFileSystem(), part.path)
        names = ["path", "i", "t", "pixels", "leftover"]

        def rows(numbers: range, pixels: list[bytes | None], leftover: list[int | None]) -> pa.RecordBatch:
            times = [self.start + n / self.fps for n in numbers]
            return pa.RecordBatch.from_arrays([pa.array([part.path] * len(pixels)), pa.array(list(numbers), pa.int64()), pa.array(times, pa.float64()), pa.array(pixels, pa.binary()), pa.array(leftover, pa.int64())], names=names)

        with system.open_input_file(base) as file:
            file.seek(part.first * self.size)
            step = max(1, _BATCH // self.size)
            for at in range(part.first, part.first + part.frames, step):
                n = min(step, part.first + part.frames - at)
                data = file.read(n * self.size)
                if len(data) < n * self.size:
                    raise OSError(f"{part.path} became shorter while it was read")
                yield rows(range(at, at + n), [data[k * self.size : (k + 1) * self.size] for k in range(n)], [None] * n)
        if part.leftover:
            end = part.first + part.frames
            yield rows(range(end, end + 1), [None], [part.leftover])


class Reader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.layout = Layout(options)
        self.low, self.high = 0, None

    def partitions(self) -> list[Stretch]:
        out = []
        for path, size in self.layout.files():
            frames, leftover = divmod(size, self.layout.size)
            end = frames if self.high is None else max(0, min(frames, self.high))
            out += self.layout.stretches(path, min(max(0, self.low), end), end, leftover if end == frames else 0)
        return out

    def read(self, partition: Stretch) -> Iterator[pa.RecordBatch]:
        return self.layout.read(partition)


class FilteredReader(Reader):
    """Ranges of i and t in a query's filters narrow what is read; Spark checks them again."""

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:  # noqa: N802
        for f in filters:
            if isinstance(f, GreaterThan | GreaterThanOrEqual | LessThan | LessThanOrEqual) and f.attribute in (("i",), ("t",)):
                at = float(f.value) if f.attribute == ("i",) else (float(f.value) - self.layout.start) * self.layout.fps
                if isinstance(f, GreaterThan | GreaterThanOrEqual):
                    self.low = max(self.low, int(at) - 1)
                else:
                    self.high = min(int(at) + 2, self.high if self.high is not None else int(at) + 2)
            yield f


class StreamReader(DataSourceStreamReader):
    """New files, and frames that files have grown by since the last batch. A last short frame waits until it is whole. The offset is a number of frames for each file."""

    def __init__(self, options: dict[str, str]):
        self.layout = Layout(options)

    def initialOffset(self) -> dict:  # noqa: N802
        return {}

    def latestOffset(self) -> dict:  # noqa: N802
        return {path: size // self.layout.size for path, size in self.layout.files()}

    def partitions(self, start: dict, end: dict) -> list[Stretch]:
        return [s for path, frames in sorted(end.items()) for s in self.layout.stretches(path, start.get(path, 0), frames, 0)]

    def read(self, partition: Stretch) -> Iterator[pa.RecordBatch]:
        return self.layout.read(partition)

    def commit(self, end: dict) -> None:
        pass


class RawFrames(DataSource):
    """``spark.dataSource.register(RawFrames)``, then ``spark.read.format("rawframes").options(width=320, height=180).load(path)``, or ``readStream``.

    A row is a frame: path, i (its number in the file), t (seconds), pixels. A file's last frame that is too short is a row without pixels, with its bytes counted
    as ``leftover``; an empty file has no rows. With the option ``filters`` ranges of i and t are read alone; ``spark.sql.python.filterPushdown.enabled`` must then be true. Files of any size are read by many tasks. Paths are local, shared, or of a store that Arrow reads (hdfs://, s3://, ...);
    for other stores read ``binaryFile`` and cut it with ``sources.media.split_frames``.
    """

    @classmethod
    def name(cls) -> str:
        return "rawframes"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> Reader:
        return FilteredReader(self.options) if self.options.get("filters", "false").lower() == "true" else Reader(self.options)

    def streamReader(self, schema) -> StreamReader:  # noqa: N802
        return StreamReader(self.options)
