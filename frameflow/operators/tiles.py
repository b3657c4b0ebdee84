"""Tile statistics of frames, their labels, shares and merged blocks."""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from frameflow.functions.numeric import rounded
from frameflow.operators.timeline import streamed

LABELS = ("text", "picture", "texture", "flat", "dark")


# What decides on a tile's label.
@dataclass(frozen=True)
class TileRules:
    flat_std: float = 4.0
    dark_luma: float = 48.0
    edge: float = 24.0
    text_edges: float = 0.09
    text_saturation: float = 0.22
    picture_saturation: float = 0.18
    picture_std: float = 12.0


def tile_label(luma: Column, std: Column, edges: Column, saturation: Column, r: TileRules = TileRules()) -> Column:
    return (
        F.when(std < r.flat_std, F.when(luma < r.dark_luma, "dark").otherwise("flat"))
        .when((edges >= r.text_edges) & (saturation <= r.text_saturation), "text")
        .when(saturation >= r.picture_saturation, "picture")
        .when((std >= r.picture_std) & (edges < r.text_edges), "picture")
        .otherwise("texture")
    )


_STATS = "frame_id bigint, column bigint, row bigint, x bigint, y bigint, width bigint, height bigint, luma double, std double, edge_density double, saturation double"


def _half_up(values: np.ndarray, digits: int) -> np.ndarray:
    return np.floor(values * 10.0**digits + 0.5) / 10.0**digits


class Grid:
    """Frames of one size cut into tiles; the last column and row take in the rest. Tiles are numbered in reading order."""

    def __init__(self, width: int, height: int, tile: int, channels: int, rules: TileRules):
        self.width, self.height, self.channels, self.rules = width, height, channels, rules
        self.columns, self.rows = max(1, width // tile), max(1, height // tile)
        lefts, tops = np.arange(self.columns) * tile, np.arange(self.rows) * tile
        self.lefts, self.tops = np.append(lefts, width), np.append(tops, height)
        widths, heights = np.diff(self.lefts), np.diff(self.tops)
        self.n = np.outer(heights, widths).ravel().astype(float)
        self.place = [np.tile(np.arange(self.columns), self.rows), np.repeat(np.arange(self.rows), self.columns), np.tile(lefts, self.rows), np.repeat(tops, self.columns), np.tile(widths, self.rows), np.repeat(heights, self.columns)]
        self.of_pixel = np.add.outer(np.repeat(np.arange(self.rows), heights) * self.columns, np.repeat(np.arange(self.columns), widths)).ravel()

    def _total(self, values: np.ndarray) -> np.ndarray:
        """Each tile's values added up one after another in reading order."""
        return np.bincount(self.of_pixel, values.ravel(), minlength=len(self.n))

    def statistics(self, pixels: np.ndarray) -> list[np.ndarray]:
        """luma, std, edge density and saturation of each tile, rounded."""
        size = self.width * self.height * self.channels
        if len(pixels) < size:
            raise ValueError(f"a frame of {len(pixels)} values where {size} are needed")
        shaped = pixels[:size].reshape(self.height, self.width, self.channels)
        if self.channels == 1:
            luma, saturation = shaped[:, :, 0], np.zeros((self.height, self.width))
        else:
            luma = 0.2126 * shaped[:, :, 0] + 0.7152 * shaped[:, :, 1] + 0.0722 * shaped[:, :, 2]
            most, least = shaped.max(axis=2), shaped.min(axis=2)
            saturation = np.divide(most - least, most, out=np.zeros_like(most), where=most > 0)
        edges = np.zeros((self.height, self.width))
        edges[:, :-1] += np.abs(luma[:, 1:] - luma[:, :-1]) > self.rules.edge
        edges[:-1, :] += np.abs(luma[1:, :] - luma[:-1, :]) > self.rules.edge
        mean = self._total(luma) / self.n
        std = np.sqrt(np.maximum(self._total(luma * luma) / self.n - mean * mean, 0.0))
        return [_half_up(mean, 2), _half_up(std, 2), _half_up(self._total(edges) / (2 * self.n), 4), _half_up(self._total(saturation) / self.n, 4)]

    def labels(self, luma: np.ndarray, std: np.ndarray, edges: np.ndarray, saturation: np.ndarray) -> np.ndarray:
        """tile_label as numbers of LABELS."""
        r, no = self.rules, {k: i for i, k in enumerate(LABELS)}
        flat = std < r.flat_std
        cases = [flat & (luma < r.dark_luma), flat, (edges >= r.text_edges) & (saturation <= r.text_saturation), saturation >= r.picture_saturation, (std >= r.picture_std) & (edges < r.text_edges)]
        return np.select(cases, [no["dark"], no["flat"], no["text"], no["picture"], no["picture"]], no["texture"])


def _pixel_frames(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray]]:
    for frame, pixels in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
        if pixels.is_valid and len(pixels):
            yield frame, pixels.values.to_numpy(zero_copy_only=False)


def tile_stats(frames: DataFrame, width: int, height: int, tile: int, rules: TileRules = TileRules(), channels: int = 1) -> DataFrame:
    """frames (frame_id, pixels: gray values, or r, g, b by pixel for three channels) -> a row per tile. The last column and row take in the rest.

    Edges are steps above ``edge`` to the right and lower neighbours inside the frame, beyond the tile too, over twice the pixels. Saturation is 0 for gray frames.
    Sums go in reading order. A frame without pixels has no tiles; one with too few raises. Frames go through numpy one at a time.
    """
    grid = Grid(width, height, tile, channels, rules)
    names = [c.split()[0] for c in _STATS.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [(frame, grid.statistics(pixels)) for frame, pixels in _pixel_frames(batch)]
            if made:
                frame_ids = pa.array([frame for frame, _ in made for _ in range(grid.n.size)], pa.int64())
                placed = [pa.array(np.tile(v, len(made)), pa.int64()) for v in grid.place]
                yield pa.RecordBatch.from_arrays([frame_ids, *placed, *(pa.array(np.concatenate(v)) for v in zip(*(m for _, m in made), strict=True))], names=names)

    found = frames.select(F.col("frame_id").cast("long"), F.col("pixels").cast("array<double>")).mapInArrow(run, _STATS)
    return found.withColumn("label", tile_label(F.col("luma"), F.col("std"), F.col("edge_density"), F.col("saturation"), rules))


def area_shares(tiles: DataFrame) -> DataFrame:
    """Per frame, the share of each label in units of 1e-4 that add up to 1: largest remainders first, ties in the order of LABELS."""
    area = tiles.groupBy("frame_id").agg(*(F.sum(F.when(F.col("label") == k, F.col("width") * F.col("height")).otherwise(0)).alias(k) for k in LABELS))
    total = sum((F.col(k) for k in LABELS), F.lit(0))
    long = area.select("frame_id", total.alias("total"), F.posexplode(F.array(*LABELS)).alias("no", "area")).withColumn("exact", F.col("area") * 10_000.0 / F.col("total"))
    part = long.withColumn("units", F.floor("exact"))
    order = Window.partitionBy("frame_id").orderBy((F.col("exact") - F.col("units")).desc(), "no")
    missing = F.lit(10_000) - F.sum("units").over(Window.partitionBy("frame_id"))
    given = part.withColumn("units", F.col("units") + F.when(F.row_number().over(order) <= missing, 1).otherwise(0))
    return given.groupBy("frame_id").agg(*(F.max(F.when(F.col("no") == i, F.col("units") / 10_000.0)).alias(k) for i, k in enumerate(LABELS)))


def mean_shares(shares: DataFrame) -> DataFrame:
    """shares with recording_id -> their mean over the frames."""
    return shares.groupBy("recording_id").agg(*(rounded(F.avg(k)).alias(k) for k in LABELS))


_BLOCK = "frame_id bigint, label string, x bigint, y bigint, width bigint, height bigint, tiles bigint, area_ratio double"


def rectangles(rows: list[dict[int, int]], columns: int) -> Iterator[tuple[int, int, int, int, int]]:
    """Rows of a grid as label -> bits of the columns that hold it -> (label, first column, row, columns, rows), in reading order.

    A run goes as far right as its label does, then down while a row holds the whole run; its bits are cleared as it is taken.
    """
    for y, row in enumerate(rows):
        for x in range(columns):
            label = next((k for k, bits in row.items() if bits >> x & 1), None)
            if label is None:
                continue
            here = row[label] >> x
            wide = (~here & here + 1).bit_length() - 1
            run, high = (1 << wide) - 1 << x, 0
            while y + high < len(rows) and rows[y + high].get(label, 0) & run == run:
                rows[y + high][label] &= ~run
                high += 1
            yield label, x, y, wide, high


def frame_blocks(frames: DataFrame, width: int, height: int, tile: int, rules: TileRules = TileRules(), channels: int = 1) -> DataFrame:
    """frames as for tile_stats -> rectangles of tiles with equal labels: in reading order, as far right as the label goes on, then down while the whole row does.

    From pixels to rectangles a frame at a time, without a row per tile and without a shuffle.
    """
    grid = Grid(width, height, tile, channels, rules)
    names, columns = [c.split()[0] for c in _BLOCK.split(", ")], np.arange(grid.columns)

    def blocks(frame: int, pixels: np.ndarray) -> Iterator[tuple]:
        labels = grid.labels(*grid.statistics(pixels)).reshape(grid.rows, grid.columns)
        rows = [{int(k): sum(1 << int(x) for x in columns[line == k]) for k in np.unique(line)} for line in labels]
        for label, x, y, wide, high in rectangles(rows, grid.columns):
            left, top, w, h = grid.lefts[x], grid.tops[y], grid.lefts[x + wide] - grid.lefts[x], grid.tops[y + high] - grid.tops[y]
            yield frame, LABELS[label], int(left), int(top), int(w), int(h), wide * high, float(_half_up(w * h / (width * height), 4))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int64(), pa.string(), *[pa.int64()] * 5, pa.float64()]
        for batch in batches:
            made = [b for frame, pixels in _pixel_frames(batch) for b in blocks(frame, pixels)]
            if made:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*made, strict=True), kinds, strict=True)], names=names)

    return frames.select(F.col("frame_id").cast("long"), F.col("pixels").cast("array<double>")).mapInArrow(run, _BLOCK)


def merge_blocks(tiles: DataFrame) -> DataFrame:
    """The rectangles of frame_blocks out of the rows of tile_stats. Frames pass through a task in reading order, one at a time."""

    def one(cells: Iterable[tuple]) -> Iterator[tuple]:
        rows, at, area = [], {}, 0
        for row, column, x, y, w, h, label in cells:
            rows += [{} for _ in range(row + 1 - len(rows))]
            rows[row][label] = rows[row].get(label, 0) | 1 << column
            at[column, row] = x, y, x + w, y + h
            area += w * h
        for label, c, r, wide, high in rectangles(rows, max((c for c, _ in at), default=-1) + 1):
            (x, y, *_), (*_, right, bottom) = at[c, r], at[c + wide - 1, r + high - 1]
            yield label, x, y, right - x, bottom - y, wide * high, math.floor((right - x) * (bottom - y) / area * 10_000 + 0.5) / 10_000

    names = ["row", "column", "x", "y", "width", "height", "label"]
    rows = tiles.select(F.col("frame_id").alias("recording_id"), *(F.col(c).cast("long").alias(c) if c != "label" else F.col(c) for c in names))
    return streamed(rows, ["row", "column"], names, _BLOCK.replace("frame_id", "recording_id"), one).withColumnRenamed("recording_id", "frame_id")
