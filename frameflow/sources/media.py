"""What media tools report and write: probe reports, device listings, WAV bytes, frames in a stream of bytes."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType

from frameflow.functions.media import analysis_size, constant_rate, parse_rate
from frameflow.functions.numeric import once

_STREAM = (
    "index bigint, codec_type string, codec_name string, profile string, width string, height string, avg_frame_rate string, r_frame_rate string, pix_fmt string, nb_frames string, "
    "duration string, sample_rate string, channels string, bit_rate string, tags struct<rotate:string>, side_data_list array<struct<rotation:string>>"
)
_REPORT = f"streams array<struct<{', '.join(x.replace(' ', ':', 1) for x in _STREAM.split(', '))}>>, format struct<duration:string,bit_rate:string,format_name:string>"
_WAV_HEAD = 4096


def try_stream_size(report: Column) -> Column:
    """The first stream's width and height in a prober's JSON report, as whole numbers of 1 and more; null if it tells none."""
    stream = F.get(F.from_json(report, _REPORT)["streams"], F.lit(0))
    width, height = (F.floor(number_or_null(stream[k])).cast("long") for k in ("width", "height"))
    return F.when((width >= 1) & (height >= 1), F.struct(width.alias("width"), height.alias("height")))


def stream_size(report: Column) -> Column:
    """try_stream_size, with an error for a report that tells no size."""
    return F.coalesce(try_stream_size(report), F.raise_error(F.lit("the report tells no size of a video stream")).cast("struct<width:bigint,height:bigint>"))


def probed_analysis_size(size: Column, max_side: int) -> dict[str, Column]:
    """A stream's size and the even size that its frames are analysed at."""
    width, height = analysis_size(size["width"], size["height"], max_side)
    return {"source_width": size["width"], "source_height": size["height"], "width": F.when(size.isNotNull(), width), "height": F.when(size.isNotNull(), height)}


def parse_list(listings: DataFrame) -> DataFrame:
    """listings (list_id, text of a tool's list of what it can do) -> no, name: the names in its second column, each once, in the order they first come.

    A line is flags, then a name; headings and rules are left out.
    """
    lines = listings.select("list_id", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    plain = lines.where(~F.col("line").rlike(r"^(Encoders|Filters|Devices):|^\s*-+\s*$"))
    name = F.regexp_extract("line", r"^\s*[A-Z.]{1,6}\s+(\S+)", 1)
    firsts = plain.select("list_id", "pos", name.alias("name")).where("name <> ''").groupBy("list_id", "name").agg(F.min("pos").alias("pos"))
    return firsts.select("list_id", F.row_number().over(Window.partitionBy("list_id").orderBy("pos")).cast("long").alias("no"), "name")


def number_or_null(text: Column) -> Column:
    value = text.try_cast("double")
    return F.when(~F.isnan(value) & (F.abs(value) < float("inf")), value)


def _turned(stream: Column) -> Column:
    """Degrees: the tag unless it is 0, else the first side datum that isn't, negated."""
    other = lambda text: F.nullif(number_or_null(text), F.lit(0.0))
    side = F.get(F.filter(F.transform(stream["side_data_list"], lambda e: other(e["rotation"])), lambda v: v.isNotNull()), F.lit(0))
    return F.pmod(F.floor(F.coalesce(other(stream["tags"]["rotate"]), -side, F.lit(0.0)) + 0.5).cast("long"), F.lit(360))


#: The facts of ``probe_struct`` by name.
FACTS = (
    "readable", "container", "duration", "bitrate", "video_codec", "profile", "pixel_format", "width", "height", "coded_width", "coded_height", "rotation", "rate", "real_rate", "constant",
    "frames", "video_seconds", "audio_codec", "sample_rate", "channels", "audio_bitrate", "audio_seconds", "problems",
)


def probe_struct(report: Column) -> Column:
    """A prober's JSON report -> readable, container, duration, bitrate, the first video and audio stream's facts and the list of problems, in one struct out of one reading.

    Width and height are as decoded: swapped for a quarter turn. A report that is no JSON is unreadable, a fact that isn't told is null.
    """
    readable = F.coalesce(F.try_parse_json(report).isNotNull() & (F.trim(report) != "null"), F.lit(False))
    none = F.array().cast(f"array<struct<{', '.join(x.replace(' ', ':', 1) for x in _STREAM.split(', '))}>>")

    def read(told: Column) -> Column:
        streams = F.coalesce(told["streams"], none)
        first = lambda kind: F.get(F.filter(streams, lambda s: s["codec_type"] == kind), F.lit(0))
        return once(F.struct(F.size(streams).alias("n"), first("video").alias("video"), first("audio").alias("audio"), number_or_null(told["format"]["duration"]).alias("length")), lambda r: measured(told["format"], r))

    def measured(form: Column, r: Column) -> Column:
        video = r["video"]
        numbers = F.struct(
            F.when(video.isNotNull(), _turned(video)).alias("turned"), number_or_null(video["width"]).alias("width"), number_or_null(video["height"]).alias("height"),
            parse_rate(video["r_frame_rate"]).alias("real"), parse_rate(video["avg_frame_rate"]).alias("average"),
        )
        return once(numbers, lambda m: facts(form, r["n"], video, r["audio"], r["length"], m))

    def facts(form: Column, n: Column, video: Column, audio: Column, length: Column, m: Column) -> Column:
        swapped = m["turned"].isin(90, 270)
        width, height = F.when(swapped, m["height"]).otherwise(m["width"]), F.when(swapped, m["width"]).otherwise(m["height"])
        constant = constant_rate(m["real"], m["average"])
        problems = F.filter(
            F.array(
                F.when(n == 0, "no streams"), F.when(length.isNull(), "duration not told"), F.when(length <= 0, "duration not above 0"),
                F.when(~constant, "rate not constant"), F.when(video.isNotNull() & (width.isNull() | height.isNull()), "size not told"),
            ),
            lambda p: p.isNotNull(),
        )
        of = {
            "readable": readable, "container": form["format_name"], "duration": length, "bitrate": number_or_null(form["bit_rate"]),
            "video_codec": video["codec_name"], "profile": video["profile"], "pixel_format": video["pix_fmt"], "width": width, "height": height,
            "coded_width": m["width"], "coded_height": m["height"], "rotation": m["turned"], "rate": F.coalesce(m["average"], m["real"]), "real_rate": m["real"], "constant": constant,
            "frames": number_or_null(video["nb_frames"]), "video_seconds": F.when(video.isNotNull(), F.coalesce(number_or_null(video["duration"]), length)),
            "audio_codec": audio["codec_name"], "sample_rate": number_or_null(audio["sample_rate"]), "channels": number_or_null(audio["channels"]),
            "audio_bitrate": number_or_null(audio["bit_rate"]), "audio_seconds": F.when(audio.isNotNull(), F.coalesce(number_or_null(audio["duration"]), length)),
        }
        return once(of["readable"], lambda ok: F.struct(*(c.alias(k) for k, c in (of | {"readable": ok}).items()), F.when(ok, problems).otherwise(F.array(F.lit("unreadable"))).alias("problems")))

    return once(F.from_json(report, _REPORT), read)


def probe_facts(report: Column) -> dict[str, Column]:
    """The facts of ``probe_struct`` as columns by name. Each column reads the report by itself: for many of them take the struct."""
    whole = probe_struct(report)
    return {name: whole[name] for name in FACTS}


def parse_devices(logs: DataFrame) -> DataFrame:
    """logs (log_id, text) -> log_id, no (from 1), name, kind (video or audio), alternative: the last alternative name told before the next device, null for none."""
    lines = logs.select("log_id", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    found = lambda pattern, i: F.nullif(F.regexp_extract("line", pattern, i), F.lit(""))
    device = r'"([^"]+)"\s*\((video|audio)\)'
    marked = lines.select("log_id", "pos", found(device, 1).alias("name"), found(device, 2).alias("kind"), found(r'Alternative name\s+"([^"]+)"', 1).alias("other"))
    numbered = marked.withColumn("no", F.count("name").over(Window.partitionBy("log_id").orderBy("pos"))).where("no > 0")
    other = F.when(F.col("name").isNull(), F.col("other"))
    return numbered.groupBy("log_id", "no").agg(F.max("name").alias("name"), F.max("kind").alias("kind"), F.max_by(other, F.when(other.isNotNull(), F.col("pos"))).alias("alternative"))


def _data_offset(head: bytes | None) -> int | None:
    if head is None or len(head) < 12 or head[:4] != b"RIFF" or head[8:12] != b"WAVE":
        return None
    at = 12
    while at + 8 <= len(head):
        if head[at : at + 4] == b"data":
            return at + 8
        size = struct.unpack_from("<I", head, at + 4)[0]
        at += 8 + size + size % 2
    return -1


@F.pandas_udf(IntegerType())
def _data_offsets(heads: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for batch in heads:
        yield pd.Series([_data_offset(h) for h in batch], dtype="Int32")


def _little_endian(number: Column) -> Column:
    return F.unhex(F.concat(*(F.lpad(F.hex(F.shiftright(number, 8 * i).bitwiseAND(255)), 2, "0") for i in range(4))))


def repair_wav(wavs: DataFrame, content: str = "content") -> DataFrame:
    """Adds data_offset, data_bytes, repaired (the bytes with both sizes of the header as they are) and problem; the chunk of data begins in the first 4,096 bytes.

    Bytes that are no WAV, without a data chunk or without data have a problem and no other value. Only the header goes to Python.
    """
    total = F.length(content).cast("long")
    at = wavs.withColumn("data_offset", _data_offsets(F.substring(content, 1, _WAV_HEAD)))
    size = total - F.col("data_offset")
    problem = F.when(F.col("data_offset").isNull(), "no WAV").when(F.col("data_offset") < 0, "no data chunk").when(size <= 0, "no data")
    fixed = F.overlay(F.overlay(content, _little_endian(total - 8), F.lit(5)), _little_endian(size), F.col("data_offset") - 3)
    only = lambda c: F.when(F.col("problem").isNull(), c)
    done = at.withColumn("problem", problem)
    return done.withColumns({"data_bytes": only(size), "repaired": only(fixed), "data_offset": only(F.col("data_offset").cast("long"))})


def split_frames(chunks: DataFrame, size: int) -> DataFrame:
    """chunks (stream_id, seq, content) -> stream_id, i (from 0), frame: the stream's bytes in frames of ``size``; a frame may reach over chunks, a rest below a frame is left out.

    A chunk gives the part of each frame that it holds, and parts meet by frame: no stream is put together anywhere. Where a chunk begins is told by the lengths before it alone,
    which are put in order without their bytes. The seqs of a stream must differ.
    """
    order = Window.partitionBy("stream_id").orderBy("seq")
    length = F.length("content").cast("long")
    begins = chunks.select("stream_id", "seq", length.alias("n")).select("stream_id", "seq", F.coalesce(F.sum("n").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("at"))
    placed = chunks.where(length > 0).select("stream_id", "seq", "content").join(begins, ["stream_id", "seq"])
    first, last = F.floor(F.col("at") / size), F.floor((F.col("at") + length - 1) / size)
    parts = placed.select("stream_id", "content", "at", F.explode(F.sequence(first, last)).alias("i"))
    begin = F.greatest(F.col("i") * size - F.col("at"), F.lit(0))
    part = F.substring("content", (begin + 1).cast("int"), ((F.col("i") + 1) * size - F.col("at") - begin).cast("int"))
    met = parts.select("stream_id", "i", "at", part.alias("part")).groupBy("stream_id", "i").agg(F.array_sort(F.collect_list(F.struct("at", "part"))).alias("parts"))
    joined = F.aggregate("parts", F.lit(b""), lambda a, p: F.concat(a, p["part"]))
    return met.select("stream_id", "i", joined.alias("frame")).where(F.length("frame") == size)
