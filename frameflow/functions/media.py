"""Scalar functions over media facts, sizes, languages and log text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from frameflow.functions.numeric import finite_or_null, half_up, rounded
from frameflow.functions.strings import BLANK, has_text, trimmed

# Language aliases, and the container of each file ending.
LANGUAGES = {
    "ch": "zh-Hans-CN", "zh-cn": "zh-Hans-CN", "zh-hans": "zh-Hans-CN", "cht": "zh-Hant-TW", "zh-tw": "zh-Hant-TW", "zh-hant": "zh-Hant-TW", "en": "en-US", "eng": "en-US",
    "japan": "ja-JP", "ja": "ja-JP", "korean": "ko-KR", "ko": "ko-KR", "cyrillic": "ru-RU", "ru": "ru-RU",
}
CONTAINERS = {".mp4": "mp4", ".m4v": "mp4", ".mov": "mov", ".mkv": "mkv", ".webm": "webm", ".wav": "wav", ".m4a": "m4a", ".mp3": "mp3"}


def _lookup(table: dict[str, str], key: Column) -> Column:
    return F.element_at(F.create_map(*(F.lit(x) for pair in table.items() for x in pair)), key)


def parse_rate(text: Column) -> Column:
    """'30000/1001' -> 29.97003; a blank, zero or negative rate is null."""
    parts = F.split(text, "/")
    value = F.try_divide(F.get(parts, F.lit(0)).try_cast("double"), F.coalesce(F.get(parts, F.lit(1)).try_cast("double"), F.lit(1.0)))
    return F.when(value > 0, rounded(value, 6))


def rotation(tag: Column, side_data: Column) -> Column:
    """Degrees 0 to 359: the tag, else the side data negated."""
    return F.pmod(F.coalesce(tag, -side_data, F.lit(0)), F.lit(360))


def constant_rate(rate: Column, average: Column) -> Column:
    return F.when(rate.isNotNull() & average.isNotNull(), F.abs(rate - average) < F.greatest(F.lit(0.01), rate * 0.01))


def half_to_float(bits: Column) -> Column:
    """The value of an IEEE half given as 16 bits; infinite and NaN as Spark has them."""
    sign = F.when(F.shiftright(bits, 15).bitwiseAND(1) == 1, -1.0).otherwise(1.0)
    exponent, fraction = F.shiftright(bits, 10).bitwiseAND(31), bits.bitwiseAND(1023).cast("double")
    return (
        F.when(exponent == 0, sign * fraction * 2.0**-24)
        .when(exponent == 31, F.when(fraction == 0, sign * float("inf")).otherwise(float("nan")))
        .otherwise(sign * F.pow(F.lit(2.0), exponent - 15) * (1 + fraction / 1024))
    )


def float_to_half(value: Column) -> Column:
    """The 16 bits of a value as an IEEE half: digits beyond its ten are cut off, what is below its normal range is 0, what is beyond it or NaN infinite."""
    single = value.cast("float").cast("double")
    size = F.abs(single)
    guess = F.floor(F.log2(size))
    power = lambda e: F.pow(F.lit(2.0), e)
    exponent = guess + F.when(size >= power(guess + 1), 1).when(size < power(guess), -1).otherwise(0)
    sign = F.when(single.cast("string").startswith("-"), 32768).otherwise(0)
    bits = (
        F.when(F.isnan(size) | (size >= 65536.0), 31744).when(size < 2.0**-14, 0)
        .otherwise((exponent + 15) * 1024 + F.floor((size / power(exponent) - 1) * 1024))
    )
    return F.when(value.isNotNull(), (sign + bits).cast("int"))


def scale_factor(source_width: Column, read_width: Column) -> Column:
    """By how much a coordinate of the image that was read grows in the source; 1 where the widths give no factor above 0."""
    factor = F.when(read_width > 0, F.try_divide(source_width.cast("double"), read_width.cast("double")))
    return F.when((factor > 0) & (factor < float("inf")), factor).otherwise(1.0)


def input_tensor(pixels: Column, width: int, height: int, side: int, pad_x: int, pad_y: int) -> Column:
    """Interleaved bytes (r, g, b by pixel, row by row) -> three planes of side x side floats of 0 to 1, the image at (pad_x, pad_y), 0 around it."""
    plane = side * side

    def at(i: Column) -> Column:
        x, y = F.pmod(i, F.lit(side)) - pad_x, F.floor(F.pmod(i, F.lit(plane)) / side) - pad_y
        inside = (x >= 0) & (x < width) & (y >= 0) & (y < height)
        source = (y * width + x) * 3 + F.floor(i / plane)
        return F.when(inside, F.get(pixels, source.cast("int")).cast("double") / 255.0).otherwise(0.0).cast("float")

    return F.transform(F.sequence(F.lit(0), F.lit(3 * plane - 1)), at)


def pruned(options: Column) -> Column:
    """A map of strings without its null and empty values."""
    return F.map_filter(options, lambda k, v: v.isNotNull() & (v != ""))


def merged_options(defaults: Column, options: Column) -> Column:
    """The defaults with the given options over them; null and empty options leave the default."""
    given = F.coalesce(pruned(options), F.create_map().cast("map<string,string>"))
    return F.map_concat(F.map_filter(defaults, lambda k, v: ~F.map_contains_key(given, k)), given)


def setting(*values: Column) -> Column:
    """The first of the values (call, configuration, default) that is a finite number."""
    return F.coalesce(*(F.when(F.abs(v) < float("inf"), F.nanvl(v, F.lit(None).cast("double"))) for v in (v.cast("double") for v in values)))


def region(text: Column) -> Column:
    """'x,y,width,height' as a struct of rounded longs, x and y at least 0; null stays null, anything else that is no region of positive size raises."""
    parts = F.transform(F.split(text, ","), lambda p: F.when(F.trim(p) == "", 0.0).otherwise(p.try_cast("double")))
    good = (F.size(parts) == 4) & F.forall(parts, lambda v: v.isNotNull() & (F.abs(v) < float("inf"))) & (parts[2] > 0) & (parts[3] > 0)
    whole = [half_up(F.get(parts, F.lit(i))) for i in range(4)]
    box = F.struct(
        F.greatest(whole[0], F.lit(0)).alias("x"), F.greatest(whole[1], F.lit(0)).alias("y"), whole[2].alias("width"), whole[3].alias("height")
    )
    return F.when(text.isNull(), None).when(F.coalesce(good, F.lit(False)), box).otherwise(F.raise_error(F.concat(F.lit("no region x,y,width,height: "), text)))


def analysis_notes(frames: Column, leftover: Column, found: Column, most: Column, start: Column, seconds: Column, least: Column) -> Column:
    """What to know about an analysis, the first four notes: frames, bytes of a last part frame, segments found and allowed, start, seconds, shortest segment."""
    said = lambda text, *values: F.format_string(text, *values)
    notes = F.array(
        F.when(frames == 0, F.lit("no frames decoded")),
        F.when(leftover > 0, said("%d bytes of a last part frame left out", leftover)),
        F.when(found > most, said("%d segments beyond the %d allowed, the last ones put together", found, most)),
        F.when(start > 0, F.concat(F.lit("from second "), start.cast("string"), said(": %d frames, ", frames), seconds.cast("string"), F.lit(" seconds"))),
        F.when((frames > 0) & (seconds < least), F.concat(seconds.cast("string"), F.lit(" seconds are less than a segment's least of "), least.cast("string"))),
    )
    return F.slice(F.filter(notes, lambda n: n.isNotNull()), 1, 4)


def letterbox_pad(size: Column, side: int) -> Column:
    return F.greatest(F.floor((F.lit(side) - size) / 2), F.lit(0)).cast("long")


def fit_inside(width: Column, height: Column, max_side: int) -> tuple[Column, Column, Column]:
    """(width, height, scaled) with the long side at most max_side and both even; halves of a pair go up."""
    long = F.greatest(width, height)
    ratio = F.when(long > max_side, F.lit(float(max_side)) / long).otherwise(1.0)
    even = lambda v: F.greatest(half_up(v * ratio / 2) * 2, F.lit(2))
    return even(width), even(height), long > max_side


def analysis_size(width: Column, height: Column, max_side: int) -> tuple[Column, Column]:
    """Size of the analysis frame: rounded, then down to even, at least 2."""
    ratio = F.least(F.lit(1.0), F.lit(float(max_side)) / F.greatest(width, height))
    even = lambda v: F.greatest(half_up(v * ratio) - F.pmod(half_up(v * ratio), F.lit(2)), F.lit(2))
    return even(width), even(height)


def read_scale(width: Column, height: Column) -> Column:
    """How far to enlarge an image before reading text: 1 to 3, toward a long side of 1,000."""
    return F.least(F.greatest(half_up(F.lit(1000.0) / F.greatest(width, height)), F.lit(1)), F.lit(3))


def language_tag(name: Column) -> Column:
    said = trimmed(name)
    known = _lookup(LANGUAGES, F.lower(said))
    return F.coalesce(F.when(said == "", None).otherwise(known), F.when(said.rlike("(?i)^[a-z]{2}(-[a-z0-9]+)*$"), said), F.lit("zh-Hans-CN"))


def container_for(path: Column) -> Column:
    return _lookup(CONTAINERS, F.lower(F.regexp_extract(path, r"(\.[^./\\]*)$", 1)))


def escaped(value: Column) -> Column:
    s = F.replace(value, F.lit("\\"), F.lit("\\\\"))
    return F.replace(F.replace(s, F.lit(":"), F.lit("\\:")), F.lit("'"), F.lit("\\'"))


def tail_lines(text: Column, n: int = 6) -> Column:
    lines = F.transform(F.filter(F.split(text, "\n"), has_text), lambda x: F.regexp_replace(x, f"{BLANK}+$", ""))
    return F.array_join(F.slice(lines, F.greatest(F.size(lines) - n, F.lit(0)) + 1, F.lit(n)), "\n")


def last_json_line(text: Column) -> Column:
    """The last line that starts with { and is JSON."""
    lines = F.filter(F.split(text, "\n"), lambda x: trimmed(x).startswith("{") & F.try_parse_json(x).isNotNull())
    return F.try_element_at(lines, F.lit(-1))


def tensor_layout(d1: Column, d2: Column) -> Column:
    """Which of two axes holds the channels: the one of 5 to 1,024; of both the smaller, the last on a tie; null for neither."""
    first, last = d1.between(5, 1024), d2.between(5, 1024)
    return F.when(first & last, F.when(d1 < d2, "channel_major").otherwise("row_major")).when(first, "channel_major").when(last, "row_major")


def confidence(value: Column, score: Column) -> Column:
    """A reader's confidence, or its score where it gives none, as 0 to 1 with 4 places; null if that is no finite number."""
    known = finite_or_null(F.coalesce(value, score).cast("double"))
    return F.when(known.isNotNull(), rounded(F.least(F.greatest(known, F.lit(0.0)), F.lit(1.0))))


def missing_needs(have: Column, needs: Column) -> Column:
    """What is needed and not among what is there, in the order of the needs."""
    return F.filter(needs, lambda n: ~F.array_contains(F.coalesce(have, F.array().cast("array<string>")), n))


#: Shares of the asked seconds and of the expected frames below which a take is short, or has dropped frames.
SHORT_TAKE, DROPPED = 0.9, 0.9


def capture_verdict(asked: Column, duration: Column, frames: Column, rate: Column, audio_asked: Column, audio: Column, readable: Column) -> dict[str, Column]:
    """short_take (null for an unknown duration), dropped, ok and notes of a capture. Dropped frames are noted and do not spoil it.

    asked, duration: seconds; frames: decoded ones, null if unknown; rate: frames a second; the last three are booleans.
    """
    short = F.when(readable, duration < SHORT_TAKE * asked)
    expected = half_up(F.coalesce(duration, F.lit(0.0)) * rate)
    dropped = F.coalesce(readable & (expected > 0) & (frames / expected < DROPPED), F.lit(False))
    ok = readable & ~F.coalesce(short, F.lit(False)) & (~audio_asked | audio) & F.coalesce(frames > 0, F.lit(True))
    notes = F.when(~readable, F.array(F.lit("unreadable"))).otherwise(
        F.filter(
            F.array(
                F.when(duration.isNull(), "duration unknown").when(short, "shorter than asked").otherwise("as long as asked"),
                F.when(audio_asked & ~audio, "audio missing").when(~audio_asked & audio, "audio not asked for"), F.when(dropped, "frames dropped"),
            ),
            lambda n: n.isNotNull(),
        )
    )
    return {"short_take": short, "dropped": dropped, "ok": ok, "notes": notes}
