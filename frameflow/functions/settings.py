"""Configurations as JSON text: what each setting may be, as data, and columns that check and complete them."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from frameflow.functions.numeric import once


@dataclass(frozen=True)
class Setting:
    """kind: text, number (low to high), count (a number of 1 to 100,000, rounded down), choice (one of ``choices``), switch, or scale (auto or a number)."""

    field: str
    kind: str
    default: str | float | bool | None = None
    low: float = 1
    high: float = 100_000
    choices: tuple[str, ...] = ()
    whole: bool = False


# Every setting with its default and its bounds.
SETTINGS = (
    Setting("maxConcurrent", "number", 2, 1, 8, whole=True),
    Setting("projectRoot", "text"),
    Setting("ffmpegPath", "text"),
    Setting("ffprobePath", "text"),
    Setting("defaultTimeoutMs", "number", 600_000, 1000, 24 * 3600 * 1000),
    Setting("analysis.sceneThreshold", "number", 8, 0.1, 255),
    Setting("analysis.minSegmentSec", "number", 1, 0.1, 600),
    Setting("analysis.maxSegmentSec", "number", 30, 1, 3600),
    Setting("analysis.mergeShortSec", "number", 0.7, 0, 60),
    Setting("analysis.fps", "number", 4, 0.5, 30),
    Setting("analysis.maxSide", "count", 320),
    Setting("analysis.maxKeyframes", "count", 120),
    Setting("analysis.maxSegments", "count", 400),
    Setting("analysis.ocrMaxFrames", "count", 60),
    Setting("analysis.detectMaxFrames", "count", 40),
    Setting("analysis.tileSize", "count", 16),
    Setting("ocr.provider", "choice", "auto", choices=("auto", "sibling", "winrt", "off")),
    Setting("ocr.language", "text", "ch"),
    Setting("ocr.pluginPath", "text"),
    Setting("ocr.scale", "scale", "auto", 1, 3),
    Setting("detector.modelPath", "text"),
    Setting("detector.minScore", "number", 0.35, 0.01, 0.99),
    Setting("detector.iou", "number", 0.45, 0.05, 0.95),
    Setting("detector.maxSide", "count", 640),
    Setting("detector.threads", "count", 1),
    Setting("asr.enabled", "switch", True),
    Setting("asr.language", "text"),
    Setting("asr.maxAudioBytes", "count", 4 * 1024 * 1024),
    Setting("asr.maxIntervals", "count", 60),
)

_VIOLATION = "array<struct<field:string,problem:string>>"


def _number(x: float) -> str:
    return str(int(x)) if float(x).is_integer() else str(x)


def _problem(s: Setting, kind: Column, text: Column) -> Column:
    """What is wrong with a value of a JSON kind, given as text; null if nothing is."""
    number = text.try_cast("double")
    inside = kind.rlike("^(BIGINT|DOUBLE|FLOAT|DECIMAL)") & number.between(s.low, s.high)
    said = {
        "text": (kind == "STRING", "must be a string or null"), "switch": (kind == "BOOLEAN", "must be a boolean"),
        "number": (inside, f"must be a number between {_number(s.low)} and {_number(s.high)}"), "count": (inside, f"must be a number between {_number(s.low)} and {_number(s.high)}"),
        "scale": (((kind == "STRING") & (text == "auto")) | inside, f"must be a number between {_number(s.low)} and {_number(s.high)}"),
    }
    if s.kind == "choice":
        return F.when(kind != "STRING", "must be a string or null").when(~text.isin(*s.choices), f"must be one of {', '.join(s.choices)}")
    good, problem = said[s.kind]
    return F.when(~F.coalesce(good, F.lit(False)), problem)


def _parsed(config: Column, body: Callable[[Column], Column]) -> Column:
    """body of the configuration parsed once; null is given for what is no JSON."""
    return once(F.try_parse_json(config), body)


def _read(parsed: Column, s: Setting, body: Callable[[Column, Column], Column]) -> Column:
    """body of a setting's JSON kind and text, each read once; both null where it isn't given. What isn't an object has no settings."""

    def told(v: Column) -> Column:
        return once(F.schema_of_variant(v), lambda kind: F.when(v.isNotNull() & (kind != "VOID"), F.struct(kind.alias("kind"), F.try_variant_get(v, "$", "string").alias("text"))))

    return once(F.try_variant_get(parsed, f"$.{s.field}", "variant"), lambda v: once(told(v), lambda t: body(t["kind"], t["text"])))


def violations(config: Column, settings: tuple[Setting, ...] = SETTINGS) -> Column:
    """JSON text -> the settings that it gets wrong, in the order of the table: field and problem. An absent, null or empty configuration breaks no rule; one that is no JSON does."""

    def wrong(s: Setting, kind: Column, text: Column) -> Column:
        problem = F.when(kind.isNotNull(), _problem(s, kind, text))
        return once(problem, lambda p: F.when(p.isNotNull(), F.struct(F.lit(f"config.{s.field}").alias("field"), p.alias("problem"))))

    broken = F.array(F.struct(F.lit("config").alias("field"), F.lit("must be JSON").alias("problem"))).cast(_VIOLATION)

    def found(parsed: Column) -> Column:
        each = F.array(*(_read(parsed, s, lambda kind, text, s=s: wrong(s, kind, text)) for s in settings))
        return F.when(config.isNotNull() & (config != "") & parsed.isNull(), broken).otherwise(F.filter(each, lambda v: v.isNotNull()).cast(_VIOLATION))

    return _parsed(config, found)


def checked(config: Column, settings: tuple[Setting, ...] = SETTINGS) -> Column:
    """The configuration itself, or an error that names the first setting it gets wrong."""
    said = lambda wrong: F.when(F.size(wrong) == 0, config).otherwise(F.raise_error(F.concat(wrong[0]["field"], F.lit(" "), wrong[0]["problem"])).cast("string"))
    return once(violations(config, settings), said)


def _completed(parsed: Column, s: Setting) -> Column:
    def value(kind: Column, text: Column) -> Column:
        if s.kind in ("number", "count"):
            number = text.try_cast("double")
            return F.coalesce(F.floor(number).cast("double") if s.whole or s.kind == "count" else number, F.lit(float(s.default)))
        if s.kind == "switch":
            return F.coalesce(text.try_cast("boolean"), F.lit(s.default))
        return F.coalesce(text, F.lit(s.default).cast("string"))

    return _read(parsed, s, value)


def completed_struct(config: Column, settings: tuple[Setting, ...] = SETTINGS) -> Column:
    """Each setting as it holds, in one struct out of one reading: what a sound configuration gives, counts rounded down, else its default. Fields have underscores for dots."""
    return _parsed(config, lambda parsed: F.struct(*(_completed(parsed, s).alias(s.field.replace(".", "_")) for s in settings)))


def completed(config: Column, settings: tuple[Setting, ...] = SETTINGS) -> dict[str, Column]:
    """The fields of ``completed_struct`` as columns by name. Each column reads the configuration by itself: for many of them take the struct."""

    def one(s: Setting) -> Column:
        return _parsed(config, lambda parsed: _completed(parsed, s))

    return {s.field.replace(".", "_"): one(s) for s in settings}
