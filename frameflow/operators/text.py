"""Text lines and what a text gives as evidence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from frameflow.functions.numeric import half_up
from frameflow.functions.strings import has_text

# Patterns that count as signs of a shell and of code, and the stop words of two letters and more. Word ends are ASCII.
SHELL = (
    r"(?m)(^|\s)(PS\s+[A-Za-z]:\\|C:\\[^ ]*>|>|\$|#)\s*$",
    r"(^|\s)(npm|pnpm|yarn|git|node|python|pip|cargo|go|dotnet|docker|kubectl)\s+[\w-]+",
    r"(?i)(?<![A-Za-z0-9_])(error|warning|failed|exception|traceback|permission denied)(?![A-Za-z0-9_])",
    r"(?<![A-Za-z0-9_])(npm ERR!|ELIFECYCLE|ENOENT|EPERM)(?![A-Za-z0-9_])",
)
CODE = (
    r"(?m)[{};]\s*$",
    r"(?<![A-Za-z0-9_])(function|const|let|var|class|import|export|def|return|async|await|public|private|void)(?![A-Za-z0-9_])",
    r"=>|===|!==|::|\+\+|-->",
    r"(?m)^\s*(if|for|while|switch|try|catch)\s*[({]",
)
# One match for each line that begins like a prompt, that reads like code, that isn't blank; lines end at line feeds alone.
PROMPT_LINE = r"(?md)^[^\S\n]*(?:PS[^\S\n]+[A-Za-z]:\\|C:\\[^ \n]*>|\$|>|#)[^\S\n]"
CODE_LINE = r"(?md)^(?:[^\S\n]{2,}\S.*|.*[{};][^\S\n]*)$"
FULL_LINE = r"(?md)^[^\S\n]*\S"
STOP_WORDS = (
    "the and for with that this from are was were have has had not but you your our its it is be to of in on at as by or an a if then else when will can may all any one "
    "two new use used using get set out http https www com true false null undefined"
).split()


def text_evidence(text: Column) -> dict[str, Column]:
    """shell_hits and code_hits: patterns that the text matches plus its lines that do; char_count in UTF-16 units; line_count of lines that aren't blank."""
    source = F.coalesce(text, F.lit(""))
    hits = lambda patterns: sum((F.when(source.rlike(p), 1).otherwise(0) for p in patterns), F.lit(0))
    of = lambda p: F.regexp_count(source, F.lit(p))
    return {
        "shell_hits": hits(SHELL) + of(PROMPT_LINE), "code_hits": hits(CODE) + of(CODE_LINE),
        "char_count": F.length(source) + F.regexp_count(source, F.lit(r"[\x{10000}-\x{10FFFF}]")), "line_count": of(FULL_LINE),
    }


def keywords(texts: DataFrame, key: str, stop_words: DataFrame | None = None) -> DataFrame:
    """texts (key, text) -> key, term, n: words of two characters and more, lower-cased without trailing dots and dashes, and pairs in runs of Chinese characters."""
    words = F.transform(F.regexp_extract_all("text", F.lit("[A-Za-z][A-Za-z0-9_+#.-]+"), 0), lambda w: F.regexp_replace(F.lower(w), "[.-]+$", ""))
    runs = F.regexp_extract_all("text", F.lit(r"[\u4e00-\u9fff]{2,}"), 0)
    pairs = F.flatten(F.transform(runs, lambda r: F.transform(F.sequence(F.lit(1), F.length(r) - 1), lambda i: F.substr(r, i, F.lit(2)))))
    stops = F.broadcast(texts.sparkSession.createDataFrame([(w,) for w in STOP_WORDS], "term string")) if stop_words is None else stop_words
    terms = texts.select(key, F.explode(F.concat(words, pairs)).alias("term")).where(F.length("term") >= 2)
    return terms.join(stops, "term", "left_anti").groupBy(key, "term").agg(F.count(F.lit(1)).alias("n"))


def top_keywords(counts: DataFrame, key: str, limit: int = 40, least: int = 1) -> DataFrame:
    """Of the keywords (key, term, n) seen at least ``least`` times, the ``limit`` most frequent of each key with their rank; ties in the order of a dictionary (Unicode's root collation)."""
    order = Window.partitionBy(key).orderBy(F.col("n").desc(), F.collate("term", "UNICODE"), "term")
    return counts.where(F.col("n") >= least).withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= limit)


def reading_order(lines: DataFrame, key: str) -> DataFrame:
    """The ids of each key's lines from top to bottom, then left to right, as a list."""
    ordered = F.array_sort(F.collect_list(F.struct("y", "x", "id")))
    return lines.groupBy(key).agg(F.transform(ordered, lambda r: r["id"]).alias("ids"))


def attach_lines(lines: DataFrame, stills: DataFrame) -> DataFrame:
    """lines (still, ...) with the segment_id and time (at) of their still; lines of unknown stills are left out."""
    return lines.join(stills.select("still", "segment_id", "at"), "still")


def in_region(lines: DataFrame, x: int, y: int, w: int, h: int) -> DataFrame:
    """Lines whose box (x, y, w, h) meets the region; touching counts."""
    c = F.col
    return lines.where((c("x") + c("w") >= x) & (c("x") <= x + w) & (c("y") + c("h") >= y) & (c("y") <= y + h))


def confident(lines: DataFrame, least: float) -> DataFrame:
    return lines.where(F.col("confidence").isNull() | (F.col("confidence") >= least)).where(has_text(F.col("text")))


def map_lines(lines: DataFrame, factor: float, dx: int, dy: int) -> DataFrame:
    """Boxes moved from the image that was read to the source, and their centres; a ``polygon`` (array of x, y) moves with them."""
    to = lambda c, d: half_up(F.col(c) * factor + d)
    moved = lines.withColumns({"x": to("x", dx), "y": to("y", dy), "w": half_up(F.col("w") * factor), "h": half_up(F.col("h") * factor)})
    if "polygon" in lines.columns:
        moved = moved.withColumn("polygon", F.transform("polygon", lambda p: F.array(half_up(p[0] * factor + dx), half_up(p[1] * factor + dy))))
    return moved.withColumns({"cx": half_up(F.col("x") + F.col("w") / 2), "cy": half_up(F.col("y") + F.col("h") / 2)})


def polygon_box(points: Column) -> dict[str, Column]:
    xs, ys = F.transform(points, lambda p: p[0]), F.transform(points, lambda p: p[1])
    return {"x": F.array_min(xs), "y": F.array_min(ys), "w": F.array_max(xs) - F.array_min(xs), "h": F.array_max(ys) - F.array_min(ys)}
