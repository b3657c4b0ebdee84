"""Ordered rules that name a segment."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

c = F.col


# The rules in order, and what decides on each.
def kind_rules() -> list[tuple[str, Column]]:
    return [
        ("terminal", (c("shell_hits") >= 3) & (c("dark") >= 0.15)),
        ("code", (c("code_hits") >= 4) & (c("text") >= 0.08)),
        ("presenter", (c("person") >= 0.25) & (c("text") < 0.1)),
        ("picture", c("picture") >= 0.45),
        ("text", (c("text") >= 0.16) | (c("line_count") >= 12)),
        ("document", (c("text") + c("flat") >= 0.6) & (c("line_count") >= 3)),
        ("idle", (c("motion") < 0.35) & (c("line_count") == 0) & (c("objects") == 0)),
    ]


def first_kind(rules: list[tuple[str, Column]] | None = None, otherwise: str = "desktop") -> Column:
    out = F.lit(otherwise)
    for kind, when in reversed(rules or kind_rules()):
        out = F.when(when, kind).otherwise(out)
    return out


def reason(kind: Column) -> Column:
    """One line with the numbers that decided."""
    pct = lambda x: F.format_string("%.1f%%", F.floor(x * 1000 + 0.5) / 10)
    n = lambda name: c(name).cast("string")
    says = {
        "terminal": F.concat(n("shell_hits"), F.lit(" lines like shell output, dark share "), pct(c("dark"))),
        "code": F.concat(n("code_hits"), F.lit(" lines like code, text share "), pct(c("text"))),
        "presenter": F.concat(F.lit("a person is seen, text share "), pct(c("text"))),
        "picture": F.concat(F.lit("picture share "), pct(c("picture"))),
        "text": F.concat(F.lit("text share "), pct(c("text")), F.lit(", lines "), n("line_count")),
        "document": F.concat(F.lit("text and flat share "), pct(c("text") + c("flat")), F.lit(", lines "), n("line_count")),
        "idle": F.lit("little motion, no text, no objects"),
    }
    out = F.concat(F.lit("no rule holds, lines "), n("line_count"))
    for name, text in says.items():
        out = F.when(kind == name, text).otherwise(out)
    return out


def group_kinds(named: DataFrame) -> DataFrame:
    """Per recording and kind, the indexes in order as text; a blank kind is desktop."""
    kind = F.when(F.coalesce(F.col("kind"), F.lit("")) == "", "desktop").otherwise(F.col("kind"))
    return named.groupBy("recording_id", kind.alias("kind")).agg(F.array_join(F.transform(F.array_sort(F.collect_list("index")), lambda i: i.cast("string")), ",").alias("indexes"))
