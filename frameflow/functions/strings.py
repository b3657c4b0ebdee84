"""Blanks as the documents' own tools see them: ASCII blanks, Unicode spaces, line and paragraph separators, byte order marks."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

BLANK = r"[\s\x0B\p{Zs}\u2028\u2029\uFEFF]"


def trimmed(text: Column) -> Column:
    return F.regexp_replace(text, f"^{BLANK}+|{BLANK}+$", "")


def has_text(text: Column) -> Column:
    """Whether anything but blanks stands in a text; false for null."""
    return F.coalesce(text.rlike(BLANK.replace("[", "[^", 1)), F.lit(False))
