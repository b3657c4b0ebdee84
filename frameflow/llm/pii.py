"""Personal data: regular expressions propose spans, checksums confirm them, context words adjust a score. DataFrame functions only."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from frameflow.llm.common import sha256_hex, table


@dataclass(frozen=True)
class Kind:
    """pattern finds candidates; where it narrows the contract's pattern, only candidates that fail the check anyway are left out.

    Quantifiers are possessive where what follows can't match inside them: Java then neither backtracks nor recurses on very long runs.
    """

    name: str
    pattern: str
    base: bool
    score: float
    context: str
    needs: str = ""  # texts without it can't match


_EMAIL_RUN = "[A-Za-z0-9._%+-]"
# The kinds in the contract's order, then those the method adds.
KINDS = (
    Kind("email", rf"(?:(?<!{_EMAIL_RUN})|\G){_EMAIL_RUN}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", True, 0.9, "mail|contact|write to|reply", "@"),
    Kind("ip", r"(?:(?<![0-9])|\G)[0-9]++(?:\.[0-9]++){3}", True, 0.7, r"\bip\b|host|server|address|login"),
    Kind("card", r"(?<![0-9])(?<![0-9][ -])[0-9](?:[ -]?[0-9]){12,18}+(?![ -]?[0-9])", True, 0.8, "card|visa|credit|debit|pay|kreditkarte|carte|tarjeta"),
    Kind("phone", r"\+[0-9][ ().0-9-]+[0-9]", True, 0.7, "call|phone|tel|mobile|fax|ring", "+"),
    Kind("iban", r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:[A-Z0-9]{11,30}+|(?: [A-Z0-9]{4}){2,7}+(?: [A-Z0-9]{1,3})?+)(?![A-Za-z0-9])", False, 0.8, "iban|account|bank|transfer|konto|compte|cuenta"),
    Kind("ssn", r"(?<![0-9-])(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}(?![0-9-])", False, 0.4, r"ssn|social security|\bss\b|tax"),
)
#: Added kinds below this score are not reported; base kinds are reported whatever their score.
MIN_SCORE = 0.5
#: Context reaches so many code points before and after a span.
BEFORE, AFTER = 40, 20
AGAINST = r"version|release|order no|invoice|build|example"


def _luhn(digits: Column) -> Column:
    def value(c: Column, i: Column) -> Column:
        d = c.cast("int") * F.when(i % 2 == 1, 2).otherwise(1)
        return F.when(d > 9, d - 9).otherwise(d)

    return F.aggregate(F.transform(F.split(F.reverse(digits), ""), value), F.lit(0), lambda a, x: a + x) % 10 == 0


def _mod97(iban: Column) -> Column:
    compact = F.replace(iban, F.lit(" "), F.lit(""))
    moved = F.concat(F.substr(compact, F.lit(5)), F.substring(compact, 1, 4))

    def step(acc: Column, c: Column) -> Column:
        return F.when(c.rlike("[0-9]"), (acc * 10 + c.cast("int")) % 97).otherwise((acc * 100 + F.ascii(c) - 55) % 97)

    return F.aggregate(F.split(moved, ""), F.lit(0), step) == 1


_OCTET = "0*(?:[0-9]{1,2}|1[0-9][0-9]|2[0-4][0-9]|25[0-5])"


def _confirmed(kind: Kind, match: Column) -> Column:
    digits = F.regexp_replace(match, "[^0-9]", "")
    if kind.name == "ip":
        return match.rlike(rf"^{_OCTET}(?:\.{_OCTET}){{3}}$")
    if kind.name == "card":
        return _luhn(digits)
    if kind.name == "phone":
        return F.length(digits).between(9, 15)
    if kind.name == "iban":
        return _mod97(match)
    return F.lit(True)


def _total(numbers: Column) -> Column:
    return F.aggregate(numbers, F.lit(0).cast("long"), lambda a, x: a + x)


def _placed(no: int, kind: Kind, matches: Column, gaps: Column):
    """Adds match i to the spans found so far: the piece before it and the match itself move the position on."""

    def step(acc: Column, i: Column) -> Column:
        hit, gap = F.get(matches, i), F.get(gaps, i)
        start = acc["at"] + F.length(gap).cast("long")
        end = start + F.length(hit).cast("long")
        near = F.lower(F.concat(F.right(gap, F.lit(BEFORE)), F.lit(" "), F.left(F.get(gaps, i + 1), F.lit(AFTER))))
        score = F.lit(kind.score) + F.when(near.rlike(kind.context), 0.2).otherwise(0.0) - F.when(near.rlike(AGAINST), 0.2).otherwise(0.0)
        score = F.round(F.least(F.greatest(score, F.lit(0.0)), F.lit(1.0)), 2)
        span = F.struct(F.lit(no).alias("kind_no"), F.lit(kind.name).alias("kind"), start.alias("start"), end.alias("end"), score.alias("score"))
        keep = _confirmed(kind, hit) if kind.base else _confirmed(kind, hit) & (score >= MIN_SCORE)
        return F.struct(end.alias("at"), F.when(keep, F.concat(acc["spans"], F.array(span))).otherwise(acc["spans"]).alias("spans"))

    return step


def find_pii(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text) -> doc_id and ``found``: kind number, kind, start, end (code points, end exclusive), score, by kind, then start.

    Per kind, matches are leftmost and non-overlapping; one that fails its check is dropped without another
    try inside it. The positions come from the pieces between the matches. The score is the kind's, plus 0.2 if
    one of its context words stands within 40 code points before or 20 after the span (and before the next match), less
    0.2 if a word that speaks against it does, within 0 to 1. Null and empty texts have no spans; rows with repeated doc_id are
    each scanned; other columns are ignored. Works row by row: no shuffle, whole texts.
    The matches of a text are placed in blocks of about the square root of their number, so that no list of all of them is copied for each.
    """
    text = F.coalesce("text", F.lit(""))
    out = docs.select("doc_id", text.alias("text"))
    no_text, none = F.array().cast("array<string>"), "array<struct<kind_no:int,kind:string,start:bigint,end:bigint,score:double>>"
    for k in KINDS:
        hits = F.regexp_extract_all("text", F.lit(k.pattern), 0)
        out = out.withColumn(f"m_{k.name}", F.when(F.contains("text", F.lit(k.needs)), hits).otherwise(no_text) if k.needs else hits)
    for no, k in enumerate(KINDS):
        m, g = F.col(f"m_{k.name}"), F.col(f"g_{k.name}")
        out = out.withColumn(f"g_{k.name}", F.when(F.size(m) > 0, F.split("text", k.pattern, -1)).otherwise(no_text))

        n, lengths, sums = F.size(m), F.col(f"l_{k.name}"), F.col(f"b_{k.name}")
        block = F.ceil(F.sqrt(n)).cast("int")
        out = out.withColumn(f"l_{k.name}", F.when(n > 0, F.zip_with(m, F.slice(g, F.lit(1), n), lambda hit, gap: (F.length(hit) + F.length(gap)).cast("long"))).otherwise(F.array().cast("array<bigint>")))
        blocks = F.sequence(F.lit(0), F.floor((F.size(lengths) - 1) / block).cast("int"))
        out = out.withColumn(f"b_{k.name}", F.when(n > 0, F.transform(blocks, lambda b: _total(F.slice(lengths, b * block + 1, block)))).otherwise(F.array().cast("array<bigint>")))  # noqa: B023
        spans = F.transform(
            F.sequence(F.lit(0), F.size(sums) - 1),
            lambda b: F.aggregate(  # noqa: B023
                F.sequence(b * block, F.least((b + 1) * block, n) - 1), F.struct(_total(F.slice(sums, F.lit(1), b)).alias("at"), F.array().cast(none).alias("spans")), _placed(no, k, m, g), lambda acc: acc["spans"]  # noqa: B023
            ),
        )
        out = out.withColumn(f"s_{k.name}", F.when(n > 0, F.flatten(spans)).otherwise(F.array().cast(none)))
    return out.select("doc_id", F.concat(*(f"s_{k.name}" for k in KINDS)).alias("found"))


def op2_pii_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_pii(table(spark, sf_dir, "documents"))
    said = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    base = [k.name for k in KINDS if k.base]
    count = lambda k: F.size(F.filter("found", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    return found.select(
        "doc_id", *(count(k) for k in base), sha256_hex(said(F.filter("found", lambda s: s["kind"].isin(*base)))).alias("base_sha256"),
        said(F.col("found")).alias("spans"), F.array_join(F.transform("found", lambda s: s["score"].cast("string")), ",").alias("scores"),
    )
