"""Prefix-target chat examples, by DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from frameflow.llm.common import sha256_hex, table

TURN_END = "</turn>\n"
#: The text of both turns of the contract's own conversation, which holds control strings.
PLANTED = "\\### Assistant: </turn> ok"


def escape(text: Column) -> Column:
    r"""Texts without the template's control characters: ``\`` becomes ``\s``, then ``<`` ``\l`` and ``>`` ``\g``."""
    s = F.replace(text, F.lit("\\"), F.lit("\\s"))
    return F.replace(F.replace(s, F.lit("<"), F.lit("\\l")), F.lit(">"), F.lit("\\g"))


def unescape(text: Column) -> Column:
    s = F.replace(F.replace(text, F.lit("\\g"), F.lit(">")), F.lit("\\l"), F.lit("<"))
    return F.replace(s, F.lit("\\s"), F.lit("\\"))


def format_conversations(turns: DataFrame) -> DataFrame:
    r"""One row per conversation: conv_id, ``formatted`` and its prefix-target ``examples``.

    A turn is written ``<turn role>text</turn>\n``, role and text escaped. Every assistant turn is an
    example (no, context_end, target_start, target_end): the first context_end code points of ``formatted``
    are its context (all preceding turns and the opening mark of the reply) and only
    [target_start, target_end) is trainable. Here contexts are told as prefixes of one text, so a table of conversations is as
    large as the input; ``expand_examples`` writes a row for each with its context, and the query goes through those rows.

    Rows are ordered by turn, then role and text, so ties and repeated rows have one order; null
    turns come first. A null role or text is empty, a null conv_id is a conversation of its own.
    Conversations without assistant have no examples. Other columns are ignored. A conversation is
    assembled in one row, as its text is one string.
    """
    text, role = F.coalesce("text", F.lit("")), F.coalesce("role", F.lit(""))
    piece = turns.select(
        "conv_id", "turn", role.alias("role"), escape(text).alias("target"),
        F.concat(F.lit("<turn "), escape(role), F.lit(">")).alias("opening"),
    ).select("*", (F.length("opening") + F.length("target") + len(TURN_END)).cast("long").alias("size"))
    order = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "role", "target")
    placed = piece.select(
        "conv_id", "role", "target", "opening", F.row_number().over(order).alias("no"),
        (F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("size") + F.length("opening")).alias("start"),
    )
    example = F.when(
        F.col("role") == "assistant",
        F.struct("no", F.col("start").alias("context_end"), F.col("start").alias("target_start"), (F.col("start") + F.length("target")).alias("target_end")),
    )
    whole = F.array_sort(F.collect_list(F.struct("no", F.concat("opening", "target", F.lit(TURN_END)).alias("piece"))))
    grouped = placed.groupBy("conv_id").agg(whole.alias("pieces"), F.array_sort(F.collect_list(example)).alias("examples"))
    return grouped.select("conv_id", F.array_join("pieces.piece", "").alias("formatted"), "examples")


def trainable(formatted: Column, example: Column) -> Column:
    """The text under the loss mask of an example, escaped as it stands in ``formatted``."""
    return F.substr(formatted, (example["target_start"] + 1).cast("int"), (example["target_end"] - example["target_start"]).cast("int"))


def expand_examples(formatted: DataFrame, keep: tuple[str, ...] = (), every: bool = False) -> DataFrame:
    """One row per assistant turn with its whole context written out: conv_id, example, context, target, and the span of the loss in context and target together.

    keep: columns of ``formatted`` to hand through. With ``every``, a conversation without assistant is a row without example.
    """
    explode = F.posexplode_outer if every else F.posexplode
    one = formatted.select("conv_id", *keep, "formatted", explode("examples").alias("example", "e"))
    return one.select(
        "conv_id", *keep, "example", F.substring("formatted", F.lit(1), F.col("e.context_end").cast("int")).alias("context"), trainable(F.col("formatted"), F.col("e")).alias("target"),
        F.col("e.target_start").alias("loss_start"), F.col("e.target_end").alias("loss_end"),
    )


def read_back(formatted: DataFrame) -> DataFrame:
    """The contract's digests, from the output alone: turns out of the formatted text by the template's marks, the loss out of the written examples by their masks.

    Every assistant turn is a row with its context and its target (``expand_examples``); the mask is laid on the two together, so a context that is wrong shows in the loss.
    The rows stay where their conversation is, one at a time holds its context, and only the losses are put together again in order.
    """
    pieces = F.filter(F.split("formatted", TURN_END), lambda p: p != "")

    def turn(p):
        head = F.substring_index(p, ">", 1)
        text = F.substr(p, F.length(head) + 2)
        return F.concat(unescape(F.substr(head, F.lit(7))), F.lit("\n"), unescape(text), F.lit("\n"))

    told = ("n_turns", "turns_sha256", "formatted_chars")
    whole = formatted.select(
        "conv_id", F.size(pieces).cast("long").alias("n_turns"), sha256_hex(F.array_join(F.transform(pieces, turn), "")).alias("turns_sha256"), F.length("formatted").cast("long").alias("formatted_chars"), "formatted", "examples",
    )
    examples = expand_examples(whole, told, every=True)
    masked = F.substr(F.concat("context", "target"), (F.col("loss_start") + 1).cast("int"), (F.col("loss_end") - F.col("loss_start")).cast("int"))
    losses = examples.select("conv_id", *told, "example", unescape(masked).alias("loss"))
    back = losses.groupBy("conv_id", *told).agg(F.count("example").alias("n_examples"), F.array_join(F.array_sort(F.collect_list(F.when(F.col("example").isNotNull(), F.struct("example", "loss"))))["loss"], "").alias("loss"))
    return back.select("conv_id", "n_turns", "turns_sha256", F.length("loss").cast("long").alias("loss_chars"), sha256_hex(F.col("loss")).alias("loss_sha256"), "formatted_chars", "n_examples")


def op1_chat_prefix_target(spark: SparkSession, sf_dir: str) -> DataFrame:
    planted = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(PLANTED).alias("text"))
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(planted)
    return read_back(format_conversations(turns))


OP1_SQL = r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'
), s AS (
  SELECT *, length(text) + len(regexp_extract_all(text, '[\\<>]')) + length(role) + 15 AS size FROM t
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(size) AS BIGINT) AS formatted_chars,
  count(*) FILTER (role = 'assistant') AS n_examples
FROM s GROUP BY conv_id
"""
