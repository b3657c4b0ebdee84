"""A training corpus from the documents table, stage by stage; each stage's rows are written and read again as the next one's documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from frameflow.llm.common import phase, save, table
from frameflow.llm.decontaminate import benchmark_hits
from frameflow.llm.lines import dedup_lines
from frameflow.llm.mixing import in_training_order, mix
from frameflow.llm.partenum import jaccard_components
from frameflow.llm.toxicity import toxicity_scores, train

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: Near copies share this much of their sets of five-word shingles; op10's own contract (85/100, four words) binds that query alone.
NEAR = {"num": 4, "den": 5, "size": 5}


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is below 0.5. The classifier learns from the labelled ones among all documents.

    Null and empty texts have the score of no words. Rows that repeat a doc_id, or have none, are judged each, so equal rows stay or go together. Without labels the score
    is the same for all, 0.5, and none stays; without documents there are no rows. Columns beyond those of documents are left out.
    """
    model = train(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return toxicity_scores(docs.select(*COLUMNS), model, keep=COLUMNS).where("score < 0.5").select(*COLUMNS)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the lines that a document with a smaller doc_id holds too; n_chars is counted again.

    Null texts become empty. Rows that repeat a doc_id are one document and take no lines from each other; rows without doc_id lose none and take none. No
    documents, no rows. Columns beyond those of documents are left out.
    """
    kept = dedup_lines(docs.select(*COLUMNS), keep=["lang", "source"])
    return kept.select("doc_id", F.col("kept").alias("text"), "lang", "source", F.length("kept").cast("long").alias("n_chars"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked documents the one with the smallest doc_id. Links are at an exact Jaccard of 0.8 or more over five-word shingles.

    Documents without words (null, empty, blank) are linked with nothing and stay, as do rows without doc_id. Rows that repeat a doc_id are one document and stay or go
    together. No documents, no rows. Columns beyond those of documents are left out.
    """
    with phase(spark):  # of the tables on the way only the ids of copies stay
        found = save(jaccard_components(docs.select("doc_id", "text"), **NEAR).where("doc_id <> component_id").select("doc_id").distinct(), "copies", stays=True)
    return docs.select(*COLUMNS).join(found, "doc_id", "left_anti")


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no window of a benchmark item.

    Null and empty texts hold none. Rows that repeat a doc_id, or have none, are judged each. An empty benchmark removes nothing; no documents, no
    rows. Columns beyond those of documents are left out.
    """
    return benchmark_hits(docs.select(*COLUMNS), table(spark, sf_dir, "benchmark"), keep=COLUMNS).where(F.size("hit") == 0).select(*COLUMNS)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What the mix takes of each document, and when: doc_id, source, size, source_size, target, taken and the positions in training.

    Null and empty texts have size 0 and nothing is taken of them; a null source is a source of its own, the last. Rows that repeat a doc_id are documents each; ties are in
    the order of doc_id. No documents, no rows. Columns beyond those of documents are left out.
    """
    return in_training_order(save(mix(docs), "mixed"))


STAGES = [
    ("toxicity", toxicity), ("line_dedup", line_dedup), ("near_duplicates", near_duplicates), ("decontamination", decontamination), ("mixing", mixing),
]
#: The classifier's scores can't be written in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = save(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
