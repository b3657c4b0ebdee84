"""Helpers that the training-data operators share: tables, shared storage and byte-level words."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# ASCII A-Z to a-z; the other tables also turn separators into blanks. Bytes of multi-byte UTF-8
# characters are never below 0x80, so byte-wise work on them is exact.
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
BLANKS = b" \t\n\x0b\x0c\r"
#: For split(): words are runs without blanks, A-Z lower-cased.
LOWER_BLANK = bytes(32 if bytes([b]) in BLANKS else _LOWER[b] for b in range(256))
#: For split(): words are runs of letters, digits and non-ASCII characters, A-Z lower-cased.
LOWER_ALNUM = bytes(_LOWER[b] if b >= 128 or chr(b).isalnum() else 32 for b in range(256))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where it is unset, a fresh local folder in local mode, an error on a cluster."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        master = spark.conf.get("spark.master", "")
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share: intermediate tables are written there")
        path = tempfile.mkdtemp(prefix="spark-shared-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


#: The tables saved in each phase that is open, the innermost last.
_phases: list[list[str]] = []


@contextmanager
def phase(spark: SparkSession) -> Iterator[None]:
    """What is saved within is deleted at its end, whether it ends well or not, but for what ``save`` is told stays: steps after it then have the storage."""
    _phases.append([])
    try:
        yield
    finally:
        for path in map(spark._jvm.org.apache.hadoop.fs.Path, _phases.pop()):
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def save(df: DataFrame, name: str, stays: bool = False) -> DataFrame:
    """Write df as a table in the shared folder and read it again: lineage ends there, so a lost executor costs no recomputation. Tables are packed with zstd, as they share the storage with shuffles."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tables/{name}-{uuid.uuid4().hex}"
    schema = df.schema
    if _phases and not stays:
        _phases[-1].append(path)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(schema).parquet(path)


def drop_tables(spark: SparkSession) -> bool:
    """Deletes all intermediate tables below the shared folder: for the end of a job, when no table of this library is read any more."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark)}/tables")
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def kept_columns(keep: Iterable[str], made: Iterable[str]) -> list[str]:
    """The columns to hand through, without doc_id, which comes anyway; an error for one that is named like a column that the operator makes."""
    clash = sorted({c.lower() for c in keep} & {c.lower() for c in made} - {"doc_id"})
    if clash:
        raise ValueError(f"columns to keep are named like columns that are made: {', '.join(clash)}")
    return [c for c in keep if c.lower() != "doc_id"]


def sha256_hex(column):
    return F.lower(F.sha2(column, 256))


def partitions_of(df: DataFrame) -> int:
    """How many partitions a shuffle gets in this session."""
    return max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
