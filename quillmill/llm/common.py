"""Helpers that several training-data operators share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The six ASCII white-space characters: space and tab to carriage return.
ASCII_SPACE = " \t\n\x0b\x0c\r"

LONG_MIN = -(2**63)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """A folder that the driver and all executors see: spark.checkpoint.dir. Where that is unset a local run
    gets a temporary folder, which becomes its checkpoint folder; on a cluster it is an error."""
    sc = spark.sparkContext
    base = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not base:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir has to name a folder that the driver and all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="quillmill-")
        sc.setCheckpointDir(base)
    elif not sc.getCheckpointDir():
        sc.setCheckpointDir(base)
    return base.rstrip("/")


def new_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/quillmill/{label}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, label: str, path: str | None = None) -> DataFrame:
    """Write df as Parquet in the shared folder and read it again: cuts the lineage, and a lost
    executor costs no recomputation of what stands before."""
    path = path or new_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def remove(spark: SparkSession, path: str) -> None:
    """Remove a table of new_path() that nothing reads any more."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Column names that do not clash with those of df."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name = "_" + name
        taken.add(name.lower())
        out.append(name)
    return out


def partitions(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def order_id(text: str, row_id: str) -> Column:
    """The id as a long; for a null id a number below all real ids (those above -2^62), taken from a hash of the
    text, so rows without an id come first and do not gather under one key."""
    return F.coalesce(F.col(row_id).cast("long"), F.lit(LONG_MIN) + F.xxhash64(F.coalesce(F.col(text), F.lit(""))).bitwiseAND(F.lit((1 << 61) - 1)))


def salted_join(rows: DataFrame, unique: DataFrame, keys: list[str], by: str, salts: int = 8) -> DataFrame:
    """rows joined with a table in which each key stands once. The rows of one key, which may be a third of all,
    are dealt to ``salts`` tasks by a hash of their column ``by``."""
    dealt = rows.withColumn("salt_", F.pmod(F.xxhash64(by), F.lit(salts)).cast("int"))
    copies = unique.withColumn("salt_", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return dealt.join(copies, [*keys, "salt_"]).drop("salt_")


def strip_ascii_space(text: Column) -> Column:
    """The text without any of the six ASCII white-space characters; null counts as empty."""
    return F.translate(F.coalesce(text, F.lit("")), ASCII_SPACE, "")


def rows_at_most(df: DataFrame, bound: int) -> bool:
    """Whether df has at most ``bound`` rows; reads no more than bound + 1 of them."""
    return df.limit(bound + 1).count() <= bound
