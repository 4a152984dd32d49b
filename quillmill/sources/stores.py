"""Indexes that are built once for a table's files and read from then on."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; a local run without it gets a temporary folder, on a cluster that is an error."""
    sc = spark.sparkContext
    base = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not base:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir has to name a folder that the driver and all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="quillmill-")
        sc.setCheckpointDir(base)
    return base.rstrip("/")


def version(source: DataFrame) -> str:
    """A name for the state of a table's files: their paths, sizes and times of change."""
    file = F.struct("_metadata.file_path", "_metadata.file_size", "_metadata.file_modification_time")
    each = source.select(file.alias("f")).groupBy("f").agg(F.count(F.lit(1)).alias("n"))
    digest = F.conv(F.substring(F.sha2(F.to_json(F.struct("f", "n")), 256), 1, 12), 16, 10).cast("decimal(38,0)")
    found = each.agg(F.count(F.lit(1)).alias("files"), F.sum(digest).alias("sum")).first()
    return f"{found.files}-{int(found['sum'] or 0):x}"


def stored(source: DataFrame, label: str, last: str, write: Callable[[str], None]) -> str:
    """The folder of the index ``label`` of source, a table read from files. It is written if the table's files have
    changed or no finished one stands; ``last`` is the part that write() finishes last."""
    spark = source.sparkSession
    path = f"{shared_dir(spark)}/quillmill-stores/{label}-{version(source)}"
    done = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{last}/_SUCCESS")
    if not done.getFileSystem(spark._jsc.hadoopConfiguration()).exists(done):
        write(path)
    return path


def settled(df: DataFrame, label: str) -> DataFrame:
    """df written in the shared folder and read again, for tables that a plan uses several times: they are worked out
    once, and a lost executor costs no more than what follows."""
    path = f"{shared_dir(df.sparkSession)}/quillmill-stores/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
