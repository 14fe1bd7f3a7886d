"""What the corpus operators share: table reading, words, shared scratch tables."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a run of anything but the six ASCII white-space characters. bytes.split() cuts at exactly these.
WORD = r"[^\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
ASCII_LOWER = str.maketrans(UPPER, LOWER)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir, or a temporary one where none is set (tests on one machine)."""
    sc = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if not found:
        if not sc.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir names no folder that the executors share")
        if sc._jsc.sc().getCheckpointDir().isEmpty():
            sc.setCheckpointDir(tempfile.mkdtemp(prefix="spark-"))
        found = sc._jsc.sc().getCheckpointDir().get()
    elif sc._jsc.sc().getCheckpointDir().isEmpty():
        sc.setCheckpointDir(found)
    return found


def stored(df: DataFrame, scratch: list[str] | None = None) -> DataFrame:
    """df written as Parquet to the shared folder and read again: cuts the lineage, survives lost executors. The path is added to ``scratch``, for ``forget``."""
    path = f"{shared_dir(df.sparkSession)}/t-{uuid.uuid4().hex}"
    if scratch is not None:
        scratch.append(path)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def forget(spark: SparkSession, scratch: list[str]) -> None:
    """Deletes stored tables that nothing will read again."""
    for path in scratch:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
    scratch.clear()


def row_keys(*cols: str) -> list[Column]:
    """Two columns r0 and r1 of 64 bits each that stand for a row's content; equal rows share them, nulls are fine."""
    own = [x for c in cols for x in (F.isnull(F.col(f"`{c}`")), F.col(f"`{c}`").cast("string"))]
    return [F.xxhash64(F.lit(k), *own).alias(f"r{k}") for k in (0, 1)]


def free(name: str, taken: list[str]) -> str:
    """``name``, or a longer one that isn't taken; Spark's names have no case."""
    used = {c.lower() for c in taken}
    while name.lower() in used:
        name += "_"
    return name


def bounded(df: DataFrame, most: int) -> DataFrame:
    """df, to be broadcast in a join if it has at most ``most`` rows; else the join is Spark's choice. df is counted, so it should be stored or small."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df
