"""Numbers and running sums over a whole table's order, without a task that holds the table."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir; on one machine a temporary one will do."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir names no folder that the executors share")
        found = tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found


def stored(df: DataFrame, scratch: list[str] | None = None) -> DataFrame:
    """df as a table in the shared folder, read again. The path is added to ``scratch``, for ``forget``."""
    path = f"{shared_dir(df.sparkSession)}/o-{uuid.uuid4().hex}"
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


def numbered(df: DataFrame, order: list[Column], number: str, total: Column | None = None, running: str | None = None) -> DataFrame:
    """df with ``number``, each row's place in the order from 1 on, and ``running``, the sum of ``total`` up to the row.

    Rows are dealt to ranges of the order, which are stored, so that all that follows sees the same ones. Each range is numbered
    by itself; the ranges' counts and sums, one row each, give what comes before. Equal rows are numbered in any order, so the
    order should end with a key. df is stored first, as the ranges' bounds come from a pass of their own over it; so it should hold
    what is needed and no more.
    """
    scratch: list[str] = []
    ranges = stored(stored(df, scratch).repartitionByRange(*order).withColumn("__p", F.spark_partition_id()))
    forget(df.sparkSession, scratch)
    value = F.lit(0) if total is None else total
    before, n, s = [], 0, 0
    for r in sorted(ranges.groupBy("__p").agg(F.count("*").alias("n"), F.sum(value).alias("s")).collect(), key=lambda r: r["__p"]):
        before.append((r["__p"], n, float(s)))
        n, s = n + r["n"], s + (r["s"] or 0)
    offsets = df.sparkSession.createDataFrame(before, "__p int, __before long, __sum double")
    w = Window.partitionBy("__p").orderBy(*order)
    out = ranges.withColumn(number, F.row_number().over(w))
    if running:
        out = out.withColumn(running, F.sum(value).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    out = out.join(F.broadcast(offsets), "__p").withColumn(number, F.col(number) + F.col("__before"))
    if running:
        out = out.withColumn(running, F.col(running) + F.col("__sum"))
    return out.drop("__p", "__before", "__sum")
