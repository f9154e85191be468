"""A sink that knows content by its signature, not by its batch: what came before writes nothing.

The signature of a source's rows does not depend on their order. Rows are
written below their source and signature, so a run that was cut off between
the rows and the ledger writes the same files again.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

LEDGER = "source string, signature string, n long"


def signatures(rows: DataFrame, source: str) -> DataFrame:
    """``source``, ``signature`` and ``n`` of the rows of each source, summed within tasks first: a hot source is no hot task."""
    columns = sorted(rows.columns)
    one, other = F.xxhash64(*columns), F.xxhash64(F.lit("other"), *columns)
    sums = [F.count("*").alias("n"), F.sum(one.cast("decimal(20,0)")).alias("a"), F.bit_xor(other).alias("b")]
    found = rows.groupBy(F.coalesce(F.col(source).cast("string"), F.lit("")).alias("source")).agg(*sums)
    return found.select("source", F.sha2(F.concat_ws(":", "n", "a", "b", F.lit(",".join(columns))), 256).alias("signature"), "n")


def sink(spark: SparkSession, root: str, source: str) -> Callable[[DataFrame, int], None]:
    """A function for ``foreachBatch``: rows go to ``root/rows`` and their signatures to ``root/ledger``, each content once."""

    def write(batch: DataFrame, number: int) -> None:
        held = batch.persist()
        try:
            fresh = signatures(held, source).join(ledger(spark, root), ["source", "signature"], "left_anti").persist()
            if not fresh.isEmpty():
                keyed = held.withColumn("_source", F.coalesce(F.col(source).cast("string"), F.lit("")))
                new = keyed.join(fresh.select(F.col("source").alias("_source"), F.col("signature").alias("_signature")), "_source")
                writer = new.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
                writer.partitionBy("_source", "_signature").parquet(f"{root}/rows")
                fresh.select("source", "signature", "n").write.mode("append").parquet(f"{root}/ledger")
            fresh.unpersist()
        finally:
            held.unpersist()

    spark.createDataFrame([], LEDGER).write.mode("append").parquet(f"{root}/ledger")
    return write


def ledger(spark: SparkSession, root: str) -> DataFrame:
    return spark.read.schema(LEDGER).parquet(f"{root}/ledger")


def written(spark: SparkSession, root: str) -> DataFrame:
    return spark.read.parquet(f"{root}/rows").drop("_source", "_signature")
