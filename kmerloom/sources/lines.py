"""Lines of text files with stable numbers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def numbered(spark: SparkSession, path: str) -> DataFrame:
    """(number, value): the lines of text files, numbered from 0 on in order of path and place, however Spark splits them.

    The lines of each split are counted first, one row a split; prefix sums over a file's splits, and over files, give the
    number of a split's first line. A line's place in its split is that in its task less that of the split's first line.
    """
    rows = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_start"), F.monotonically_increasing_id().alias("_at"))
    splits = rows.groupBy("_file", "_start").agg(F.count("*").alias("_n"), F.min("_at").alias("_first"))
    inside = W.partitionBy("_file").orderBy("_start").rowsBetween(W.unboundedPreceding, -1)
    files = splits.groupBy("_file").agg(F.sum("_n").alias("_all"))
    # a row a file
    before = files.select(F.col("_file").alias("_f"), F.coalesce(F.sum("_all").over(W.orderBy("_file").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_lines"))
    base = splits.withColumn("_before", F.coalesce(F.sum("_n").over(inside), F.lit(0))).join(before, F.col("_file") == F.col("_f")).select(F.col("_file").alias("_f"), F.col("_start").alias("_s"), (F.col("_lines") + F.col("_before") - F.col("_first")).alias("_base"))
    met = rows.join(F.broadcast(base), (F.col("_file") == F.col("_f")) & (F.col("_start") == F.col("_s")))  # a row a split
    return met.select((F.col("_base") + F.col("_at")).alias("number"), "value")
