"""Streaming ingest: reads that arrive as a stream become k-mer counts, a folder a batch; filters follow from their sums."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from kmerloom.operators.filters import kmer_counts
from kmerloom.plans.spec import HashSpec


def ingest(reads: DataFrame, spec: HashSpec, path: str, checkpoint: str) -> StreamingQuery:
    """Write each micro-batch's k-mer counts of reads (exp_id, seq) below path, one folder a batch.

    A batch that is run again overwrites its own folder, so every read counts once. No state is kept in memory.
    """

    def batch(df: DataFrame, number: int) -> None:
        kmer_counts(df, spec.k).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return reads.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def total_counts(counts: DataFrame) -> DataFrame:
    """(exp_id, kmer, n) over all batches written so far."""
    return counts.groupBy("exp_id", "kmer").agg(F.sum("n").alias("n"))
