"""The corpus pipeline: five stages over documents, each written as Parquet and read again before the next.

quality     documents scored under 0.7 by the pairwise ranking go
near_dups   one document of each near-duplicate component (similarity 0.8 of 5-word shingles) stays, that of the smallest
            id; repeated rows become one
secrets     spans that the blob ledger has findings for are replaced by their kind in brackets
mix         each document is repeated as often as the mix takes most of it: not at all, once or twice; every repeat is
            written where the schedule's slots put it
encode      every row left is encoded: doc_id, n_tokens and digests of its ids and of the decoded text

Null ids are kept as rows of their own, never linked; null and empty texts pass until the mix, which takes no document
without words. Very long texts are taken whole. Ties: of equal ids and texts one row stays; equal scores and sizes are
treated alike. Empty tables give empty results. Columns may have any names: those that stages add are made fresh.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kmerloom.llm import mixing, near_dup, piece_codec, quality_ranking, secrets
from kmerloom.llm.common import fresh, identified, n_partitions, removed, scratch, stored, table, words

#: Words of a shingle in the near_dups stage; the query op5_near_duplicates takes 2.
SHINGLE = 5


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the ranking, trained on the labels of three quarters of docs, scores at the cut or above."""
    model = quality_ranking.train(docs, table(spark, sf_dir, "labels"), quality_ranking.train_fold())
    out = fresh(docs, "quality")
    return quality_ranking.scored(docs, model, out=out).where(F.col(out) >= quality_ranking.CUT).drop(out)


def near_dups(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate component, and every document without an id."""
    kept, own = near_dup.near_duplicates(docs, words=SHINGLE).where("kept"), fresh(docs, "id")
    ids = kept.select(F.col("doc_id").alias(own)).distinct()
    stay = docs.join(ids.hint("shuffle_hash"), F.col("doc_id").eqNullSafe(F.col(own)), "left_semi")
    return stay.dropDuplicates(["doc_id", "text"])


def scan_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """docs with their secrets replaced; n_chars, where there is one, is counted again."""
    ledger = scratch(spark)
    secrets.scan_versions(secrets.addressed(docs.select("text")), ledger)
    clean = secrets.redacted(docs, spark.read.schema(secrets.FINDINGS).parquet(ledger))
    if "n_chars" not in docs.columns:
        return clean
    return clean.withColumn("n_chars", F.coalesce(F.length("text").cast(docs.schema["n_chars"].dataType), F.col("n_chars")))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """docs as the mix takes them, each repeat where the schedule's slots put it, in its source's stream.

    Rows meet what the mix says of them by their own identity, not by doc_id, so null and repeated ids take what they should.
    """
    own, met, often, slot, place = (fresh(docs, c) for c in ("own", "met", "often", "slot", "place"))
    rows = identified(docs, own)
    sizes = rows.select("doc_id", "source", F.col(own).alias("_own"), F.size(words(F.col("text"))).cast("long").alias("size"))
    repeats = F.array_compact(
        F.array(*(F.when(F.col(f"pass{p}") * 2 >= F.col("size"), F.struct(F.col(f"slot{p}").alias("slot"), (F.col("start") + p * F.col("source_size")).alias("place"))) for p in range(mixing.MAX_REPEAT)))
    )
    dealt = mixing.mix(sizes, keep=("_own",)).where("taken > 0").select(F.col("_own").alias(met), F.explode(repeats).alias(often))
    repeated = rows.join(dealt.hint("shuffle_hash"), F.col(own) == F.col(met)).withColumns({slot: F.col(f"{often}.slot"), place: F.col(f"{often}.place")})
    ordered = repeated.repartitionByRange(n_partitions(spark), slot, place).sortWithinPartitions(slot, place, "doc_id")
    return ordered.select(*(F.col(f"`{c}`") for c in docs.columns))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of every row."""
    return piece_codec.encoded(docs)


STAGES = [("quality", quality), ("near_dups", near_dups), ("secrets", scan_secrets), ("mix", mix), ("encode", encode)]

#: Fitted scores, signatures and segmentation are beyond SQL; tests hold the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows, in a folder of their own; what the others wrote is deleted when the next has read it."""
    docs, before = table(spark, sf_dir, "documents"), None
    for _, stage in STAGES:
        path = scratch(spark)
        docs = stored(stage(spark, docs, sf_dir), path)
        if before:
            removed(spark, before)
        before = path
    return docs
