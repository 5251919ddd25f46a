"""An index in a folder: hash specification, filters, topology and node words, all as Spark tables."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kmerloom.operators import filters, tree
from kmerloom.plans.shared import removed
from kmerloom.plans.spec import HashSpec


@dataclass
class Index:
    """Filters are stored packed, 64 positions a row, in folders by range of positions (part), and are sorted there: a query
    that is small enough to broadcast reads only the parts that it has positions in, by dynamic partition pruning, and in
    these only the row groups that their statistics leave. A word lies in the part of its first position."""

    spark: SparkSession
    path: str
    spec: HashSpec

    @classmethod
    def create(cls, reads: DataFrame, spec: HashSpec, path: str, cutoff: int = 3) -> Index:
        """Count reads (exp_id, seq), keep k-mers that occur cutoff times, and write their filters."""
        return cls.of(filters.filter_words(reads, spec, cutoff), spec, path, dealt=True)

    @classmethod
    def of(cls, bits: DataFrame, spec: HashSpec, path: str, dealt: bool = False) -> Index:
        """Write filters, sparse or packed. Rows are dealt by position, so no part, however full, is one task's. dealt: packed
        filters as filter_words() deals them, by blocks of positions, are written by the tasks that make them."""
        spark = bits.sparkSession
        spec.save(spark, f"{path}/spec")
        parted = filters.packed(bits).withColumn("part", filters.part_of(filters.first_of(F.col("word_idx")), spec))
        rows = parted if dealt else parted.repartitionByRange("part", "word_idx")
        rows.sortWithinPartitions("part", "word_idx", "exp_id").write.mode("overwrite").partitionBy("part").parquet(f"{path}/bits")
        return cls(spark, path, spec)

    @classmethod
    def open(cls, spark: SparkSession, path: str) -> Index:
        return cls(spark, path, HashSpec.load(spark, f"{path}/spec"))

    @property
    def packs(self) -> DataFrame:
        """(exp_id, word_idx, word, part): the filters as they are stored."""
        return self.spark.read.schema("exp_id string, word_idx int, word long, part int").parquet(f"{self.path}/bits")

    @property
    def bits(self) -> DataFrame:
        """(exp_id, pos, part), a row a position; part is that of its word."""
        return filters.unpacked(self.packs, "part")

    @property
    def tree(self) -> DataFrame:
        return self.spark.read.schema(tree.SCHEMA).parquet(f"{self.path}/tree")

    @property
    def words(self) -> DataFrame:
        """(node_id, word_idx, sim, dif): node bits, 64 positions a row."""
        return self.spark.read.schema("node_id string, word_idx int, sim long, dif long").parquet(f"{self.path}/nodes")

    @property
    def nodes(self) -> DataFrame:
        return tree.bits_of_words(self.words)

    def build(self, root: tree.Node | None) -> Index:
        """Write a topology; its node bits follow with compress()."""
        tree.tree_table(self.spark, root).write.mode("overwrite").parquet(f"{self.path}/tree")
        return self

    def compress(self) -> Index:
        """Write the informative bits of every node, and hold them against the filters while they are written."""
        return self.write_nodes(tree.node_words(self.tree, self.packs))

    def write_nodes(self, words: DataFrame) -> Index:
        """Write node words. A row that no node can have stops the write; the sums that only the whole table shows are
        observed in the same pass, and where they do not fit the filters, the table is deleted and an error is raised."""
        good, seen = tree.observed(words, self.tree, self.spec.m)
        path = f"{self.path}/nodes"
        good.write.mode("overwrite").option("compression", "zstd").parquet(path)
        bits = self.packs.join(self.tree.where("is_leaf").select("exp_id"), "exp_id", "left_semi").agg(F.sum(F.bit_count("word"))).first()[0] or 0
        if (seen.get["filter_bits"] or 0) != bits:
            removed(self.spark, path)
            raise ValueError(f"nodes hold {seen.get['filter_bits']} set positions of filters, which have {bits}")
        return self
