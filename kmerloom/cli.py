"""Command line: python -m kmerloom.cli COMMAND ... Each command is one Spark job over an index folder."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kmerloom.operators import filters, minhash, query, tree
from kmerloom.plans.index import Index
from kmerloom.plans.shared import shared_folder, stored
from kmerloom.plans.spec import HashSpec
from kmerloom.sources import formats, query_files
from kmerloom.sources.bam import read_bam


def _reads(spark: SparkSession, path: str, kind: str) -> DataFrame:
    return {"bam": read_bam, "fasta": formats.read_fasta, "fastq": formats.read_fastq, "parquet": lambda s, p: s.read.parquet(p)}[kind](spark, path)


def _sketches(i: Index, slots: int, shifts: str | None = None) -> DataFrame:
    return minhash.sketches(i.bits, slots, "xorshift", shifts=query_files.read_shifts(i.spark, shifts) if shifts else minhash.SHIFTS)


def _results(found: DataFrame, queries: DataFrame, i: Index, out: str) -> None:
    lines = formats.result_lines(found, queries, i.tree)
    lines.orderBy("query_id", "line").select("value").write.mode("overwrite").text(out)


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="kmerloom", description=__doc__)
    sub = p.add_subparsers(dest="command", required=True)

    def add(name: str, text: str, *args: str, **flags):
        c = sub.add_parser(name, help=text)
        for a in args:
            c.add_argument(a)
        for f, (kind, default) in flags.items():
            c.add_argument(f"--{f.replace('_', '-')}", type=kind, default=default)
        return c

    add("hashes", "write a hash specification; family: universal or xxhash64, by default the one that k allows", "out", k=(int, 20), hashes=(int, 1), bits=(int, 1 << 31), family=(str, ""), parts=(int, 256))
    add("count", "reads to filters", "spec", "reads", "index", cutoff=(int, 3), format=(str, "fasta"))
    add("build", "topology of an index", "index", topology=(str, "balanced"), sim_type=(int, 1), order=(str, None))
    add("compress", "write node bits", "index")
    for name in ("query", "batch_query"):
        c = add(name, "threshold query of a file of sequences", "index", "queries", "out", theta=(float, 0.9), plan=(str, "flat"))
        c.add_argument("--leaf-only", dest="plan", action="store_const", const="flat")
    add("bool_query", "boolean query: parquet of atoms (query_id, atom_ix, seq, theta) and an expression over a0, a1, ...", "index", "atoms", "expression", "out")
    add("bool_query_file", "boolean queries of a file, [SEQ,theta] with ! & ^ | and ; at the end", "index", "queries", "out", theta=(float, 0.5))
    add("weighted_query", "weighted threshold query: a line of weights for each line of the queries; counts exact k-mers of the reads", "spec", "reads", "queries", "weights", "out", theta=(float, 0.9), cutoff=(int, 3), format=(str, "fasta"))
    add("segment_query", "queries of segments, [SEQ,theta][SEQ,theta]-[SEQ]; counts exact k-mers of the reads", "spec", "reads", "queries", "out", theta=(float, 0.9), cutoff=(int, 3), format=(str, "fasta"))
    add("check", "are the nodes what their filters say?", "index")
    add("draw", "Graphviz text of the topology", "index")
    add("sim", "similarity of two experiments (kinds 0 and 1), or with --nodes of two nodes of the topology (0, 1, 2, 3, -1)", "index", "a", "b", sim_type=(int, 1)).add_argument("--nodes", action="store_true")
    add("minhash", "write sketches; shifts: a file of triples, one a slot", "index", "out", slots=(int, 100), shifts=(str, None))
    c = add("cluster", "merge lines of a clustering: of one pair after another on the driver, or (nearest) of many pairs a round", "index", "out", slots=(int, 100))
    c.add_argument("--rounds", choices=("one", "nearest"), default="nearest")
    add("similar", "pairs of experiments whose sketches agree in a share of their slots, found by bands", "index", "out", slots=(int, 100), least=(float, 0.5))
    add("build_from_merges", "topology of merge lines", "index", "merges")
    add("merges", "merge lines of the topology", "index", "out")
    add("first_bits", "first set positions of every filter", "index", n=(int, 100))
    add("sizes", "lengths and set bits of every node", "index")
    add("popcount", "set bits of every filter", "index")
    return p


def run(spark: SparkSession, argv: list[str]) -> str | None:
    """One command; the text to print, if any. Errors are exceptions; argparse exits on wrong usage."""
    a = parser().parse_args(argv)
    if a.command == "hashes":
        HashSpec(k=a.k, nh=a.hashes, m=a.bits, family=a.family, parts=a.parts).save(spark, a.out)
        return None
    if a.command == "count":
        Index.create(_reads(spark, a.reads, a.format), HashSpec.load(spark, a.spec), a.index, a.cutoff)
        return None
    if a.command in ("weighted_query", "segment_query"):
        spec = HashSpec.load(spark, a.spec)
        known = filters.solid_kmers(_reads(spark, a.reads, a.format), spec.k, a.cutoff).select("exp_id", "kmer")
        if a.command == "weighted_query":
            found = query.weighted_query(formats.read_queries(spark, a.queries, spec.k, a.theta), known, query_files.read_weights(spark, a.weights), spec)
        else:
            found = query.segment_query(query_files.read_segments(spark, a.queries, spec.k, a.theta), known, spec)
        found.write.mode("overwrite").parquet(a.out)
        return None
    i = Index.open(spark, a.index)
    show = lambda df: "\n".join("\t".join(map(str, r)) for r in df.collect())  # noqa: E731  a row an experiment or node
    if a.command == "build":
        i.build(tree.greedy(i.bits, i.spec.m, a.sim_type, query_files.read_filter_list(spark, a.order) if a.order else None) if a.topology == "greedy" else tree.balanced(tree.experiments(i.bits)))
    elif a.command == "compress":
        i.compress()
    elif a.command in ("query", "batch_query"):
        q = formats.read_queries(spark, a.queries, i.spec.k, a.theta)
        if a.plan == "tree":
            shared_folder(spark)
            found = query.tree_query(q, i.tree, i.words, i.spec)
        else:
            every = i.bits.select("exp_id").distinct() if a.theta <= 0 else None
            found = query.threshold_query(q, i.bits, i.spec, experiments=every)
        _results(found, q, i, a.out)
    elif a.command == "bool_query":
        names = i.tree.where("is_leaf").select("exp_id")
        if not query.too_short(spark.read.parquet(a.atoms), i.spec.k).isEmpty():
            raise ValueError(f"an atom is shorter than {i.spec.k}")
        query.bool_query(spark.read.parquet(a.atoms), {"match": a.expression}, names, i.bits, i.spec, exact=False).write.mode("overwrite").parquet(a.out)
    elif a.command == "bool_query_file":
        names = i.tree.where("is_leaf").select("exp_id")
        query_files.bool_file_query(spark, a.queries, names, i.bits, i.spec, theta=a.theta).write.mode("overwrite").parquet(a.out)
    elif a.command == "check":
        return show(tree.check(i.tree, i.words, i.bits).where(~F.col("ok"))) or "every node is the union of its filters"
    elif a.command == "draw":
        return tree.to_dot(i.tree)
    elif a.command == "sim" and a.nodes:
        pair = spark.createDataFrame([(a.a, a.b)], "a string, b string")
        return show(filters.split_similarity(filters.split_pair_counts(pair, i.words), i.spec.m, a.sim_type).select("sim"))
    elif a.command == "similar":
        minhash.banded_pairs(stored(_sketches(i, a.slots)), a.slots, a.least).write.mode("overwrite").parquet(a.out)
    elif a.command == "cluster" and a.rounds == "nearest":
        formats.write_merges(minhash.nearest_merges(_sketches(i, a.slots), i.bits.select("exp_id").distinct(), a.slots), a.out)
    elif a.command == "sim":
        two = i.bits.where(F.col("exp_id").isin(a.a, a.b))
        return show(filters.similarity(two, i.spec.m, a.sim_type).select("sim"))
    elif a.command == "minhash":
        formats.write_sketch(_sketches(i, a.slots, a.shifts), a.out)
    elif a.command == "cluster":
        plan = minhash.cluster_plan(_sketches(i, a.slots), tree.experiments(i.bits), a.slots)
        rows = [(n, *m) for n, m in enumerate(plan)]
        formats.write_merges(spark.createDataFrame(rows, "step int, new_node string, c0 string, c1 string"), a.out)
    elif a.command == "build_from_merges":
        i.build(tree.from_merges(formats.read_merges(spark, a.merges)))
    elif a.command == "merges":
        formats.write_merges(tree.merges_of(i.tree), a.out)
    elif a.command == "first_bits":
        return show(filters.first_bits(i.bits, a.n).orderBy("exp_id", "rank"))
    elif a.command == "sizes":
        return show(tree.node_sizes(i.tree, i.words, i.spec.m).orderBy("node_id"))
    elif a.command == "popcount":
        return show(i.bits.groupBy("exp_id").count().orderBy("exp_id"))
    return None


def main() -> None:
    out = run(SparkSession.builder.appName("kmerloom").getOrCreate(), sys.argv[1:])
    if out:
        print(out)


if __name__ == "__main__":
    main()
