"""Readers of query files, weights, filter lists and sketches, on files in their text grammars."""

import itertools

import pytest
from pyspark.sql import functions as F

from kmerloom.operators import filters, minhash, query, tree
from kmerloom.plans.spec import HashSpec
from kmerloom.sources import formats, query_files

SEQS = {"x": "ACGTTGCAAC", "y": "GGATCCATAG", "z": "TTTTACCGGA"}
SPEC = HashSpec(k=8, m=1 << 16)


def experiments_of(spark):
    """Experiments that hold every subset of the three sequences, named by it."""
    rows = [("".join(s) or "-", SEQS[c]) for n in range(4) for s in itertools.combinations("xyz", n) for c in (s or "x")]
    rows = [(e, s if e != "-" else "CCCCCCCCCC") for e, s in rows]
    return spark.createDataFrame(rows, "exp_id string, seq string")


def test_boolean_lines_bind_as_the_grammar_says(spark, tmp_path):
    x, y, z = (f"[{SEQS[c]},0.9]" for c in "xyz")
    lines = [f"{x} & {y};", f"{x} | {y} & {z};", f"{x} ^ {y} | {z};", f"{x} & {y} ^ {z} ;", f"!{x} & !({y}|{z});", f"[{SEQS['x']}];", "", "[A];"]
    (tmp_path / "q").write_text("\n".join(lines))
    reads = experiments_of(spark)
    names = reads.select("exp_id").distinct()
    got = query_files.bool_file_query(spark, str(tmp_path / "q"), names, filters.filter_bits(reads, SPEC, 1), SPEC).collect()
    plain = [lambda x, y, z: x and y, lambda x, y, z: x or (y and z), lambda x, y, z: (x != y) or z, lambda x, y, z: (x and y) != z, lambda x, y, z: not x and not (y or z), lambda x, y, z: x]
    want = {(i, r.exp_id) for i, f in enumerate(plain) for r in names.collect() if f(*(c in r.exp_id for c in "xyz"))}
    assert {(r.query_id, r.exp_id) for r in got} == want


@pytest.mark.parametrize("line", ["[ACGTTGCAAC] & [ACGTTGCAAC]", "[ACGTTGCAAC] + [ACGTTGCAAC];", "ACGTTGCAAC;", "[ACGTTGCAAC] & ![ACG];"])
def test_boolean_lines_in_error(spark, tmp_path, line):
    (tmp_path / "q").write_text(line)
    with pytest.raises(Exception, match="no boolean query|shorter than"):
        query_files.read_bool_queries(spark, str(tmp_path / "q"), 8)[0].collect()


def test_segments(spark, tmp_path):
    x, y, z = (SEQS[c] for c in "xyz")
    (tmp_path / "s").write_text(f"[{x},0.9][{y}]\n[{x}]+[{y},0.5]-[{z},0.9]\n")
    got = sorted(tuple(r) for r in query_files.read_segments(spark, str(tmp_path / "s"), 8, 0.75).withColumn("theta", F.round("theta", 2).cast("string")).select("query_id", "group_ix", "sign", "seg_ix", "seq", "theta").collect())
    assert got == [(0, 0, "+", 0, x + y[:7], "0.9"), (0, 0, "+", 1, y, "0.75"), (1, 0, "+", 0, x, "0.75"), (1, 1, "+", 0, y, "0.5"), (1, 2, "-", 0, z, "0.9")]
    (tmp_path / "short").write_text("[ACG,0.9]")
    with pytest.raises(ValueError):
        query_files.read_segments(spark, str(tmp_path / "short"), 8)
    index = query.query_kmers(experiments_of(spark).select(F.col("exp_id").alias("query_id"), "seq"), 8).select(F.col("query_id").alias("exp_id"), "kmer").distinct()
    found = query.segment_query(query_files.read_segments(spark, str(tmp_path / "s"), 8).where("query_id = 1"), index, SPEC)
    assert {r.exp_id for r in found.collect()} == {"xy"}


def test_weights_lists_and_sketches(spark, tmp_path):
    (tmp_path / "w").write_text("1 0.5  2\n3\n")
    assert sorted(tuple(r) for r in query_files.read_weights(spark, str(tmp_path / "w")).collect()) == [(0, 0, 1.0), (0, 1, 0.5), (0, 2, 2.0), (1, 0, 3.0)]
    (tmp_path / "bad").write_text("1 x")
    with pytest.raises(Exception, match="not a weight"):
        query_files.read_weights(spark, str(tmp_path / "bad")).collect()
    (tmp_path / "list").write_text("xyz\n\nx\ny\n")
    order = query_files.read_filter_list(spark, str(tmp_path / "list"))
    assert order == ["xyz", "x", "y"]
    bits = filters.filter_bits(experiments_of(spark), HashSpec(k=8, m=256), 1).where(F.col("exp_id").isin(order))
    assert tree.greedy(bits, 256, 1, order).rows() != tree.greedy(bits, 256, 1).rows()
    sketch = minhash.sketches(bits, 6, "xorshift")
    formats.write_sketch(sketch, str(tmp_path / "k"))
    assert sorted(tuple(r) for r in query_files.read_sketches(spark, str(tmp_path / "k")).collect()) == sorted(tuple(r) for r in sketch.select("exp_id", "hash_ix", "val").collect())
