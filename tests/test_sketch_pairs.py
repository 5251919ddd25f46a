"""Banded pairs of sketches and the topology by mutual nearest neighbours, against plain models."""

import collections
import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from kmerloom.operators import filters, minhash, query, tree
from kmerloom.plans.shared import shared_folder
from kmerloom.plans.spec import HashSpec


def sketch_rows(vectors):
    return [(n, i, v) for n, vec in vectors.items() for i, v in enumerate(vec)]


def frame(spark, vectors):
    return spark.createDataFrame(sketch_rows(vectors), "exp_id string, hash_ix int, val long")


def families(seed, n, slots, size=4):
    """Vectors in families whose members share many slots with the family's."""
    random.seed(seed)
    out = {}
    for f in range(n // size):
        base = [random.randrange(10**9) for _ in range(slots)]
        for k in range(size):
            keep = random.random()
            out[f"f{f:03d}_{k}"] = [v if random.random() < keep else random.randrange(10**9) for v in base]
    return out


@pytest.mark.parametrize("rows,hot", [(1, 256), (2, 256), (1, 2), (4, 3)])
def test_banded_pairs_by_definition(spark, rows, hot):
    slots, least = 16, 0.5
    v = families(rows, 60, slots) | {f"copy{i:02d}": list(range(slots)) for i in range(20)}
    got = {(r.i, r.j): r.same for r in minhash.banded_pairs(frame(spark, v), slots, least, rows, hot).collect()}
    want = {}
    for a in v:
        for b in v:
            same = [x == y for x, y in zip(v[a], v[b])]
            if a > b and sum(same) >= least * slots and any(all(same[i : i + rows]) for i in range(0, slots, rows)):
                want[a, b] = sum(same)
    assert got == want and len(want) > 190


def test_banded_pairs_recall(spark):
    """At the width that is chosen for a similarity, nine in ten pairs of the full matrix at least."""
    slots, least = 100, 0.4
    v = families(3, 200, slots)
    got = {(r.i, r.j) for r in minhash.banded_pairs(frame(spark, v), slots, least).collect()}
    want = {(a, b) for a in v for b in v if a > b and sum(x == y for x, y in zip(v[a], v[b])) >= least * slots}
    assert minhash.band_rows(slots, least) > 1 and got <= want and len(got) >= 0.9 * len(want) > 50


def test_no_row_without_a_common_band(spark):
    v = {f"e{i}": [i * 1000 + j for j in range(8)] for i in range(300)}
    df = minhash.banded_pairs(frame(spark, v), 8, 0.1, 1)
    assert df.count() == 0
    assert "NestedLoop" not in df._jdf.queryExecution().executedPlan().toString() and "Cartesian" not in df._jdf.queryExecution().executedPlan().toString()


def by_definition(vectors, least, rows):
    """Pairs with a whole band in common that agree in `least` slots; None is equal to nothing."""
    want = {}
    for a in vectors:
        for b in vectors:
            same = [x == y and x is not None for x, y in zip(vectors[a], vectors[b])]
            if a > b and sum(same) >= least and any(all(same[i : i + rows]) for i in range(0, len(same) // rows * rows, rows)):
                want[a, b] = sum(same)
    return want


def shuffled_rows(df):
    """The rows of df and how many rows its shuffles wrote in all."""
    rows, out = df.collect(), []

    def walk(p):
        name = p.getClass().getSimpleName()
        if name == "AdaptiveSparkPlanExec":
            return walk(p.executedPlan())
        if name.endswith("QueryStageExec"):
            return walk(p.plan())
        if name == "ShuffleExchangeExec":
            out.append(p.metrics().apply("shuffleRecordsWritten").value())
        for i in range(p.children().size()):
            walk(p.children().apply(i))

    walk(df._jdf.queryExecution().executedPlan())
    return rows, sum(out)


def test_no_pair_is_shuffled(spark):
    """Half a million pairs have a band in common: what is shuffled grows with the sketches, whether or not a pair agrees."""
    slots, n = 16, 500
    v = {f"far{i:03d}": [1, 2, *range(100 * i + 10_000, 100 * i + 10_014)] for i in range(n)} | {f"copy{i:03d}": list(range(slots)) for i in range(n)}
    v |= {f"half{i:03d}": [*range(5, 13), *range(100 * i + 90_000, 100 * i + 90_008)] for i in range(n)}
    rows, shuffled = shuffled_rows(minhash.banded_pairs(frame(spark, v), slots, 0.5, 2))
    assert len(rows) == 2 * n * (n - 1) // 2 and collections.Counter(r.same for r in rows) == {8: n * (n - 1) // 2, 16: n * (n - 1) // 2}
    assert shuffled <= 3 * slots // 2 * len(v)


def test_members_of_a_crowded_band_are_repeated_a_bounded_number_of_times(spark):
    """Blocks get larger instead of more; every pair is found once."""
    slots, v = 8, {f"copy{i:03d}": [7] * 8 for i in range(240)} | {f"near{i:03d}": [7] * 6 + [i, i] for i in range(240)}
    rows, shuffled = shuffled_rows(minhash.banded_pairs(frame(spark, v), slots, 0.5, 2, 2))
    assert {(r.i, r.j): r.same for r in rows} == by_definition(v, 4, 2) and len(rows) == 480 * 479 // 2
    assert shuffled <= (minhash.BLOCKS + 3) * slots // 2 * len(v)


def test_slots_that_are_missing_are_equal_to_none(spark):
    random.seed(4)
    v = {f"e{i:02d}": [None if random.random() < 0.3 else random.randrange(2) for _ in range(9)] for i in range(40)}
    rows = [(n, i, x) for n, vec in v.items() for i, x in enumerate(vec) if x is not None]
    got = minhash.banded_pairs(spark.createDataFrame(rows, "exp_id string, hash_ix int, val long"), 9, 4 / 9, 2).collect()
    assert {(r.i, r.j): r.same for r in got} == by_definition(v, 4, 2) and len(got) > 20


@pytest.mark.parametrize("size", [1, 3, 1000])
def test_buckets_over_several_batches(monkeypatch, size):
    """Keys that batches cut, two blocks that meet, and two bands that have one key by chance; few pairs at once."""
    monkeypatch.setattr(minhash, "PAIRS", 3)
    vec = {f"n{i}": [1, 1, 2, 2] if i < 6 else [1, 1, i, i] for i in range(9)} | {"x": [5, 5, 2, 2], "y": [5, 5, 9, 9]}
    rows = [(n, 0, s, 10, 0, 0, False) for n, s in vec.items() if n[0] == "n"] + [("x", 0, vec["x"], 10, 0, 0, False), ("y", 0, vec["y"], 10, 0, 0, False)]
    rows += [("n1", 0, vec["n1"], 11, 0, 1, False), ("n2", 0, vec["n2"], 11, 0, 1, False), ("n7", 0, vec["n7"], 11, 0, 1, True), ("n8", 0, vec["n8"], 11, 0, 1, True)]
    rows += [("n1", 0, vec["n1"], 12, 0, 0, False), ("n2", 1, vec["n2"], 12, 0, 0, False), ("x", 1, vec["x"], 12, 0, 0, False)]
    kinds = pa.string(), pa.int32(), pa.list_(pa.int64()), pa.int64(), pa.int32(), pa.int32(), pa.bool_()
    batch = pa.record_batch([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], ["exp_id", "band", "sketch", "key", "p", "q", "second"])
    got = [tuple(r.values()) for b in minhash._agreeing(4, 2, 2)(batch.slice(i, size) for i in range(0, len(batch), size)) for r in b.to_pylist()]
    n = [f"n{i}" for i in range(9)]
    want = [(a, b, 4 if b < "n6" else 2) for a in n for b in n if a < b] + [("x", "y", 2)]
    want += [(a, b, 2) for a in ("n1", "n2") for b in ("n7", "n8")] + [("n2", "x", 2)]
    assert sorted(got) == sorted(want)


def plain_merges(vectors, names, slots, least):
    nodes, left, out, step = dict(vectors), set(names), [], 0
    while step < 40 and least * slots >= 0.5:
        rows = minhash.band_rows(slots, least)
        best = {}
        for a in nodes:
            for b in nodes:
                same = [x == y for x, y in zip(nodes[a], nodes[b])]
                if a < b and sum(same) >= least * slots and any(all(same[i : i + rows]) for i in range(0, slots // rows * rows, rows)):
                    for n in (a, b):
                        best[n] = min(best.get(n, (1, "", "")), (-sum(same), a, b))
        pairs = {p for p in best.values() if best[p[1]] == p and best[p[2]] == p}
        for _, a, b in sorted(pairs, key=lambda p: p[1:]):
            new = f"u{step}_{a}"
            out.append((new, a, b))
            nodes[new] = [min(x, y) for x, y in zip(nodes.pop(a), nodes.pop(b))]
            left = left - {a, b} | {new}
        step += 1
        if not pairs:
            least /= 2
    while len(left) > 1:
        rest, left = sorted(left), set()
        for i in range(0, len(rest), 2):
            if i + 1 < len(rest):
                out.append((f"u{step}_{rest[i]}", rest[i], rest[i + 1]))
                left.add(out[-1][0])
            else:
                left.add(rest[i])
        step += 1
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_nearest_merges_against_plain_model(spark, seed):
    slots = 16
    v = families(seed, 24, slots) | {"copy1": [5] * slots, "copy2": [5] * slots, "copy3": [5] * slots}
    names = [*v, "no_filter"]
    got = minhash.nearest_merges(frame(spark, v), spark.createDataFrame([(n,) for n in names], "exp_id string"), slots).orderBy("step").collect()
    assert sorted((r.new_node, r.c0, r.c1) for r in got) == sorted(plain_merges(v, names, slots, 0.5))
    assert [r.step for r in got] == list(range(1, len(names)))
    root = tree.from_merges([(r.new_node, r.c0, r.c1) for r in got])
    assert {r[6] for r in root.rows() if r[6]} == set(names)


def test_answers_with_the_nearest_tree(spark):
    shared_folder(spark)
    random.seed(5)
    reads = [(f"e{i:02d}", "".join(random.choice("ACGT") for _ in range(200))) for i in range(9)]
    reads += [(f"e{i:02d}", reads[i % 4][1]) for i in range(9)]
    r = spark.createDataFrame(reads, "exp_id string, seq string")
    q = spark.createDataFrame([(i, reads[i][1][20:90], 0.9) for i in range(9)], "query_id long, seq string, theta float")
    spec = HashSpec(k=12, m=1 << 13)
    bits = filters.filter_bits(r, spec, 1)
    merges = minhash.nearest_merges(minhash.sketches(bits, 16), bits.select("exp_id").distinct(), 16).collect()
    t = tree.tree_table(spark, tree.from_merges([(m.new_node, m.c0, m.c1) for m in merges]))
    flat = {(x.query_id, x.exp_id) for x in query.threshold_query(q, bits, spec).collect()}
    assert {(x.query_id, x.exp_id) for x in query.tree_query(q, t, tree.node_bits(t, bits), spec).collect()} == flat and len(flat) > 9


def test_nothing_to_merge(spark):
    empty = spark.createDataFrame([], "exp_id string, hash_ix int, val long")
    none = spark.createDataFrame([], "exp_id string")
    assert minhash.nearest_merges(empty, none, 4).count() == 0 and minhash.banded_pairs(empty, 4, 0.5).count() == 0
    one = spark.createDataFrame([("a",)], "exp_id string")
    assert minhash.nearest_merges(empty, one, 4).count() == 0
