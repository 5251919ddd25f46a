"""Hand-checked fixtures, invariants and plain models of the operators."""

import collections
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from kmerloom.functions import kmers
from kmerloom.operators import filters, minhash, query, tree
from kmerloom.plans.shared import shared_folder
from kmerloom.plans.spec import HashSpec
from kmerloom.sources import formats, query_files
from kmerloom.streaming.ingest import ingest, total_counts

LEAVES = {"L0": {1, 2, 3, 10}, "L1": {1, 2, 4, 11}, "L2": {1, 5, 12}}


def frame(spark, leaves):
    return spark.createDataFrame([(n, p) for n, s in leaves.items() for p in sorted(s)], "exp_id string, pos long")


@pytest.mark.parametrize("k", [1, 7, 20, 31, 33])
def test_windows_against_plain_slices(spark, monkeypatch, k):
    """Places, letters and canonical forms across pieces and sequence borders; other letters, null and short sequences."""
    random.seed(k)
    monkeypatch.setattr(kmers, "PIECE", 256)
    seq = "".join(random.choice("ACGT") for _ in range(1300))
    seq = seq[:700] + "N" + seq[700:]
    df = spark.createDataFrame([(1, seq), (2, "ACG"), (3, None), (4, ""), (5, seq[::-1]), (6, "éACGTé" * 12)], "id int, seq string").coalesce(1)
    text = lambda c: kmers.letters_of(F.col(c), k).alias(c)
    got = sorted((r.id, r.place, r.raw, r.kmer) for r in kmers.windows(df, "seq", k).select("id", "place", text("raw"), text("kmer")).collect())
    want = []
    for i, s in ((1, seq), (2, "ACG"), (5, seq[::-1])):
        for j in range(len(s) - k + 1):
            w = s[j : j + k]
            if "N" not in w:
                want.append((i, j, w, min(w, w[::-1].translate(str.maketrans("ACGT", "TGCA")))))
    assert [g for g in got if g[0] != 6] == want
    assert {g[2] for g in got if g[0] == 6} == {"ACGT"[i : i + k] for i in range(5 - k)}
    reads = df.where("id <> 6").select(F.when(F.col("id") == 5, "b").otherwise("a").alias("exp_id"), "seq")
    plain = collections.Counter(("b" if i == 5 else "a", w) for i, _, _, w in want)
    assert {(r.exp_id, r.kmer): r.n for r in filters.kmer_counts(reads, k).select("exp_id", text("kmer"), "n").collect()} == plain


def test_long_sequences_take_linear_time():
    import time

    data = np.frombuffer(b"ACGT", np.uint8)[np.random.default_rng(1).integers(0, 4, 4_000_000)]
    times = []
    for n in (1_000_000, 4_000_000):
        began = time.perf_counter()
        at, _, low = kmers.codes(data[:n], 20)
        times.append(time.perf_counter() - began)
        assert len(at) == n - 19 and low.min() >= 0 and low.max() < 1 << 40
    assert times[1] < 12 * times[0]


def test_hand_checked_nodes(spark):
    root = tree.Node("root", tree.Node("n", tree.Node("L0"), tree.Node("L1")), tree.Node("L2"))
    t, bits = tree.tree_table(spark, root), frame(spark, LEAVES)
    nodes = tree.node_bits(t, bits)
    got = {}
    for r in nodes.collect():
        got.setdefault((r.node_id, r.kind), set()).add(r.pos)
    assert got == {
        ("root", "sim"): {1}, ("root", "dif"): {2, 3, 4, 5, 10, 11, 12}, ("n", "sim"): {2}, ("n", "dif"): {3, 4, 10, 11},
        ("L0", "sim"): {3, 10}, ("L1", "sim"): {4, 11}, ("L2", "sim"): {5, 12},
    }
    words = tree.node_words(t, bits)
    back = collections.defaultdict(set)
    for r in tree.bits_of_words(tree.words_of_bits(nodes)).collect():
        back[r.node_id, r.kind].add(r.pos)
    assert back == got
    sizes = {r.node_id: (r.sim_size, r.dif_size) for r in tree.node_sizes(t, words, 64).collect()}
    assert sizes == {"root": (64, 63), "n": (7, 6), "L0": (4, 2), "L1": (4, 2), "L2": (7, 5)}
    assert {(r.exp_id, r.pos) for r in tree.rebuilt(t, words).collect()} == {(n, p) for n, s in LEAVES.items() for p in s}
    assert all(r.ok for r in tree.check(t, words, bits).collect())


def test_similarity_by_hand(spark):
    bits = frame(spark, LEAVES)
    row = lambda k: {(r.a, r.b): r.sim for r in filters.similarity(bits, 64, k).collect()}[("L0", "L1")]
    assert row(0) == 60 and row(1) == 21
    with pytest.raises(ValueError):
        filters.similarity(bits, 64, 9)


def test_float32_threshold(spark):
    df = spark.createDataFrame([(15, 25, 0.6), (16, 25, 0.6)], "h long, t long, th float")
    assert [r[0] for r in df.select(filters.at_least(F.col("h"), F.col("t"), F.col("th"))).collect()] == [False, True]


@pytest.mark.parametrize("m", [64, 100, 4096])
def test_packing_round_trip(spark, m):
    random.seed(m)
    leaves = {f"e{i}": set(random.sample(range(m), m // 3)) for i in range(3)} | {"full": set(range(m))}
    bits = frame(spark, leaves)
    back = {}
    for r in filters.unpacked(filters.packed(bits)).collect():
        back.setdefault(r.exp_id, set()).add(r.pos)
    assert back == leaves
    assert {r.exp_id: r.ones for r in filters.popcounts(filters.packed(bits)).collect()} == {n: len(s) for n, s in leaves.items()}


def test_answers_do_not_depend_on_the_topology(spark):
    shared_folder(spark)
    random.seed(3)
    text = lambda n: "".join(random.choice("ACGT") for _ in range(n))
    reads = [(f"e{i:02d}", i, text(300)) for i in range(7)]
    queries = [(j, reads[j][2][20:120] if j < 5 else text(100), th) for j, th in enumerate([0.9, 1.0, 0.5, 0.1, 0.3, 0.2])]
    r = spark.createDataFrame(reads, "exp_id string, read_id long, seq string")
    q = spark.createDataFrame(queries, "query_id long, seq string, theta float")
    spec = HashSpec(k=12, nh=2, m=2048)
    bits = filters.filter_bits(r, spec, 1).persist()
    flat = {(x.query_id, x.exp_id) for x in query.threshold_query(q, bits, spec).collect()}
    assert {(j, f"e{j:02d}") for j in range(5)} <= flat
    names = tree.experiments(bits)
    chain = tree.Node(names[0])
    for n in names[1:]:
        chain = tree.Node(f"{n}_up", chain, tree.Node(n))
    plan = minhash.cluster_plan(minhash.sketches(bits, 8), names, 8)
    for root in (tree.balanced(names), tree.greedy(bits, spec.m, 1), tree.from_merges(plan), chain):
        t = tree.tree_table(spark, root)
        for nodes in (tree.node_bits, tree.node_words):
            assert {(x.query_id, x.exp_id) for x in query.tree_query(q, t, nodes(t, bits), spec).collect()} == flat


@pytest.mark.parametrize("kind", [0, 1, 2, 3])
def test_greedy_against_incremental_model(spark, kind):
    """A model that mutates sim and dif as experiments come gives the same tree."""
    random.seed(kind)
    m = 64
    leaves = {f"e{i}": {x for x in range(m) if random.random() < 0.4} for i in range(6)}
    word = lambda s: np.array([sum(1 << p for p in s)], np.uint64).view(np.int64)
    zero, names = np.zeros(1, np.int64), sorted(leaves)
    sim, dif, kids, up, root = {}, {}, {}, {}, names[0]
    sim[root], dif[root] = word(leaves[root]), zero
    for n in names[1:]:
        s, at = word(leaves[n]), root
        while at in kids:
            pushed = sim[at] & ~s
            dif[at] = dif[at] | (sim[at] ^ s)
            sim[at] = sim[at] & s
            s = s & ~sim[at]
            for c in kids[at]:
                sim[c] = sim[c] | pushed
            a, b = (tree._sim(kind, (sim[c], dif[c]), (s, zero), m) for c in kids[at])
            at = kids[at][1 if b >= a else 0]
        new = n + "_union"
        both = sim[at] & s
        sim[new], dif[new], sim[n], dif[n] = both, dif[at] | (sim[at] ^ s), s & ~both, zero
        sim[at] = sim[at] & ~both
        kids[new] = [at, n]
        if at in up:
            p = up[at]
            kids[p][kids[p].index(at)], up[new] = new, p
        else:
            root = new
        up[at] = up[n] = new
    want = tree.from_merges([(k, *v) for k, v in kids.items()])
    assert tree.greedy(frame(spark, leaves), m, kind).rows() == want.rows()


def test_bool_not_holds_without_hits(spark):
    atoms = spark.createDataFrame([(1, 0, "AAAAACCCCC", 0.5)], "query_id long, atom_ix int, seq string, theta float")
    names = spark.createDataFrame([("a",), ("b",)], "exp_id string")
    index = query.query_kmers(spark.createDataFrame([("a", "AAAAACCCCC")], "query_id string, seq string"), 5).select(F.col("query_id").alias("exp_id"), "kmer").distinct()
    got = query.bool_query(atoms, {"yes": "a0", "no": "NOT a0"}, names, index, HashSpec(k=5)).collect()
    assert {(r.name, r.exp_id) for r in got} == {("yes", "a"), ("no", "b")}


def test_weights_must_suffice(spark):
    q = spark.createDataFrame([(1, "ACGTACCA", 0.5)], "query_id long, seq string, theta float")
    index = query.query_kmers(spark.createDataFrame([("a", "ACGTA")], "query_id string, seq string"), 5).select(F.col("query_id").alias("exp_id"), "kmer")
    few = spark.createDataFrame([(1, 0, 1.0)], "query_id long, ord int, w float")
    with pytest.raises(Exception, match="fewer weights"):
        query.weighted_query(q, index, few, HashSpec(k=5)).collect()


@pytest.mark.parametrize("own", [False, True])
def test_xorshift_sketch_against_plain_integers(spark, tmp_path, own):
    leaves = {"a": {1, 5, 900}, "b": {5}}
    (tmp_path / "t").write_text("".join(f"{a} {a + 9} {a + 20}\n" for a in range(1, 12)))
    shifts = query_files.read_shifts(spark, str(tmp_path / "t")) if own else minhash.SHIFTS
    assert not own or shifts[10] == (11, 20, 31)
    got = {(r.exp_id, r.hash_ix): r.val for r in minhash.sketches(frame(spark, leaves), 10, "xorshift", 3, shifts).collect()}
    mask = (1 << 64) - 1

    def value(slot, pos):
        x = pos ^ ((0x9E3779B97F4A7C15 * (slot + 1) ^ 3) & mask)
        a, b, c = shifts[slot % len(shifts)]
        for _ in range(minhash.ROUNDS):
            x ^= x << a & mask
            x ^= x >> b
            x ^= x << c & mask
        return x

    for n, s in leaves.items():
        for j in range(10):
            assert got[n, j] + (1 << 63) == min(value(j, p) for p in s)


def test_cluster_plan_against_plain_model(spark):
    random.seed(8)
    leaves = {f"e{i}": {x for x in range(60) if random.random() < 0.3} for i in range(6)} | {"none": set()}
    bits, slots = frame(spark, leaves), 12
    sketch = minhash.sketches(bits, slots).persist()
    rows = {(r.exp_id, r.hash_ix): r.val for r in sketch.collect()}
    vec = {n: [rows.get((n, j)) for j in range(slots)] for n in leaves}
    items, want = [(n, vec[n]) for n in leaves], []
    while len(items) > 1:
        best = None
        for i in range(len(items)):
            for j in range(i):
                d = 1 - sum(x == y and x is not None for x, y in zip(items[i][1], items[j][1])) / slots
                if best is None or d < best[0]:
                    best = d, i, j
        _, i, j = best
        name = f"internal_{len(items)}_union"
        want.append((name, items[i][0], items[j][0]))
        low = [y if x is None else x if y is None else min(x, y) for x, y in zip(items[i][1], items[j][1])]
        items[j] = name, low
        items[i] = items[-1]
        items.pop()
    assert minhash.cluster_plan(sketch, list(leaves), slots) == want


def test_formats(spark, tmp_path):
    (tmp_path / "e1.fa").write_text(">r1 x\nACGT\nacg\n>r2\nTTTT\n")
    got = sorted((r.exp_id, r.read_id, r.seq) for r in formats.read_fasta(spark, str(tmp_path / "e1.fa")).collect())
    assert got == [("e1", "r1", "ACGTACG"), ("e1", "r2", "TTTT")]
    (tmp_path / "e2.fastq").write_text("@r1 x\nACGT\n+\n@III\n@r2\nGGGG\n+\nIIII\n")
    got = sorted((r.exp_id, r.read_id, r.seq) for r in formats.read_fastq(spark, str(tmp_path / "e2.fastq")).collect())
    assert ("e2", "r1", "ACGT") in got and ("e2", "r2", "GGGG") in got
    root = tree.balanced(list("abcde"))
    t = tree.tree_table(spark, root)
    formats.write_tree(t, str(tmp_path / "tree"))
    assert sorted(formats.read_tree(spark, str(tmp_path / "tree")).collect()) == sorted(t.collect())
    formats.write_merges(tree.merges_of(t), str(tmp_path / "merges"))
    assert tree.from_merges(formats.read_merges(spark, str(tmp_path / "merges"))).rows() == root.rows()
    assert tree.to_dot(t).count("->") == 8
    with pytest.raises(ValueError):
        formats.parse_tree(["root", "**deep"])
    spec = HashSpec(k=7, nh=2, m=128)
    spec.save(spark, str(tmp_path / "spec"))
    assert HashSpec.load(spark, str(tmp_path / "spec")) == spec
    q = spark.createDataFrame([(1, "ACGT"), (2, "TT")], "query_id long, seq string")
    res = spark.createDataFrame([(1, "b"), (1, "a")], "query_id long, exp_id string")
    lines = [r.value for r in formats.result_lines(res, q).orderBy("query_id", "line").collect()]
    assert lines == ["*ACGT 2", "a", "b", "*TT 0"]


def test_empty_tables(spark):
    bits = spark.createDataFrame([], "exp_id string, pos long")
    t = tree.tree_table(spark, tree.balanced(tree.experiments(bits)))
    assert t.count() == 0 and tree.node_bits(t, bits).count() == 0
    q = spark.createDataFrame([], "query_id long, seq string, theta float")
    assert query.threshold_query(q, bits, HashSpec()).count() == 0
    assert minhash.cluster_plan(minhash.sketches(bits, 4), [], 4) == []


def test_stream_counts_each_read_once(spark, tmp_path):
    random.seed(2)
    reads = [(f"e{i % 2}", "".join(random.choice("ACGT") for _ in range(60))) for i in range(6)]
    df = spark.createDataFrame(reads, "exp_id string, seq string")
    for i in range(2):
        df.where(f"exp_id = 'e{i}'").write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
        ingest(stream, HashSpec(k=9), str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
    got = total_counts(spark.read.parquet(str(tmp_path / "out")))
    assert sorted(got.collect()) == sorted(filters.kmer_counts(df, 9).collect())


def test_tree_plan_shares_positions_and_retires_them(spark):
    """Queries cut from one sequence share rows; a position leaves once all queries that need it have left the node."""
    random.seed(5)
    text = lambda n: "".join(random.choice("ACGT") for _ in range(n))
    base, other = text(400), text(400)
    reads = [(f"e{i}", i, (base if i < 4 else other)[: 250 + 30 * i]) for i in range(8)]
    r = spark.createDataFrame(reads, "exp_id string, read_id long, seq string")
    # 150 queries over three groups at least: overlapping cuts of both sequences, repeats, misses and one below k
    cuts = [(j, (base if j % 2 else other)[j : j + 80], [0.2, 0.9, 1.0][j % 3]) for j in range(140)]
    q = [*cuts, *[(140 + j, base[:20] * 5, 0.5) for j in range(5)], *[(145 + j, text(60), 0.3) for j in range(4)], (149, "ACG", 0.5)]
    q = spark.createDataFrame(q, "query_id long, seq string, theta float")
    spec = HashSpec(k=12, nh=2, m=1 << 14)
    bits = filters.filter_bits(r, spec, 1).persist()
    t = tree.tree_table(spark, tree.balanced(tree.experiments(bits)))
    flat = sorted((x.query_id, x.exp_id) for x in query.threshold_query(q, bits, spec).collect())
    levels = []
    assert sorted((x.query_id, x.exp_id) for x in query.tree_query(q, t, tree.node_words(t, bits), spec, levels).collect()) == flat
    assert [x["level"] for x in levels] == list(range(len(levels))) and 2 <= len(levels) <= 4
    assert all(x["rows"] < x["unshared"] / 4 for x in levels)
    # by definition: an open position at a level is one of a query that goes on from the node above, in that node's dif
    kinds = {(x.node_id, x.pos): x.kind for x in tree.node_bits(t, bits).collect()}
    wanted = {}
    for x in query.query_positions(q, spec).collect():
        wanted.setdefault(x.query_id, []).append(x.pos)
    rounds = query.tree_rounds(q, t, tree.node_words(t, bits), spec).collect()
    up = {x.node_id: x.parent_id for x in t.collect()}

    def open_above(query_id, node):
        keep = wanted[query_id]
        while up[node] is not None:
            node = up[node]
            keep = [p for p in keep if kinds.get((node, p)) == "dif"]
        return len(keep)

    for x in levels:
        assert x["unshared"] == sum(open_above(s.query_id, s.node_id) for s in rounds if s.level == x["level"])
    goes = {(s.query_id, s.node_id) for s in rounds if s.may and not s.sure}
    assert {(s.query_id, up[s.node_id]) for s in rounds if s.level} == goes
    none = query.tree_query(q.where("query_id < 0"), t, tree.node_words(t, bits), spec)
    assert none.count() == 0
