"""Deep topologies, damaged nodes, stored indexes, super-k-mers, batches of boolean lines and numbers of lines."""

import collections
import itertools
import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from kmerloom.functions import kmers
from kmerloom.operators import filters, minimizers, query, tree
from kmerloom.plans.index import Index
from kmerloom.plans.shared import stored
from kmerloom.plans.spec import HashSpec
from kmerloom.sources import formats, lines, query_files


def chain(names):
    root = tree.Node(names[0])
    for n in names[1:]:
        root = tree.Node(f"{n}_up", root, tree.Node(n))
    return root


def frame(spark, leaves):
    return spark.createDataFrame([(n, p) for n, s in leaves.items() for p in sorted(s)], "exp_id string, pos long")


def plain_nodes(root, leaves):
    """sim and dif of every node by their definition."""
    out = {}

    def below(n):
        return {n.name} if n.left is None else below(n.left) | below(n.right)

    def walk(n, claimed):
        sets = [leaves[x] for x in below(n)]
        every, some = set.intersection(*sets), set.union(*sets)
        out[n.name] = every - claimed, some - every
        if n.left is not None:
            walk(n.left, every)
            walk(n.right, every)

    walk(root, set())
    return out


@pytest.mark.parametrize("cells", [1, 64, 1 << 22])
def test_nodes_by_definition(spark, monkeypatch, cells):
    """All shapes of trees, words of all signs, and blocks of one word and of many."""
    monkeypatch.setattr(tree, "CELLS", cells)
    random.seed(cells)
    names = [f"e{i}" for i in range(9)]
    leaves = {n: {p for p in range(400) if random.random() < 0.7} | {63, 127} for n in names}
    for root in (tree.balanced(names), chain(names), tree.from_merges([("x", "e1", "e0"), ("y", "e2", "x")])):
        t = tree.tree_table(spark, root)
        own = {n: leaves[n] for n in names if n in {r.exp_id for r in t.collect()}}
        words = tree.node_words(t, frame(spark, own))
        got = collections.defaultdict(lambda: (set(), set()))
        for r in tree.bits_of_words(words).collect():
            got[r.node_id][r.kind == "dif"].add(r.pos)
        assert {n: v for n, v in plain_nodes(root, own).items() if v[0] | v[1]} == dict(got)
        rows = tree.check(t, words, frame(spark, own)).collect()
        assert all(r.ok and r.n_union == r.n_node for r in rows) and len(rows) == 2 * len(own) - 1
        assert {r.node_id: r.n_union for r in rows if r.node_id in own} == {n: len(s) for n, s in own.items()}
        below = tree.leaves_below(t.select("node_id", F.col("node_id").alias("at")), t).collect()
        assert {(r["at"], r.exp_id) for r in below if r["at"] == root.name} == {(root.name, n) for n in own}


def test_chain_of_20000(spark):
    n = 20_000
    names = [f"e{i}" for i in range(n)]
    t = spark.createDataFrame(spark.sparkContext.parallelize(chain(names).rows(), 4), tree.SCHEMA)
    bits = spark.range(n).select(F.concat(F.lit("e"), "id").alias("exp_id"), F.explode(F.array(F.lit(1).cast("long"), F.lit(63).cast("long"), F.col("id") % 64)).alias("pos")).distinct()
    began = time.time()
    words = tree.node_words(t, bits)
    rows = tree.check(t, words, bits).where("NOT ok").count()
    assert rows == 0 and words.count() <= 2 * n - 1
    assert time.time() - began < 90


def test_damaged_nodes_are_found(spark, tmp_path):
    """A changed word fails its node's check, and those below it where it is a sim; writing refuses damage of any kind."""
    random.seed(1)
    names = [f"e{i}" for i in range(6)]
    leaves = {n: {p for p in range(200) if random.random() < 0.5} | {7} for n in names}
    spec = HashSpec(k=5, m=200, parts=4)
    bits = frame(spark, leaves)
    index = Index.of(bits, spec, str(tmp_path / "i")).build(tree.balanced(names)).compress()
    words = stored(index.words)  # the index's own go with a refused write
    hit = lambda node, kind, c: words.withColumn(kind, F.when((F.col("node_id") == node) & (F.col("word_idx") == 0), c).otherwise(F.col(kind)))
    bad = lambda w: {r.node_id for r in tree.check(index.tree, w, bits).where("NOT ok").collect()}
    assert bad(words) == set()
    assert bad(hit("e3", "sim", F.lit(0).cast("long"))) == {"e3"}
    assert bad(hit("0_3", "dif", F.col("dif").bitwiseXOR(F.lit(8).cast("long")))) == {"0_3"}
    assert bad(hit("0_6", "sim", F.lit(0).cast("long"))) == {*names, "0_6", "0_3", "3_6", "0_2", "3_5"}
    with pytest.raises(ValueError, match="set positions"):
        index.write_nodes(hit("e3", "sim", F.lit(0).cast("long")))
    for damaged, what in (
        (hit("e3", "dif", F.lit(1).cast("long")), "leaf with a dif|sim and dif"),
        (hit("0_3", "dif", F.col("sim").bitwiseOR(F.col("dif")).bitwiseOR(F.lit(1).cast("long"))), "sim and dif|set positions"),
        (words.withColumn("word_idx", F.col("word_idx") + 4), "beyond"),
        (words.withColumn("node_id", F.lit("none")), "no node"),
    ):
        with pytest.raises(Exception, match=what):
            index.write_nodes(damaged)


def test_stored_index_prunes_parts(spark, tmp_path):
    random.seed(4)
    reads = [(f"e{i % 5}", "".join(random.choice("ACGT") for _ in range(400))) for i in range(20)]
    r = spark.createDataFrame(reads, "exp_id string, seq string")
    spec = HashSpec(k=12, nh=2, m=1 << 16, parts=64)
    index = Index.create(r, spec, str(tmp_path / "i"), 1)
    flat = filters.filter_bits(r, spec, 1)
    assert sorted(index.bits.select("exp_id", "pos").collect()) == sorted(flat.collect())
    q = spark.createDataFrame([(i, reads[i][1][a : a + 20], 0.9) for i, a in ((0, 0), (3, 300))], "query_id long, seq string, theta float")
    got, want = query.threshold_query(q, index.bits, spec), query.threshold_query(q, flat, spec)
    assert sorted(got.collect()) == sorted(want.collect()) and got.count() >= 2
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "dynamicpruning" in plan.lower()
    full = query.full_kmer_query(q, index.bits, spec)
    assert sorted(full.collect()) == sorted(query.full_kmer_query(q, flat, spec).collect())
    # parts that the 36 positions are not in are not read
    scanned = [n for n in _metrics(got) if "numPartitions" in n]
    assert scanned and all(n["numPartitions"] < 50 for n in scanned)


def _metrics(df):
    """Metrics of the file scans of a query that has run."""
    df.collect()
    out = []

    def walk(p):
        name = p.getClass().getSimpleName()
        if name == "AdaptiveSparkPlanExec":
            return walk(p.executedPlan())
        if name.endswith("QueryStageExec"):
            return walk(p.plan())
        if name == "FileSourceScanExec":
            m, it, got = p.metrics(), p.metrics().iterator(), {}
            while it.hasNext():
                e = it.next()
                got[e._1()] = e._2().value()
            out.append(got)
        c = p.children()
        for i in range(c.size()):
            walk(c.apply(i))

    walk(df._jdf.queryExecution().executedPlan())
    return out


# ---------------------------------------------------------------- super-k-mers


def test_super_kmers_cover_every_window_once():
    random.seed(5)
    for k in (1, 2, 7, 8, 9, 20, 31):
        for _ in range(20):
            text = "".join(random.choice("ACGTACGTACGTN") for _ in range(random.randint(0, 300))) + "A" * random.choice([0, 600])
            data = np.frombuffer(text.encode(), np.uint8)
            start, windows, low = minimizers.super_kmers(data, k)
            places = minimizers._spans(start, windows)
            assert sorted(places.tolist()) == kmers.codes(data, k)[0].tolist() and (windows.max(initial=0) <= minimizers.MOST_RUN)
            # a window and its reverse complement have one minimizer
            back = np.frombuffer(text[::-1].translate(str.maketrans("ACGT", "TGCA")).encode(), np.uint8)
            s2, w2, l2 = minimizers.super_kmers(back, k)
            of = lambda s, w, l, flip: {(len(text) - k - p if flip else p): x for a, n, x in zip(s.tolist(), w.tolist(), l.tolist()) for p in range(a, a + n)}  # noqa: E731, E741
            assert of(start, windows, low, False) == of(s2, w2, l2, True)


@pytest.mark.parametrize("k,piece,heavy", [(20, 1 << 22, 4096), (20, 700, 30), (31, 900, 1), (5, 600, 10), (1, 500, 5)])
def test_counts_by_minimizer(spark, monkeypatch, k, piece, heavy):
    """Pieces, long reads, hot minimizers, several experiments, nulls and other letters against a plain count."""
    monkeypatch.setattr(minimizers, "PIECE", piece)
    monkeypatch.setattr(minimizers, "HEAVY", heavy)
    random.seed(k)
    genome = "".join(random.choice("ACGT") for _ in range(3000))
    reads = [(f"e{i % 3}", genome[a : a + 120]) for i in range(150) for a in [random.randint(0, 2900)]]
    reads += [("e0", "A" * 900), ("e1", "ACGTNNACGT" * 40), ("e2", None), (None, genome), ("e2", ""), ("e9", genome), ("e1", "AC")] + [("e1", genome[:60])] * 60
    df = spark.createDataFrame(reads, "exp_id string, seq string").repartition(3)
    want = collections.Counter()
    for e, s in reads:
        for i in range(len(s or "") - k + 1):
            w = s[i : i + k]
            if e is not None and not w.strip("ACGT"):
                want[e, min(w, w[::-1].translate(str.maketrans("ACGT", "TGCA")))] += 1
    got = minimizers.counted_by_minimizer(df, k, 64).withColumn("kmer", kmers.letters_of(F.col("kmer"), k)).collect()
    assert len(got) == len(want) and {(r.exp_id, r.kmer): r.n for r in got} == want


def test_super_kmers_shuffle_a_third_at_most(spark):
    """Reads at 10-fold coverage: bytes that the count by minimizer shuffles against those of the count by k-mer."""
    genome = np.frombuffer(b"ACGT", np.uint8)[np.random.default_rng(3).integers(0, 4, 200_000)].tobytes().decode()
    random.seed(3)
    reads = spark.createDataFrame([("e", genome[a : a + 150]) for a in (random.randint(0, len(genome) - 150) for _ in range(13_000))], "exp_id string, seq string").repartition(8)
    written = {}
    for name, df in (("minimizer", minimizers.counted_by_minimizer(reads, 20)), ("kmer", kmers.counted(reads, 20).groupBy("exp_id", "kmer").agg(F.sum("n").alias("n")))):
        df.collect()
        written[name] = max(_shuffled(df._jdf.queryExecution().executedPlan()))
    print("bytes shuffled", written)
    assert 3 * written["minimizer"] <= written["kmer"]


def _shuffled(plan):
    """Bytes that the shuffles of a plan that has run wrote, but for that of the reads themselves."""
    out = []

    def walk(p):
        name = p.getClass().getSimpleName()
        if name == "AdaptiveSparkPlanExec":
            return walk(p.executedPlan())
        if name.endswith("QueryStageExec"):
            return walk(p.plan())
        if name == "ShuffleExchangeExec" and "RoundRobin" not in p.toString().split("\n")[0]:
            out.append(p.metrics().apply("shuffleBytesWritten").value())
        c = p.children()
        for i in range(c.size()):
            walk(c.apply(i))

    walk(plan)
    return out


# ---------------------------------------------------------------- boolean lines


def test_shape_tables(spark):
    """Tables of shapes of 1 to 9 atoms against Python's own booleans at every mask."""
    random.seed(6)

    def shape(n):
        if n == 1:
            return random.choice(["@", "!@", "(@)"])
        a = random.randint(1, n - 1)
        return random.choice(["", "", "!"]) + f"({shape(a)}{random.choice('&|^')}{shape(n - a)})"

    shapes = list({shape(n) for n in range(1, 10) for _ in range(8)})
    got = {r["shape"]: r["table"] for r in query.shape_tables(spark.createDataFrame([(s,) for s in shapes], "shape string")).collect()}
    for s in shapes:
        n = s.count("@")
        pieces = s.replace("!", " not ").replace("&", " and ").replace("|", " or ").replace("^", " != ").split("@")
        text = pieces[0] + "".join(f"a[{i}]{p}" for i, p in enumerate(pieces[1:]))
        for mask in range(1 << n):
            want = bool(eval(text.strip(), {"a": [bool(mask >> i & 1) for i in range(n)]})) if "!=" not in text else None
            have = bool(got[s][mask // 64] >> mask % 64 & 1)
            assert want is None or have == want
            assert have == bool(query._holds(s, [mask >> i & 1 for i in range(n)], 1))


def line_case(spark, n_lines, seed):
    """Lines over ten sequences, with their plain truth for experiments that hold known subsets."""
    random.seed(seed)
    seqs = ["".join(random.choice("ACGT") for _ in range(24)) for _ in range(10)]
    holds = {f"e{i}": {j for j in range(10) if random.random() < 0.4} for i in range(12)} | {"none": set()}
    reads = [(e, seqs[j]) for e, s in holds.items() for j in s] + [("none", "ACGTACGTACGGTACCATTGACA")]
    out, want = [], set()
    for q in range(n_lines):
        n = random.choice([1, 2, 2, 3, 14 if q % 50 == 0 else 3])
        used = [random.randrange(10) for _ in range(n)]
        ops, nots = [random.choice("&|^") for _ in range(n - 1)], [random.random() < 0.3 for _ in range(n)]
        atom = lambda i: ("!" if nots[i] else "") + f"[{seqs[used[i]]},0.9]"
        out.append("".join(atom(i) + (f" {ops[i]} " if i < n - 1 else "") for i in range(n)) + ";")
        for e, s in holds.items():
            bits = [(used[i] in s) != nots[i] for i in range(n)]
            terms, at = [], 0  # | of ^ of &
            text = "".join(str(int(bits[i])) + (ops[i] if i < n - 1 else "") for i in range(n))
            if any(sum(all(c == "1" for c in conj.split("&")) for conj in xor.split("^")) % 2 for xor in text.split("|")):
                want.add((q, e))
    return out, want, spark.createDataFrame(reads, "exp_id string, seq string"), spark.createDataFrame([(e,) for e in holds], "exp_id string")


def test_many_lines_in_splits(spark, tmp_path):
    """Lines of all lengths in files that Spark cuts into many splits: ids are numbers of lines, answers the plain ones."""
    text, want, reads, names = line_case(spark, 400, 7)
    (tmp_path / "q").mkdir()
    (tmp_path / "q" / "a").write_text("\n".join(text[:150]) + "\n")
    (tmp_path / "q" / "b").write_text("\n".join(text[150:]) + "\n")
    spec = HashSpec(k=11, m=1 << 20)
    bits = filters.filter_bits(reads, spec, 1)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        for size in (before, "1500", "333"):
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            spark.conf.set("spark.sql.files.openCostInBytes", "1")
            got = query_files.bool_file_query(spark, str(tmp_path / "q"), names, bits, spec)
            assert {(r.query_id, r.exp_id) for r in got.collect()} == want
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
        spark.conf.unset("spark.sql.files.openCostInBytes")


def test_plan_of_lines_does_not_grow(spark):
    """10,000 lines have the plan of ten, and lines that are false at mask 0 make no row for experiments without a hit."""
    sizes = {}
    for n in (10, 10_000):
        lines_ = spark.range(n).select(F.col("id").alias("query_id"), F.concat(F.lit("@&"), F.expr("repeat('!', cast(id % 7 as int) * 2)"), F.lit("@")).alias("shape"))
        atoms = spark.range(n).select(F.col("id").alias("query_id"), F.explode(F.array(F.lit(0), F.lit(1))).alias("atom_ix"), F.lit("ACGTTGCAACCA").alias("seq"), F.lit(0.5).cast("float").alias("theta"))
        index = spark.createDataFrame([("e", 1)], "exp_id string, pos long")
        names = spark.range(50).select(F.col("id").cast("string").alias("exp_id"))
        df = query.line_query(lines_, atoms, names, index, HashSpec(k=8, m=1 << 30), exact=False)
        sizes[n] = len(df._jdf.queryExecution().optimizedPlan().toString().split("\n"))
        assert df.count() == 0
    assert sizes[10] == sizes[10_000]


def test_truth_tables_of_predicates(spark):
    for n, text in ((1, "NOT a0"), (3, "a0 OR a1 AND a2"), (7, "a6 <> a0"), (0, "true")):
        table = query.truth_table(spark, text, n)
        f = lambda m: eval(text.replace("NOT", "not ").replace("OR", "or").replace("AND", "and").replace("<>", "!=").replace("true", "True"), {f"a{i}": bool(m >> i & 1) for i in range(n)})
        assert [bool(table[m // 64] >> m % 64 & 1) for m in range(1 << n)] == [bool(f(m)) for m in range(1 << n)]


# ---------------------------------------------------------------- numbers of lines


def test_lines_keep_their_numbers(spark, tmp_path):
    random.seed(8)
    d = tmp_path / "t"
    d.mkdir()
    want = []
    for f in "cab":
        text = ["x" * random.randint(0, 40) for _ in range(300)]
        (d / f).write_text("\n".join(text) + "\n")
        want.append((f, text))
    want = [t for _, ts in sorted(want) for t in ts]
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        for size in ("100", "777", "3000", before):
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            spark.conf.set("spark.sql.files.openCostInBytes", "1")
            got = sorted((r.number, r.value) for r in lines.numbered(spark, str(d)).collect())
            assert got == list(enumerate(want))
            # weights meet their queries
            (tmp_path / "w").write_text("\n".join(f"{i} {i + 0.5}" for i in range(300)))
            (tmp_path / "s").write_text("\n".join("ACGTAC"[: 3 + i % 2] for i in range(300)))
            w = query_files.read_weights(spark, str(tmp_path / "w")).where("ord = 0")
            q = formats.read_queries(spark, str(tmp_path / "s"), 4)
            met = q.join(w, "query_id").collect()
            assert len(met) == 150 and all(r.w == r.query_id and r.query_id % 2 for r in met)
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
        spark.conf.unset("spark.sql.files.openCostInBytes")
