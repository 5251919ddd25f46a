"""Bounded memory: blocks of windows and of node words, the greedy topology of large filters; sketches by word."""

import hashlib
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from kmerloom.functions import kmers
from kmerloom.operators import filters, frames, minhash, query, tree
from kmerloom.plans.index import Index
from kmerloom.plans.spec import HashSpec


def peak(run) -> float:
    """MB at once, most, of Python and numpy."""
    tracemalloc.start()
    try:
        run()
        return tracemalloc.get_traced_memory()[1] / 1e6
    finally:
        tracemalloc.stop()


@pytest.mark.parametrize("length", [3000, 6_000_000])
def test_windows_hold_a_piece_of_a_batch(length):
    """A batch of six million letters, in short reads or one long one."""
    data = np.frombuffer(b"ACGT", np.uint8)[np.random.default_rng(1).integers(0, 4, 6_000_000)].tobytes().decode()
    batch = pa.record_batch([pa.array([data[i : i + length] for i in range(0, len(data), length)])], ["seq"])
    seen = []
    assert peak(lambda: seen.append(sum(len(low) for *_, low in kmers._windows(iter([batch]), 20)))) < 64
    assert seen == [len(batch) * (length - 19)]


def test_node_words_hold_a_block(spark, monkeypatch):
    """The largest block of words of 39 nodes, as many as twenty experiments have."""
    names = [f"e{i:02d}" for i in range(20)]
    bodies = []
    monkeypatch.setattr(tree, "_by_word", lambda rows, width, body, schema: bodies.append((width, body)))
    bits = spark.createDataFrame([], "exp_id string, pos long")
    tree.node_words(tree.tree_table(spark, tree.balanced(names)), bits)
    (width, body), = bodies
    n = tree.CELLS // width
    at, leaf = np.repeat(np.arange(n), 20), np.tile(np.arange(20), n)
    word = np.random.default_rng(2).integers(-(1 << 63), 1 << 63, 20 * n)
    assert peak(lambda: list(body(at, np.arange(n), [leaf, word]))) < 100


@pytest.mark.parametrize("kind", [0, 1, 2, 3])
def test_greedy_of_large_filters_is_that_of_small_ones(spark, monkeypatch, kind):
    """Filters over the driver's size, in blocks of few words; an experiment without bits, and one more than once alike."""
    rng = np.random.default_rng(kind)
    rows = [(f"e{i}", int(p)) for i in range(7) for p in np.flatnonzero(rng.random(700) < (0.1 + 0.1 * (i % 3)))]
    rows += [("e9", p) for n, p in rows if n == "e3"]
    bits = spark.createDataFrame(rows, "exp_id string, pos long")
    names = ["e3", "none", "e0", "e5", "e9", "e1", "e2", "e6", "e4"]
    cases = (bits, names), (bits, None), (bits.where("exp_id = 'e1'"), None)
    want = [tree.greedy(b, 700, kind, n).rows() for b, n in cases]
    monkeypatch.setattr(tree, "GREEDY_BYTES", 10)
    monkeypatch.setattr(tree, "CELLS", 100)
    assert [tree.greedy(b, 700, kind, n).rows() for b, n in cases] == want


@pytest.mark.parametrize("most", [1, 5000])
def test_md5_hashes_a_position_of_many_filters_once(spark, monkeypatch, most):
    """Minima against plain MD5, over batches that cut a word, and how many positions were hashed."""
    rng = np.random.default_rng(5)
    leaves = {f"e{i}": np.flatnonzero(rng.random(1500) < 0.6) for i in range(8)} | {"far": np.array([5, 63, 10**9, 10**9 + 7])}
    rows = sorted({(int(p) // 64, n) for n, s in leaves.items() for p in s})
    words = [(n, w, np.bitwise_or.reduce([np.uint64(1) << np.uint64(p % 64) for p in leaves[n] if p // 64 == w]).astype(np.int64)) for w, n in rows]
    batches = [pa.record_batch([pa.array(c) for c in ([x[0] for x in part], pa.array([x[1] for x in part], pa.int32()), [int(x[2]) for x in part])], ["exp_id", "word_idx", "word"]) for part in (words[:101], words[101:], words[:0])]
    monkeypatch.setattr(minhash, "LANES", 100)
    monkeypatch.setattr(minhash, "MOST", most)
    hashed, plain = [], minhash._md5_block
    monkeypatch.setattr(minhash, "_md5_block", lambda text: hashed.append(len(text)) or plain(text))
    got = {}
    for b in minhash._md5_minima(12)(iter(batches)):
        for r in b.to_pylist():
            got[r["exp_id"], r["hash_ix"]] = min(r["val"], got.get((r["exp_id"], r["hash_ix"]), 1 << 62))
    value = lambda slot, p: int(hashlib.md5(f"{slot}:{p}".encode()).hexdigest()[:15], 16)
    assert got == {(n, i): min(value(i, p) for p in s) for n, s in leaves.items() for i in range(12)}
    assert sum(hashed) <= 12 * (len(set().union(*map(set, leaves.values()))) + 64)
    bits = spark.createDataFrame([(n, int(p)) for n, s in leaves.items() for p in s], "exp_id string, pos long")
    assert {(r.exp_id, r.hash_ix): r.val for r in minhash.sketches(bits, 12, "md5").collect()} == got


def test_linear_sketches_need_no_distinct_positions(spark):
    """Positions that repeat give the same sketches, and none of them is shuffled: one aggregate is left."""
    reads = spark.createDataFrame([(f"e{i % 3}", "ACGTTGCA" * 9 + "ACCGT" * i) for i in range(9)] + [("e1", None), (None, "ACGT" * 9)], "exp_id string, seq string")
    spec = HashSpec(k=12, m=512)
    sketch = [minhash.sketches(filters.filter_bits(reads, spec, 1, distinct=d), 8) for d in (True, False)]
    plan = sketch[1]._jdf.queryExecution().executedPlan().toString()  # as planned: a run would add the final plan
    a, b = (sorted(map(tuple, x.collect())) for x in sketch)
    assert a == b and len(a) == 24
    assert plan.count("Exchange hashpartitioning(") == 1


@pytest.mark.parametrize("m", [1, 700, 1 << 16, 1 << 27])
def test_packed_reads_are_those_of_rows(spark, monkeypatch, m):
    """Packed filters by frames against rows of positions, with frames of few positions, batches of few words, offsets of
    under and over two bytes, one hash and three."""
    monkeypatch.setattr(frames, "MOST", 500)
    monkeypatch.setattr(frames, "WORDS", 50)
    rng = np.random.default_rng(m)
    text = lambda n: np.frombuffer(b"ACGTN", np.uint8)[rng.choice(5, n, p=[0.245] * 4 + [0.02])].tobytes().decode()
    rows = [(f"e{i % 4}", text(n)) for i, n in enumerate([0, 3, 19, 20, 400, 900, 2500, 900])]
    reads = spark.createDataFrame(rows + rows[5:7] + [("e0", None), (None, text(300)), ("none", "ACGT")], "exp_id string, seq string")
    for nh, cutoff, family in ((1, 1, "universal"), (3, 1, "universal"), (2, 2, "universal"), (2, 1, "xxhash64")):
        spec = HashSpec(k=20, nh=nh, m=m, family=family)
        want = sorted(map(tuple, filters.packed(filters.filter_bits(reads, spec, cutoff)).collect()))
        assert sorted(map(tuple, filters.filter_words(reads, spec, cutoff).collect())) == want and want
    first = lambda bits: sorted(map(tuple, filters.first_bits(bits, 7).collect()))
    assert first(filters.filter_words(reads, spec, 1)) == first(filters.filter_bits(reads, spec, 1))


def test_positions_travel_in_frames(spark):
    """Positions are neither rows nor shuffled as rows: four million letters are a frame an experiment and block."""
    data = np.frombuffer(b"ACGT", np.uint8)[np.random.default_rng(3).integers(0, 4, 4_000_000)].tobytes().decode()
    batches = lambda: iter([pa.record_batch([pa.array(["a", "b"]), pa.array([data[:2_000_000], data[2_000_000:]])], ["exp_id", "seq"])])
    spec, got = HashSpec(k=20, m=1 << 22), []
    bits = frames.block_bits(spec.m)
    assert peak(lambda: got.extend(frames.framed(kmers.placed(batches(), spec), bits))) < 200
    held = sum(b.nbytes for b in got)
    assert sum(len(b) for b in got) <= 2 * 2 * frames.BLOCKS and held < 2.2 * 4_000_000
    words = []
    assert peak(lambda: words.extend(frames._worded(bits)(iter([pa.concat_batches(got).sort_by([("block", "ascending"), ("exp_id", "ascending")])])))) < 64
    ones = sum(int(np.bitwise_count(np.asarray(b.column(2)).view(np.uint64)).sum()) for b in words)
    assert ones == sum(len(set(frames_of.tolist())) for frames_of in (np.concatenate([p for e, r, p in kmers.placed(iter([next(batches()).slice(i, 1)]), spec)]) for i in range(2)))


def test_sieve_drops_what_no_query_asks(spark):
    """Positions and k-mers that nobody asks for stay in Python; the answers are those without a sieve."""
    rng = np.random.default_rng(7)
    data = np.frombuffer(b"ACGT", np.uint8)[rng.integers(0, 4, 60_000)].tobytes().decode()
    reads = spark.createDataFrame([("a", data), ("b", data[30_000:] + data[:100]), ("c", "ACGT" * 30), (None, data)], "exp_id string, seq string")
    asked = spark.createDataFrame([(data[500:900],), (data[40_000:40_300],), ("ACGT" * 30,)], "seq string")
    want = kmers.windows(asked, "seq", 20).select("kmer")
    only = want.select(F.explode(kmers.positions(F.col("kmer"), HashSpec(k=20, nh=2, m=1 << 25))).alias("pos"))
    spec = HashSpec(k=20, nh=2, m=1 << 25)
    flat = filters.filter_bits(reads, spec, 1).join(only.distinct(), "pos", "left_semi").select("exp_id", "pos")
    assert sorted(map(tuple, filters.filter_bits(reads, spec, 1, only).collect())) == sorted(map(tuple, flat.collect()))
    near = kmers.near_positions(reads, spec, kmers.position_sieve(only)).count()
    assert flat.count() <= near < 4_000
    every = filters.kmer_counts(reads, 20).join(want.distinct(), "kmer", "left_semi").select("exp_id", "kmer", "n")
    assert sorted(map(tuple, filters.kmer_counts(reads, 20, want).select("exp_id", "kmer", "n").collect())) == sorted(map(tuple, every.collect()))
    assert every.count() <= kmers.counted(reads, 20, kmers.kmer_sieve(want)).count() < 4_000


def test_xorshift_of_packed_filters_is_that_of_positions(spark):
    rng = np.random.default_rng(9)
    bits = spark.createDataFrame([(f"e{i}", int(p)) for i in range(4) for p in np.flatnonzero(rng.random(3000) < 0.2 * i)], "exp_id string, pos long")
    got = [sorted(map(tuple, minhash.sketches(b, 12, "xorshift").collect())) for b in (bits, filters.packed(bits))]
    assert got[0] == got[1] and len(got[0]) == 36


@pytest.mark.parametrize("m", [50, 1000, 1 << 14])
def test_stored_filters_are_packed(spark, tmp_path, m):
    """An index has a row a word, whatever its parts, and answers as rows of positions do; filters come back from nodes."""
    reads = spark.createDataFrame([(f"e{i % 5}", "ACGTTGCAAG" * 3 + "ACCGT" * (i % 7) + "TTGAC" * (i % 4)) for i in range(20)], "exp_id string, seq string")
    spec = HashSpec(k=11, nh=2, m=m, parts=8)
    flat = filters.filter_bits(reads, spec, 1)
    index = Index.create(reads, spec, str(tmp_path / "i"), 1)
    assert index.packs.count() == filters.packed(flat).count() < flat.count()
    assert sorted(map(tuple, index.bits.select("exp_id", "pos").collect())) == sorted(map(tuple, flat.collect()))
    q = spark.createDataFrame([("q", "ACGTTGCAAGACG", 0.3), ("r", "TTGACTTGACTTGAC", 0.9)], "query_id string, seq string, theta float")
    want = sorted(map(tuple, query.threshold_query(q, flat, spec).collect()))
    assert all(sorted(map(tuple, query.threshold_query(q, i, spec).collect())) == want for i in (index.packs, index.bits, filters.packed(flat))) and want
    index.build(tree.balanced([f"e{i}" for i in range(5)])).compress()
    assert sorted(map(tuple, tree.rebuilt(index.tree, index.words).collect())) == sorted(map(tuple, flat.collect()))


def test_words_as_dealt_need_no_shuffle(spark, monkeypatch):
    """Pairs, nodes, siblings and sketches of packed filters as they are dealt, against those of rows of positions."""
    monkeypatch.setattr(filters, "PAIR_ROWS", 40)
    monkeypatch.setattr(filters, "PAIR_WORDS", 3)
    rng = np.random.default_rng(11)
    text = lambda n: np.frombuffer(b"ACGT", np.uint8)[rng.integers(0, 4, n)].tobytes().decode()
    reads = spark.createDataFrame([(f"e{i % 7}", text(300)) for i in range(21)] + [("e9", "ACGT" * 9)], "exp_id string, seq string")
    spec = HashSpec(k=12, m=3000)
    flat, packs = filters.filter_bits(reads, spec, 1), filters.filter_words(reads, spec, 1)
    rows = lambda df: sorted(map(tuple, df.collect()))
    assert rows(filters.pair_counts(packs, dealt=True)) == rows(filters.pair_counts(flat)) and filters.pair_counts(flat).count() == 28
    held = {e: {r.pos for r in flat.collect() if r.exp_id == e} for e in [*(f"e{i}" for i in range(7)), "e9"]}
    assert {(r.a, r.b): (r.n1, r.n2, r.n12) for r in filters.pair_counts(packs, True).collect()} == {(a, b): (len(x), len(y), len(x & y)) for a, x in held.items() for b, y in held.items() if a < b}
    t = tree.tree_table(spark, tree.balanced(sorted(held)))
    nodes = tree.node_words(t, flat)
    assert rows(tree.node_words(t, packs, dealt=True)) == rows(nodes)
    kids = t.where("parent_id IS NOT NULL").groupBy("parent_id").agg(*(F.max(F.when(F.col("child_ix") == i, F.col("node_id"))).alias(c) for i, c in enumerate("ab"))).select("a", "b")
    assert rows(tree.sibling_counts(t, packs, dealt=True).select("a", "b", *filters.SPLIT)) == rows(filters.split_pair_counts(kids, nodes).select("a", "b", *filters.SPLIT))
    assert rows(minhash.sketches(packs, 8, "md5", dealt=True)) == rows(minhash.sketches(flat, 8, "md5"))
    with pytest.raises(Exception, match="dealt and in order"):
        tree.node_words(t, filters.packed(flat).coalesce(1).orderBy(F.desc("word_idx")), dealt=True).collect()


def test_first_bits_of_dealt_filters_pass_on_few_words(spark, monkeypatch):
    """Of filters in the order of word a task passes on n words an experiment, over batches that cut a word and an experiment."""
    rng = np.random.default_rng(7)
    rows = [(f"e{e}", w, int(rng.integers(1, 1 << 62))) for w in range(60) for e in range(5) if rng.random() < (e + 1) / 6]
    batch = lambda part: pa.record_batch([pa.array([r[0] for r in part], pa.string()), pa.array([r[1] for r in part], pa.int32()), pa.array([r[2] for r in part], pa.int64())], ["exp_id", "word_idx", "word"])
    got = [tuple(r.values()) for b in filters._first_words(4)(iter([batch(rows[:37]), batch([]), batch(rows[37:90]), batch(rows[90:])])) for r in b.to_pylist()]
    assert got == [r for i, r in enumerate(rows) if sum(q[0] == r[0] for q in rows[:i]) < 4]
    reads = spark.createDataFrame([(f"e{i % 3}", "".join("ACGT"[j] for j in rng.integers(0, 4, 3000))) for i in range(9)], "exp_id string, seq string")
    spec = HashSpec(k=20, m=1 << 16)
    monkeypatch.setattr(frames, "WORDS", 50)
    words = filters.filter_words(reads, spec, 1)
    first = lambda **how: sorted(map(tuple, filters.first_bits(words, 30, **how).collect()))
    assert first(dealt=True) == first() and len(first()) == 90


def test_dealt_filters_are_stored_without_another_shuffle(spark, monkeypatch, tmp_path):
    """Tasks that make an index's words write them; parts, order in files and words are as by ranges."""
    rng = np.random.default_rng(8)
    reads = spark.createDataFrame([(f"e{i % 3}", "".join("ACGT"[j] for j in rng.integers(0, 4, 2000))) for i in range(9)], "exp_id string, seq string")
    spec = HashSpec(k=20, m=1 << 15, parts=8)
    ranged = Index.of(filters.filter_words(reads, spec, 1), spec, f"{tmp_path}/a").packs
    want = sorted(map(tuple, ranged.select("exp_id", "word_idx", "word", "part").collect()))
    monkeypatch.setattr(type(reads), "repartitionByRange", lambda *a: pytest.fail("filters are dealt anew"))
    packs = Index.create(reads, spec, f"{tmp_path}/b", cutoff=1).packs
    assert sorted(map(tuple, packs.select("exp_id", "word_idx", "word", "part").collect())) == want and want
    in_files = {}
    for r in packs.select(F.input_file_name().alias("f"), "word_idx", "exp_id").collect():
        in_files.setdefault(r.f, []).append((r.word_idx, r.exp_id))
    assert all(rows == sorted(rows) for rows in in_files.values())


def test_roundtrip_counts_by_word(spark):
    """Filters, what nodes give back and what both have, against sets of positions; a node that lost bits, and one with bits of no filter."""
    rng = np.random.default_rng(9)
    rows = [(f"e{i}", int(p)) for i in range(5) for p in np.flatnonzero(rng.random(900) < 0.4)] + [("e5", 63)]
    bits = spark.createDataFrame(rows, "exp_id string, pos long")
    t = tree.tree_table(spark, tree.balanced([f"e{i}" for i in range(6)]))
    words = tree.node_words(t, bits)
    hurt = words.withColumn("sim", F.when(F.col("node_id") == "e0", F.col("sim").bitwiseAND(F.lit(-256).cast("long"))).when(F.col("node_id") == "e5", F.lit(5).cast("long")).otherwise(F.col("sim")))
    have = {n: {p for e, p in rows if e == n} for n in (f"e{i}" for i in range(6))}
    for w in (words, hurt):
        back = {n: set() for n in have}
        for r in tree.rebuilt(t, w).collect():
            back[r.exp_id].add(r.pos)
        assert {r.exp_id: (r.ones, r.rebuilt, r.same) for r in tree.roundtrip(t, w, bits).collect()} == {n: (len(have[n]), len(back[n]), len(have[n] & back[n])) for n in have}
    assert back != have


def dealt_case(spark, seed):
    """(filters as rows of positions, the same dealt, a topology, two experiments of which are not in the filters or not in it)."""
    rng = np.random.default_rng(seed)
    text = lambda n: np.frombuffer(b"ACGT", np.uint8)[rng.integers(0, 4, n)].tobytes().decode()
    reads = spark.createDataFrame([(f"e{i % 5}", text(400)) for i in range(15)] + [("e9", "ACGT" * 9), ("x", text(50)), (None, text(90))], "exp_id string, seq string")
    spec = HashSpec(k=12, m=5000)
    t = tree.tree_table(spark, tree.balanced(["e0", "e1", "e2", "e3", "e4", "e9", "none"]))
    return filters.filter_bits(reads, spec, 1), filters.filters_dealt(reads, spec, 1), t


def test_pairs_are_counted_where_words_are_made(spark, monkeypatch):
    """Words of dealt filters are no rows: one Python step makes and counts them."""
    flat, dealt, _ = dealt_case(spark, 21)
    monkeypatch.setattr(type(dealt), "words", lambda self: pytest.fail("words are rows"))
    rows = lambda df: sorted(map(tuple, df.collect()))
    assert rows(filters.pair_counts(dealt)) == rows(filters.pair_counts(flat)) and filters.pair_counts(dealt).count() == 21
    assert rows(filters.first_bits(dealt, 9)) == rows(filters.first_bits(flat, 9))
    plan = dealt.through(filters._pairs, "a string, b string, n long")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 2


def test_nodes_of_one_kind_and_their_counts_are_made_with_the_words(spark, monkeypatch):
    """Rows of the kind that is not asked for never leave Python, in batches of few rows; experiments that the topology lacks, and
    leaves without a filter."""
    flat, dealt, t = dealt_case(spark, 22)
    monkeypatch.setattr(type(dealt), "words", lambda self: pytest.fail("words are rows"))
    monkeypatch.setattr(tree, "ROWS", 7)
    rows = lambda df: sorted(map(tuple, df.collect()))
    nodes = tree.node_words(t, flat).cache()
    assert rows(tree.node_words(t, dealt)) == rows(nodes)
    for kind in ("sim", "dif"):
        got = tree.node_words(t, dealt, kinds=(kind,))
        assert got.where(f"{kind} = 0").isEmpty() and rows(got) == rows(nodes.where(f"{kind} <> 0").select("node_id", "word_idx", kind)) != []


def test_sizes_are_counted_where_nodes_are_made(spark, monkeypatch):
    """Neither the filters' nor the nodes' words are rows; a node without a bit still has its size."""
    flat, dealt, t = dealt_case(spark, 23)
    monkeypatch.setattr(type(dealt), "words", lambda self: pytest.fail("words are rows"))
    rows = lambda df: sorted(map(tuple, df.collect()))
    ones = tree.node_ones(t, dealt)
    assert ones._jdf.queryExecution().executedPlan().toString().count("MapInArrow") == 2
    assert rows(tree.sizes_of(t, ones, 5000)) == rows(tree.node_sizes(t, tree.node_words(t, flat), 5000))
    assert tree.sizes_of(t, ones, 5000).count() == 13


def test_pairs_of_a_stored_index_make_no_nodes(spark, tmp_path, monkeypatch):
    """What reads the filters of an index alone has no nodes written; the first query that needs them writes them, once."""
    from kmerloom.plans import catalogue

    rng = np.random.default_rng(25)
    text = lambda n: "".join("abcdefgh"[j] for j in rng.integers(0, 8, n))
    spark.createDataFrame([(i, f"s{i % 3}", text(90)) for i in range(9)], "doc_id long, source string, text string").write.parquet(f"{tmp_path}/documents.parquet")
    written, write = [], Index.compress
    monkeypatch.setattr(Index, "compress", lambda self: written.append(self.path) or write(self))
    got = catalogue.QUERIES["index_similarity"](spark, str(tmp_path)).count()
    assert got == 3 and not written
    assert all(catalogue.QUERIES["leaf_roundtrip"](spark, str(tmp_path)).where("ones = same").count() == 3 for _ in range(2))
    assert catalogue.QUERIES["index_similarity"](spark, str(tmp_path)).count() == 3 and len(written) == 1


def test_minima_hold_few_rows_of_a_large_batch():
    """A batch of 65,536 rows of twenty full filters, all of whose positions may be least at first."""
    n = 1 << 16
    batch = pa.record_batch([pa.array(np.array([f"e{i}" for i in range(20)], object)[np.arange(n) % 20], pa.string()), pa.array((np.arange(n) // 20).astype(np.int32)), pa.array(np.full(n, -1, np.int64))], ["exp_id", "word_idx", "word"])
    values, got = lambda pos: minhash._xorshift_values(2, 0, minhash.SHIFTS, pos), []
    assert peak(lambda: got.extend(minhash._word_minima(2, values)(iter([batch])))) < 100
    pos = np.arange((n // 20) * 64)
    want = [int(v.min()) for v in values(pos)]
    assert [r["val"] for b in got for r in b.to_pylist() if r["exp_id"] == "e19"] == want


def test_siblings_are_counted_where_words_are_made(spark, monkeypatch):
    flat, dealt, t = dealt_case(spark, 24)
    monkeypatch.setattr(type(dealt), "words", lambda self: pytest.fail("words are rows"))
    rows = lambda df: sorted(map(tuple, df.select("a", "b", *filters.SPLIT).collect()))
    kids = t.where("parent_id IS NOT NULL").groupBy("parent_id").agg(*(F.max(F.when(F.col("child_ix") == i, F.col("node_id"))).alias(c) for i, c in enumerate("ab"))).select("a", "b")
    got = tree.sibling_counts(t, dealt)
    assert got._jdf.queryExecution().executedPlan().toString().count("MapInArrow") == 2
    assert rows(got) == rows(filters.split_pair_counts(kids, tree.node_words(t, flat))) != []
