"""Filters of experiments: counting, building, packing, set operations and similarity.

A filter is sparse, rows (exp_id, pos), or packed, rows (exp_id, word_idx, word) of 64 bits. Null experiments and null
sequences are left out. Every aggregate combines before its shuffle, so a very large experiment is no hot key.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from kmerloom.functions.kmers import canonical, counted, kmer_sieve, near_positions, position_sieve, positions
from kmerloom.operators.frames import Dealt, packed_positions, packed_reads
from kmerloom.operators.minimizers import counted_by_minimizer
from kmerloom.plans.shared import stored
from kmerloom.plans.spec import LONG_K, HashSpec

#: Rows of packed filters that a count of pairs gathers, and words that it holds of all filters at once.
PAIR_ROWS, PAIR_WORDS = 1 << 18, 1 << 11


#: Bit counts of a pair of split nodes.
SPLIT = ("s1s2", "d1s2", "d1_xor_s2", "d1_xor_s1", "differ", "union_xor", "union_or")


def kmer_counts(reads: DataFrame, k: int, only: DataFrame | None = None) -> DataFrame:
    """(exp_id, kmer, n): occurrences of canonical k-mers in reads (exp_id, seq).

    only: a table with a column kmer; other k-mers are dropped before the aggregate, nearly all of them by a sieve of fixed
    size before they leave Python, so they take part in no shuffle. Without it, and for k-mers that are longs, reads travel as
    super-k-mers and are counted by minimizer.
    """
    if only is None and k <= LONG_K:
        return counted_by_minimizer(reads, k)
    rows = counted(reads, k, kmer_sieve(only) if only is not None and k <= LONG_K else None)
    if only is not None:
        rows = rows.join(only.select("kmer").distinct(), "kmer", "left_semi")
    return rows.groupBy("exp_id", "kmer").agg(F.sum("n").alias("n"))


def solid_kmers(reads: DataFrame, k: int, cutoff: int = 3, only: DataFrame | None = None) -> DataFrame:
    """(exp_id, kmer, n) of k-mers that occur at least cutoff times in their experiment."""
    return kmer_counts(reads, k, only).where(F.col("n") >= cutoff)


def filter_bits(reads: DataFrame, spec: HashSpec, cutoff: int = 3, only: DataFrame | None = None, distinct: bool = True) -> DataFrame:
    """(exp_id, pos): set positions of each experiment's filter; only: a table with the positions (pos) that matter.

    Without a cut-off k-mers need not be counted: positions are made distinct directly, or, with distinct=False, not at
    all, for what takes a least or greatest one and so needs no shuffle of positions.
    """
    if only is not None and cutoff <= 1 and spec.family == "universal":
        bits = near_positions(reads, spec, position_sieve(only)).join(only.select("pos").distinct(), "pos", "left_semi").select("exp_id", "pos")
        return bits.distinct() if distinct else bits
    return bits_of(solid_kmers(reads, spec.k, cutoff) if cutoff > 1 else canonical(reads, spec.k), spec, only, distinct)


def bits_of(kmers: DataFrame, spec: HashSpec, only: DataFrame | None = None, distinct: bool = True) -> DataFrame:
    bits = kmers.select("exp_id", F.explode(positions(F.col("kmer"), spec)).alias("pos"))
    if only is not None:
        bits = bits.join(only.select("pos").distinct(), "pos", "left_semi").select("exp_id", "pos")
    return bits.distinct() if distinct else bits


def filter_words(reads: DataFrame, spec: HashSpec, cutoff: int = 3) -> DataFrame:
    """(exp_id, word_idx, word): each experiment's filter, packed."""
    return filters_dealt(reads, spec, cutoff).words()


def filters_dealt(reads: DataFrame, spec: HashSpec, cutoff: int = 3) -> Dealt:
    """The same for what goes through filters word by word: words are not rows. Positions travel in frames, two bytes or
    three each, and are never rows where hashes are universal and there is no cut-off."""
    if cutoff <= 1 and spec.family == "universal":
        return packed_reads(reads, spec)
    return packed_positions(bits_of(solid_kmers(reads, spec.k, cutoff) if cutoff > 1 else canonical(reads, spec.k), spec, distinct=False), spec.m)


def part_of(pos: Column, spec: HashSpec) -> Column:
    """The range of positions that an index stores a position in."""
    return F.floor(pos / spec.span).cast("int")


def first_of(word_idx: Column) -> Column:
    """The first position of a word."""
    return word_idx.cast("long") * 64


def packed(bits: DataFrame) -> DataFrame:
    """(exp_id, word_idx, word): 64 positions a word, bit pos % 64. Filters that are packed stay as they are."""
    if "word" in bits.columns:
        return bits.select("exp_id", "word_idx", "word")
    word = F.expr("bit_or(shiftleft(1L, cast(pos % 64 as int)))")
    return bits.groupBy("exp_id", F.floor(F.col("pos") / 64).cast("int").alias("word_idx")).agg(word.alias("word"))


def by_word(bits: DataFrame | Dealt, dealt: bool = False) -> Dealt:
    """Filters dealt by word. dealt: packed ones as filter_words() deals them, which need no shuffle."""
    if isinstance(bits, Dealt):
        return bits
    words = packed(bits)
    return Dealt(words if dealt else words.repartition("word_idx").sortWithinPartitions("word_idx"))


def unpacked(words: DataFrame, *keep: str) -> DataFrame:
    """The sparse form of packed words, with other columns that are to be kept."""
    bit = F.filter(F.sequence(F.lit(0), F.lit(63)), lambda i: F.getbit(F.col("word"), i) == 1)
    return words.select("exp_id", F.explode(bit).alias("_b"), "word_idx", *keep).select("exp_id", (first_of(F.col("word_idx")) + F.col("_b")).alias("pos"), *keep)


def popcounts(words: DataFrame) -> DataFrame:
    """(exp_id, ones) of packed words."""
    return words.groupBy("exp_id").agg(F.sum(F.bit_count("word")).cast("long").alias("ones"))


def combined(words: DataFrame, a: str, b: str, how: str) -> DataFrame:
    """(word_idx, word) of two packed filters combined by union, intersect or xor; zero words are left out."""
    ops = {"union": lambda x, y: x.bitwiseOR(y), "intersect": lambda x, y: x.bitwiseAND(y), "xor": lambda x, y: x.bitwiseXOR(y)}
    side = lambda e, c: F.coalesce(F.max(F.when(F.col("exp_id") == e, F.col("word"))), F.lit(0)).alias(c)
    both = words.where(F.col("exp_id").isin(a, b)).groupBy("word_idx").agg(side(a, "x"), side(b, "y"))
    return both.select("word_idx", ops[how](F.col("x"), F.col("y")).alias("word")).where("word <> 0")


def _pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Packed filters in the order of word_idx to (a, b, n) of a task: common positions of pairs a < b, and own ones, a = b."""
    at: dict[str, int] = {}
    total, held = np.zeros((0, 0), np.int64), []

    def put(place, exp, word):
        first = np.append(True, place[1:] != place[:-1])
        of = np.cumsum(first) - 1
        n = len(at)
        for lo in range(0, int(of[-1]) + 1, PAIR_WORDS):
            mine = slice(*np.searchsorted(of, [lo, lo + PAIR_WORDS]))
            wide = np.zeros((n, PAIR_WORDS), np.uint64)
            wide[exp[mine], of[mine] - lo] = word[mine].view(np.uint64)
            for i in range(n):
                total[i, i:n] += np.bitwise_count(wide[i] & wide[i:]).sum(axis=1, dtype=np.int64)

    for batch in batches:
        if not len(batch):
            continue
        names = batch.column(0).dictionary_encode()
        ids = np.array([at.setdefault(x, len(at)) for x in names.dictionary.to_pylist()], np.int64)
        if len(at) > len(total):
            total = np.pad(total, (0, 2 * len(at) - len(total)))
        held.append((np.asarray(batch.column(1)), ids[np.asarray(names.indices)], np.asarray(batch.column(2))))
        if sum(len(p) for p, _, _ in held) < PAIR_ROWS:
            continue
        place, exp, word = (np.concatenate(x) for x in zip(*held))
        cut = int(np.searchsorted(place, place[-1]))  # the last word may go on
        if cut:
            put(place[:cut], exp[:cut], word[:cut])
        held = [(place[cut:], exp[cut:], word[cut:])]
    if held:
        put(*(np.concatenate(x) for x in zip(*held)))
    i, j = np.nonzero(total)
    name, n = np.array(list(at), object), total[i, j]
    x, y = name[i], name[j]
    yield pa.record_batch([pa.array(np.minimum(x, y), pa.string()), pa.array(np.maximum(x, y), pa.string()), pa.array(n)], ["a", "b", "n"])


def pair_counts(bits: DataFrame | Dealt, dealt: bool = False) -> DataFrame:
    """(a, b, n1, n2, n12) for every pair a < b of experiments: own and common positions.

    Filters are packed and meet by word, where a task counts for all pairs at once, so that pairs of words are never rows;
    pairs without common positions have a row, with n12 = 0. The result is a row a pair by definition. dealt: packed
    filters as filter_words() deals them, which need no shuffle.
    """
    rows = by_word(bits, dealt).through(_pairs, "a string, b string, n long")
    counts = stored(rows.groupBy("a", "b").agg(F.sum("n").alias("n")))
    ones = counts.where("a = b").select("a", "n")
    common = counts.where("a < b").withColumnRenamed("n", "n12")
    pairs = ones.toDF("a", "n1").join(ones.toDF("b", "n2"), F.col("a") < F.col("b"))
    return pairs.join(common, ["a", "b"], "left").fillna(0, ["n12"]).select("a", "b", "n1", "n2", "n12")


def similarity(bits: DataFrame | Dealt, m: int, kind: int = 1, dealt: bool = False) -> DataFrame:
    """(a, b, n12, n_or, sim) of plain filters: kind 0 is m less the differing bits, 1 is Jaccard scaled to m in float32.

    The Jaccard of two empty filters is null.
    """
    c = pair_counts(bits, dealt).withColumn("n_or", F.col("n1") + F.col("n2") - F.col("n12"))
    if kind == 0:
        sim = m - (F.col("n_or") - F.col("n12"))
    elif kind == 1:
        ratio = (F.col("n12").cast("float") / F.col("n_or").cast("float")).cast("float")
        sim = F.floor((ratio * F.lit(m).cast("float")).cast("float")).cast("long")
    else:
        raise ValueError(f"no similarity of plain filters of kind {kind}")
    return c.select("a", "b", "n12", "n_or", sim.cast("long").alias("sim"))


def split_similarity(pairs: DataFrame, m: int, kind: int, compat: bool = False) -> DataFrame:
    """(a, b, sim): similarity of split nodes from split_pair_counts.

    kind 0: m less the bits in which the nodes' unions of sim and dif differ; kind 1: bits of any of the four less those
    of (s1 xor s2) or (d1 xor d2), over the former, in float32 and scaled to m, null without bits; kind 2: common sim bits
    times m if there are any, else m less the bits of d1 xor s2 (compat: d1 xor s1); kind 3: bits of s1 and s2 plus bits
    of d1 and s2; kind -1: m less the bits of (s1 xor s2) or (d1 xor d2).
    """
    if kind == 0:
        sim = m - F.col("union_xor")
    elif kind == 1:
        ratio = ((F.col("union_or") - F.col("differ")).cast("float") / F.nullif(F.col("union_or"), F.lit(0)).cast("float")).cast("float")
        sim = F.floor((ratio * F.lit(m).cast("float")).cast("float"))
    elif kind == 2:
        rest = F.col("d1_xor_s1" if compat else "d1_xor_s2")
        sim = F.when(F.col("s1s2") > 0, F.col("s1s2") * m).otherwise(m - rest)
    elif kind == 3:
        sim = F.col("s1s2") + F.col("d1s2")
    elif kind == -1:
        sim = m - F.col("differ")
    else:
        raise ValueError(f"no similarity of split nodes of kind {kind}")
    return pairs.select("a", "b", sim.cast("long").alias("sim"))


def split_pair_counts(pairs: DataFrame, words: DataFrame) -> DataFrame:
    """Bit counts for split_similarity: pairs (a, b) of nodes of node words (node_id, word_idx, sim, dif).

    Each pair's words are brought together, 64 positions a row; only the given pairs are joined.
    """
    word = lambda side, kind: F.coalesce(F.max(F.when(F.col("side") == side, F.col(kind))), F.lit(0).cast("long")).alias(f"{kind[0]}{side}")
    sides = [pairs.select("a", "b", F.col(c).alias("node_id"), F.lit(i).alias("side")) for i, c in ((1, "a"), (2, "b"))]
    both = sides[0].unionByName(sides[1]).join(words, "node_id")
    at = both.groupBy("a", "b", "word_idx").agg(word(1, "sim"), word(2, "sim"), word(1, "dif"), word(2, "dif"))
    s1, s2, d1, d2 = (F.col(c) for c in ("s1", "s2", "d1", "d2"))
    ones = lambda c: F.sum(F.bit_count(c))
    return at.groupBy("a", "b").agg(
        ones(s1.bitwiseAND(s2)).alias("s1s2"),
        ones(d1.bitwiseAND(s2)).alias("d1s2"),
        ones(d1.bitwiseXOR(s2)).alias("d1_xor_s2"),
        ones(d1.bitwiseXOR(s1)).alias("d1_xor_s1"),
        ones(s1.bitwiseXOR(s2).bitwiseOR(d1.bitwiseXOR(d2))).alias("differ"),
        ones(s1.bitwiseOR(d1).bitwiseXOR(s2.bitwiseOR(d2))).alias("union_xor"),
        ones(s1.bitwiseOR(d1).bitwiseOR(s2).bitwiseOR(d2)).alias("union_or"),
    )


def _first_words(n: int):
    """Packed filters in the order of word_idx to the first n words of each experiment of a task; batches are held one by one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[str, int] = {}
        for batch in batches:
            if not len(batch):
                continue
            exp = batch.column(0).dictionary_encode()
            x, names = np.asarray(exp.indices), exp.dictionary.to_pylist()
            order = np.argsort(x, kind="stable")
            size = np.bincount(x, minlength=len(names))
            before = np.array([seen.get(e, 0) for e in names], np.int64)
            rank = np.arange(len(x)) - np.repeat(np.cumsum(size) - size, size) + before[x[order]]
            seen.update(zip(names, (before + size).tolist()))
            kept = np.sort(order[rank < n])
            if len(kept):
                yield batch.take(pa.array(kept))

    return run


def first_bits(bits: DataFrame | Dealt, n: int = 100, dealt: bool = False) -> DataFrame:
    """(exp_id, rank, pos): the n smallest set positions of each filter; Spark limits the rank before the shuffle.

    Of a packed filter they are in its first n words. dealt: packed filters as filter_words() deals them, of which a task
    passes on n words an experiment and sorts none."""
    if isinstance(bits, Dealt) or "word" in bits.columns:
        nth = F.row_number().over(W.partitionBy("exp_id").orderBy("word_idx"))
        if isinstance(bits, Dealt):
            words = bits.through(_first_words(n), "exp_id string, word_idx int, word long")
        else:
            words = packed(bits).where("word <> 0")
            if dealt:
                words = words.mapInArrow(_first_words(n), "exp_id string, word_idx int, word long")
        bits = unpacked(words.withColumn("_n", nth).where(F.col("_n") <= n))
    rank = F.row_number().over(W.partitionBy("exp_id").orderBy("pos"))
    return bits.withColumn("rank", rank).where(F.col("rank") <= n).select("exp_id", "rank", "pos")


def contains(bits: DataFrame, kmers: DataFrame, spec: HashSpec) -> DataFrame:
    """(exp_id, kmer): experiments whose filter has all nh positions of a k-mer."""
    p = kmers.select("kmer").distinct().select("kmer", F.explode(F.array_distinct(positions(F.col("kmer"), spec))).alias("pos"))
    need = F.size(F.array_distinct(positions(F.col("kmer"), spec)))
    return p.join(bits, "pos").groupBy("exp_id", "kmer").agg(F.count("*").alias("n")).where(F.col("n") == need).select("exp_id", "kmer")


def at_least(hits: Column, total: Column, theta: Column, strict: bool = False) -> Column:
    """The threshold test in 32-bit floats: hits >= total * theta (strict: >)."""
    cut = total.cast("float") * theta.cast("float")
    return hits.cast("float") > cut if strict else hits.cast("float") >= cut
