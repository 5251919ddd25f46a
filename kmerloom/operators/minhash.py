"""Sketches of filters, distances between sketches, and the clusterings that plan a hierarchy.

A sketch has one minimum per hash slot over the set positions. Slots hash a position linearly modulo a prime,
with a keyed MD5, or with rounds of 64-bit xorshift. An empty filter has no sketch rows and distance 1 to all others.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from kmerloom.functions.kmers import PRIME
from kmerloom.operators.filters import by_word, unpacked
from kmerloom.operators.frames import Dealt
from kmerloom.plans.shared import stored

#: Full-period shift triples of 64-bit xorshift generators, from the published list; slots take them in turn.
SHIFTS = ((13, 7, 17), (12, 25, 27), (5, 15, 27), (17, 31, 8), (23, 17, 26), (21, 35, 4), (11, 29, 14), (9, 21, 40))
ROUNDS = 8
Shifts = tuple[tuple[int, int, int], ...]
#: Experiments that the clustering loop takes on the driver: its matrix has so many rows and columns.
MOST = 5000


#: Positions that MD5 takes at once: arrays of this length stay in a core's cache.
LANES = 1 << 14
#: Rows of packed filters whose positions are held against the minima at once.
ROWS = 1 << 13
_MD5_ADD = [int(abs(math.sin(i + 1)) * (1 << 32)) for i in range(64)]
_MD5_TURN = [t for four in ((7, 12, 17, 22), (5, 9, 14, 20), (4, 11, 16, 23), (6, 10, 15, 21)) for t in four * 4]
_MD5_START = (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476)


def _md5_block(text: np.ndarray) -> np.ndarray:
    """The first 60 bits of the MD5 of texts of one length, under 56 bytes: a row of bytes each."""
    n, length = text.shape
    block = np.zeros((n, 4 * (length // 4 + 1)), np.uint8)
    block[:, :length], block[:, length] = text, 0x80
    word = dict(enumerate(np.ascontiguousarray(block.view("<u4").T)))
    a, b, c, d = (np.full(n, x, np.uint32) for x in _MD5_START)
    for i in range(64):
        if i < 16:
            f, g = d ^ (b & (c ^ d)), i
        elif i < 32:
            f, g = c ^ (d & (b ^ c)), (5 * i + 1) % 16
        elif i < 48:
            f, g = b ^ c ^ d, (3 * i + 5) % 16
        else:
            f, g = c ^ (b | ~d), 7 * i % 16
        f += a
        f += np.uint32(_MD5_ADD[i] + (8 * length if g == 14 else 0) & 0xFFFFFFFF)
        if g in word:
            f += word[g]
        f = f << np.uint32(_MD5_TURN[i]) | f >> np.uint32(32 - _MD5_TURN[i])
        f += b
        a, b, c, d = d, f, b, c
    a += np.uint32(_MD5_START[0])
    b += np.uint32(_MD5_START[1])
    return (a.byteswap().astype(np.int64) << 28) | (b.byteswap() >> np.uint32(4)).astype(np.int64)


def _md5_values(slots: int, pos: np.ndarray) -> Iterator[np.ndarray]:
    """For one slot after another, the first 60 bits of MD5 of `slot:position`; positions rise."""
    runs = []
    cuts = np.searchsorted(pos, [0, *(10**i for i in range(1, 19)), np.iinfo(np.int64).max], side="left").tolist()
    cuts[-1] = len(pos)
    for digits, (lo, hi) in enumerate(zip(cuts, cuts[1:]), 1):
        for a in range(lo, hi, LANES):
            left, text = pos[a : min(a + LANES, hi)], np.empty((min(a + LANES, hi) - a, digits), np.uint8)
            for i in range(digits - 1, -1, -1):
                left, text[:, i] = left // 10, left % 10 + 48
            runs.append(text)
    for slot in range(slots):
        head = np.frombuffer(f"{slot}:".encode(), np.uint8)
        yield np.concatenate([_md5_block(np.hstack([np.broadcast_to(head, (len(t), len(head))), t])) for t in runs])


def _md5_minima(slots: int):
    return _word_minima(slots, lambda pos: _md5_values(slots, pos))


def _word_minima(slots: int, values):
    """Packed filters (exp_id, word_idx, word) in the order of word_idx to the minima of each experiment of a task; values
    gives those of rising positions for one slot after another. A position that many filters have is hashed once; of its
    values, those alone that may be a filter's least are held against the filters."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, best = {}, np.zeros((0, slots), np.int64)

        def put():
            low, names = best[: len(at)], pa.array(list(at), pa.string())
            rows = pa.array(np.repeat(np.arange(len(at)), slots))
            return pa.record_batch([names.take(rows), pa.array(np.tile(np.arange(slots, dtype=np.int32), len(at))), pa.array(low.ravel())], ["exp_id", "hash_ix", "val"])

        for batch in (b.slice(i, ROWS) for b in batches for i in range(0, len(b), ROWS)):
            names = batch.column(0).dictionary_encode()
            ids = np.array([at.setdefault(n, len(at)) for n in names.dictionary.to_pylist()])
            if len(at) > len(best):
                best = np.concatenate([best, np.full((len(at), slots), np.iinfo(np.int64).max)])
            exp, place, word = ids[np.asarray(names.indices)], np.asarray(batch.column(1)).astype(np.int64), np.asarray(batch.column(2))
            first = np.flatnonzero(np.append(True, place[1:] != place[:-1]))
            held = np.diff(np.append(first, len(place)))
            union = np.bitwise_or.reduceat(word, first).astype("<i8")
            of, bit = np.nonzero(np.unpackbits(union.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little"))
            for slot, value in enumerate(values(place[first][of] * 64 + bit)):
                near = np.flatnonzero(value < best[ids, slot].max())
                n = held[of[near]]
                row = np.repeat(first[of[near]] - np.cumsum(n) + n, n) + np.arange(n.sum())
                near = np.repeat(near, n)
                has = word[row] >> bit[near] & 1 == 1
                np.minimum.at(best[:, slot], exp[row[has]], value[near[has]])
            if len(at) > MOST:
                yield put()
                at, best = {}, best[:0]
        if at:
            yield put()

    return run


def _xorshift(slot: int, pos: np.ndarray, seed: int, shifts: Shifts) -> np.ndarray:
    x = pos ^ np.uint64((0x9E3779B97F4A7C15 * (slot + 1) ^ seed) & ((1 << 64) - 1))
    a, b, c = (np.uint64(s) for s in shifts[slot % len(shifts)])
    for _ in range(ROUNDS):
        x = x ^ x << a
        x = x ^ x >> b
        x = x ^ x << c
    return x


def _xorshift_minima(slots: int, seed: int, shifts: Shifts):
    """Per batch the minima of each experiment, signed with the top bit flipped: longs in the order of unsigned values."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not len(b):
                continue
            exp = b.column(0).dictionary_encode()
            order = np.argsort(np.asarray(exp.indices), kind="stable")
            ids, pos = np.asarray(exp.indices)[order], np.asarray(b.column(1)).astype(np.uint64)[order]
            at = np.flatnonzero(np.concatenate([[True], ids[1:] != ids[:-1]]))
            low = np.array([np.minimum.reduceat(_xorshift(s, pos, seed, shifts), at) for s in range(slots)]) ^ np.uint64(1 << 63)
            names = exp.dictionary.take(pa.array(np.tile(ids[at], slots)))
            yield pa.record_batch([names, pa.array(np.repeat(np.arange(slots, dtype=np.int32), len(at))), pa.array(low.ravel().view(np.int64))], ["exp_id", "hash_ix", "val"])

    return run


def _xorshift_values(slots: int, seed: int, shifts: Shifts, pos: np.ndarray) -> Iterator[np.ndarray]:
    """For one slot after another the values of positions, signed with the top bit flipped."""
    for slot in range(slots):
        yield (_xorshift(slot, pos.astype(np.uint64), seed, shifts) ^ np.uint64(1 << 63)).view(np.int64)


def coefficients(slots: int) -> list[tuple[int, int]]:
    """Factor and summand of each slot's linear hash modulo PRIME."""
    return [(pow(48271, 7 * s + 3, PRIME), pow(69621, 5 * s + 2, PRIME)) for s in range(slots)]


def sketches(bits: DataFrame | Dealt, slots: int = 100, family: str = "linear", seed: int = 0, shifts: Shifts = SHIFTS, dealt: bool = False) -> DataFrame:
    """(exp_id, hash_ix, val): the least hash of each slot over the filter's positions.

    linear: (pos * a + b) modulo a prime, with a and b of the slot; md5: of slot and position; xorshift: 64 bits, by the
    shift triples given, which slots take in turn. md5, and xorshift of packed filters, hash a position once for all
    filters of a task that have it; dealt: the filters are packed and dealt by word, as filter_words() does.
    """
    least = lambda minima: by_word(bits, dealt).through(minima, "exp_id string, hash_ix int, val long").groupBy("exp_id", "hash_ix").agg(F.min("val").alias("val"))
    if family == "xorshift" and (isinstance(bits, Dealt) or "word" in bits.columns):
        return least(_word_minima(slots, lambda pos: _xorshift_values(slots, seed, shifts, pos)))
    if family == "xorshift":
        rows = bits.select("exp_id", "pos").mapInArrow(_xorshift_minima(slots, seed, shifts), "exp_id string, hash_ix int, val long")
        return rows.groupBy("exp_id", "hash_ix").agg(F.min("val").alias("val"))
    if family == "md5":
        return least(_md5_minima(slots))
    bits = bits.words() if isinstance(bits, Dealt) else bits
    bits = unpacked(bits) if "word" in bits.columns else bits
    # one aggregate a slot: nothing is exploded
    values = [(F.col("pos") % PRIME * F.lit(a).cast("long") + b) % PRIME for a, b in coefficients(slots)]
    mins = bits.groupBy("exp_id").agg(*(F.min(v).alias(f"v{i}") for i, v in enumerate(values)))
    pairs = F.array(*(F.struct(F.lit(i).alias("hash_ix"), F.col(f"v{i}").alias("val")) for i in range(slots)))
    return mins.select("exp_id", F.explode(pairs).alias("s")).select("exp_id", "s.*")


def merged(sketch: DataFrame, groups: DataFrame) -> DataFrame:
    """Sketches of unions: groups (exp_id, node_id)."""
    return sketch.join(groups, "exp_id").groupBy("node_id", "hash_ix").agg(F.min("val").alias("val"))


def distances(sketch: DataFrame, names: DataFrame, slots: int) -> DataFrame:
    """(i, j, d) for every pair i > j of names (exp_id): 1 less the share of equal slots. Equal slots are an equi-join."""
    same = sketch.toDF("i", "hash_ix", "val").join(sketch.toDF("j", "hash_ix", "val"), ["hash_ix", "val"]).where("i > j")
    counts = same.groupBy("i", "j").agg(F.count("*").alias("k"))
    pairs = names.select(F.col("exp_id").alias("i")).join(names.select(F.col("exp_id").alias("j")), F.col("i") > F.col("j"))
    return pairs.join(counts, ["i", "j"], "left").select("i", "j", (1 - F.coalesce("k", F.lit(0)) / slots).alias("d"))


def closest(dist: DataFrame) -> DataFrame:
    """The closest pair; ties go to the first i, then the first j."""
    return dist.orderBy("d", "i", "j").limit(1)


#: Members of a band's bucket that meet under one key; a larger bucket is cut into blocks, at most so many, that meet two by
#: two.
HOT_BAND, BLOCKS = 1024, 32
#: Pairs that are held against each other at once, and that a batch of results has about.
PAIRS = 1 << 16
#: Share of the pairs at the stated similarity that a band's width must let through.
RECALL = 0.99


def band_rows(slots: int, least: float, recall: float = RECALL) -> int:
    """Slots of a band: as many as let pairs of similarity `least` share a band with probability `recall`."""
    rows = 1
    while 2 * rows <= slots and 1 - (1 - least ** (2 * rows)) ** (slots // (2 * rows)) >= recall:
        rows *= 2
    return rows


def _agreeing(slots: int, rows: int, need: float):
    """Members of bands' buckets (exp_id, band, sketch, key, p, q, second), in the order of key, p, q and second, to the pairs
    (x, y, same) that agree in `need` slots at least, each from the first band that it has in common."""

    def pairs(members: pa.Table) -> Iterator[pa.RecordBatch]:
        n, done, found = len(members), [], 0
        names, band, second = members["exp_id"].combine_chunks(), np.asarray(members["band"]), np.asarray(members["second"])
        vals = pc.list_flatten(members["sketch"]).combine_chunks()
        has = np.ascontiguousarray(np.asarray(vals.is_valid()).reshape(n, slots).T) if vals.null_count else None
        vals = np.ascontiguousarray(np.asarray(vals.fill_null(0)).reshape(n, slots).T)
        key, p, q = (np.asarray(members[c]) for c in ("key", "p", "q"))
        first = np.flatnonzero(np.append(True, (key[1:] != key[:-1]) | (p[1:] != p[:-1]) | (q[1:] != q[:-1])))
        size = np.diff(np.append(first, n))
        end = np.repeat(first + size, size)
        # a member of a block meets those after it; one of the first block of two, those of the second
        begin = np.where(p == q, np.arange(n) + 1, np.where(second, end, np.repeat(first + np.add.reduceat(~second, first, dtype=np.int64), size)))

        def put() -> pa.RecordBatch:
            a, b, same = (np.concatenate(c) for c in zip(*done))
            done.clear()
            return pa.record_batch([names.take(pa.array(a)), names.take(pa.array(b)), pa.array(same)], ["x", "y", "same"])

        x = np.flatnonzero(begin < end)
        y = begin[x]
        while len(x):
            for i in range(0, len(x), PAIRS):
                a, b = x[i : i + PAIRS], y[i : i + PAIRS]
                equal = vals[:, a] == vals[:, b]
                if has is not None:
                    equal &= has[:, a] & has[:, b]
                same = equal.sum(0)
                near = np.flatnonzero(same >= need)
                equal = equal[: slots // rows * rows, near]
                common = equal[::rows]
                for j in range(1, rows):
                    common = common & equal[j::rows]
                near = near[common.any(0) & (common.argmax(0) == band[a[near]]) & (band[a[near]] == band[b[near]])]
                if len(near):
                    done.append((a[near], b[near], same[near]))
                    found += len(near)
                if found >= PAIRS:
                    yield put()
                    found = 0
            on = y + 1 < end[x]
            x, y = x[on], y[on] + 1
        if done:
            yield put()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, last = [], None  # members under the key that may go on
        for batch in batches:
            if not len(batch):
                continue
            cols = [np.asarray(batch.column(c)) for c in ("key", "p", "q")]
            now = tuple(int(c[-1]) for c in cols)
            before = np.flatnonzero(np.any([c != x for c, x in zip(cols, now)], axis=0))
            cut = int(before[-1]) + 1 if len(before) else 0
            if held and (cut or now != last):
                yield from pairs(pa.Table.from_batches([*held, batch.slice(0, cut)]))
                held = []
            elif cut:
                yield from pairs(pa.Table.from_batches([batch.slice(0, cut)]))
            held.append(batch.slice(cut))
            last = now
        if held:
            yield from pairs(pa.Table.from_batches(held))

    return run


def banded_pairs(sketch: DataFrame, slots: int, least: float, rows: int | None = None, hot: int = HOT_BAND) -> DataFrame:
    """(i, j, same) for pairs i > j of sketches that share a band of `rows` slots and agree in at least least * slots.

    A sketch travels whole to the buckets of its bands, where pairs are held against each other and those that agree leave
    the task: what is shuffled grows with the sketches, and no pair is. Buckets of more than `hot` members, such as copies
    make, are cut into blocks by hash, and every two blocks meet under a key of their own, so a frequent band is spread over
    the tasks; a member is repeated BLOCKS times at most. A slot that a sketch has not is equal to none.
    """
    rows = rows or band_rows(slots, least)
    vals = [F.col(f"v{i}") for i in range(slots)]
    whole = sketch.groupBy("exp_id").agg(*(F.max(F.when(F.col("hash_ix") == i, F.col("val"))).alias(f"v{i}") for i in range(slots)))
    bands = [vals[i : i + rows] for i in range(0, slots // rows * rows, rows)]
    keys = F.array(*(F.when(reduce(Column.__and__, (v.isNotNull() for v in band)), F.xxhash64(F.lit(b), *band)) for b, band in enumerate(bands)))
    held = whole.select("exp_id", F.posexplode(keys).alias("band", "key"), F.array(*vals).alias("sketch")).where("key IS NOT NULL")
    # one row for more than `hot` members
    crowded = held.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > hot)
    crowded = crowded.select("key", F.least(F.ceil(F.col("n") / hot), F.lit(BLOCKS)).cast("int").alias("blocks"))
    dealt = held.join(F.broadcast(crowded), "key", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    dealt = dealt.withColumn("block", F.pmod(F.xxhash64("exp_id"), F.col("blocks")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    p, q = F.least("block", "other"), F.greatest("block", "other")
    met = dealt.select("exp_id", "band", "sketch", "key", p.alias("p"), q.alias("q"), (F.col("block") > F.col("other")).alias("second"))
    exp = sketch.schema["exp_id"].dataType.simpleString()
    sent = met.repartition("key", "p", "q").sortWithinPartitions("key", "p", "q", "second")
    pairs = sent.mapInArrow(_agreeing(slots, rows, least * slots), f"x {exp}, y {exp}, same long")
    return pairs.select(F.greatest("x", "y").alias("i"), F.least("x", "y").alias("j"), "same")


def nearest_merges(sketch: DataFrame, names: DataFrame, slots: int, least: float = 0.5, rounds: int = 40) -> DataFrame:
    """(step, new_node, c0, c1): a topology from sketches, many merges a round and none on the driver.

    In every round each node's best partner is the one that most slots agree with, ties to the first pair by name; nodes
    that are each other's best merge, and their sketch is the minimum by slot. Partners come from banded_pairs at `least`;
    a round without any lowers it by half, and when not even one slot is shared, or rounds end, the nodes left are joined
    in order of name, two by two. A topology never changes an answer.
    """
    spark = sketch.sparkSession
    nodes = stored(sketch.select(F.col("exp_id").cast("string").alias("exp_id"), "hash_ix", "val"))
    left = stored(names.select(F.col("exp_id").alias("node")))
    done, step = [], 0
    while step < rounds and least * slots >= 0.5:
        pairs = banded_pairs(nodes, slots, least).select(F.col("j").alias("lo"), F.col("i").alias("hi"), "same")
        ends = pairs.select("*", F.explode(F.array("lo", "hi")).alias("node"))
        best = ends.groupBy("node").agg(F.min_by(F.struct("lo", "hi"), F.struct(-F.col("same"), "lo", "hi")).alias("b"))
        mutual = best.groupBy("b").agg(F.count("*").alias("n")).where("n = 2").select("b.*")
        merges = stored(mutual.select(F.lit(step).alias("round"), F.concat(F.lit(f"u{step}_"), "lo").alias("new_node"), F.col("lo").alias("c0"), F.col("hi").alias("c1")))
        step += 1
        if merges.isEmpty():
            least /= 2
            continue
        done.append(merges)
        groups = merges.select(F.explode(F.array("c0", "c1")).alias("exp_id"), F.col("new_node").alias("node_id"))
        joined = merged(nodes, groups).select(F.col("node_id").alias("exp_id"), "hash_ix", "val")
        nodes = stored(nodes.join(groups.select("exp_id"), "exp_id", "left_anti").unionByName(joined))
        left = stored(left.join(groups.select(F.col("exp_id").alias("node")), "node", "left_anti").unionByName(merges.select(F.col("new_node").alias("node"))))
    while left.count() > 1:
        # names only: a row a node that is left
        ranked = left.select("node", (F.row_number().over(W.orderBy("node")) - 1).alias("r"))
        two = ranked.groupBy(F.floor(F.col("r") / 2).alias("g")).agg(F.min("node").alias("c0"), F.max("node").alias("c1"), F.count("*").alias("n"))
        merges = stored(two.where("n = 2").select(F.lit(step).alias("round"), F.concat(F.lit(f"u{step}_"), "c0").alias("new_node"), "c0", "c1"))
        done.append(merges)
        left = stored(merges.select(F.col("new_node").alias("node")).unionByName(two.where("n = 1").select(F.col("c0").alias("node"))))
        step += 1
    if not done:
        return spark.createDataFrame([], "step int, new_node string, c0 string, c1 string")
    every = done[0]
    for d in done[1:]:
        every = every.unionByName(d)
    return every.select(F.row_number().over(W.orderBy("round", "new_node")).alias("step"), "new_node", "c0", "c1")


def cluster_plan(sketch: DataFrame, names: list[str], slots: int) -> list[tuple[str, str, str]]:
    """Merge lines (new, child 0, child 1): again and again the closest two become one, whose sketch is their union's.

    Agglomeration is sequential: the N sketches come to the driver, which is refused above MOST experiments.
    """
    if len(names) > MOST:
        raise ValueError(f"more than {MOST} experiments; cluster groups of them first")
    at = {n: i for i, n in enumerate(names)}
    values = np.full((len(names), slots), np.iinfo(np.int64).max)
    have = np.zeros(len(names), bool)
    for r in sketch.toLocalIterator():
        values[at[r["exp_id"]], r["hash_ix"]] = r["val"]
        have[at[r["exp_id"]]] = True
    nodes, out = list(names), []
    equal = lambda i: np.where(have & have[i], 1 - (values == values[i]).mean(1), 1.0)
    dist = np.array([equal(i) for i in range(len(nodes))]) if nodes else np.zeros((0, 0))
    for n in range(len(nodes), 1, -1):
        low = np.where(np.tri(n, k=-1, dtype=bool), dist[:n, :n], 2.0)
        i, j = divmod(int(low.argmin()), n)
        new = f"internal_{n}_union"
        out.append((new, nodes[i], nodes[j]))
        nodes[j], values[j], have[j] = new, np.minimum(values[i], values[j]), have[i] | have[j]
        nodes[i], values[i], have[i] = nodes[n - 1], values[n - 1], have[n - 1]
        dist[i, : n - 1], dist[: n - 1, i] = dist[n - 1, : n - 1].copy(), dist[: n - 1, n - 1].copy()
        values, have, dist = values[: n - 1], have[: n - 1], dist[: n - 1, : n - 1]
        dist[j] = equal(j)
        dist[:, j] = dist[j]
        nodes.pop()
    return out
