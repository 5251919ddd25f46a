"""Hierarchies over experiments: topologies, the bits of their nodes, sizes, checks and text forms.

A topology is a small table, 2N - 1 rows for N experiments, made on the driver; bits never go there except for the
greedy topology of filters below a stated size. What lies below a node is an interval of leaves, so no table of nodes and
their experiments is ever made.

Node v has sim(v), positions set in every experiment below v and not in every one below its parent, and dif(v),
positions set in some but not all. Filters are packed and dealt by word; one pass from the leaves up gives both for all
nodes of a word, at a cost of 2N - 1 however deep the tree is.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from kmerloom.operators.filters import SPLIT, by_word, packed, unpacked
from kmerloom.operators.frames import Dealt
from kmerloom.plans.shared import removed, scratch, stored

#: first_leaf and last_leaf: the leaves below a node, numbered from left to right.
SCHEMA = "node_id string, parent_id string, child_ix int, depth int, preorder int, is_leaf boolean, exp_id string, first_leaf int, last_leaf int"
#: Rows of a batch of node words.
ROWS = 1 << 16
#: Words of nodes that one task holds at once: nodes times words.
CELLS = 1 << 19
#: Bytes of packed filters that the greedy build may hold on the driver; larger ones are passed over in Spark.
GREEDY_BYTES = 256 << 20


@dataclass(frozen=True)
class Node:
    name: str
    left: Node | None = None
    right: Node | None = None

    def rows(self, parent: str | None = None, ix: int | None = None) -> list[tuple]:
        """Preorder rows of the tree table; iterative, since greedy trees can be chains."""
        out, up_ix, stack, leaves = [], [], [(self, parent, ix, 0, -1)], 0
        while stack:
            n, up, i, depth, at = stack.pop()
            leaf = n.left is None
            out.append([n.name, up, i, depth, len(out), leaf, n.name if leaf else None, leaves, leaves])
            up_ix.append(at)
            leaves += leaf
            if not leaf:
                stack += [(n.right, n.name, 1, depth + 1, len(out) - 1), (n.left, n.name, 0, depth + 1, len(out) - 1)]
        for row, at in zip(reversed(out), reversed(up_ix)):
            if at >= 0:
                out[at][8] = max(out[at][8], row[8])
        return list(map(tuple, out))


def tree_table(spark: SparkSession, root: Node | None) -> DataFrame:
    return spark.createDataFrame(root.rows() if root else [], SCHEMA)


def experiments(bits: DataFrame) -> list[str]:
    """The experiments' names in order: one row each, which a topology needs on the driver."""
    return [r[0] for r in bits.select("exp_id").distinct().orderBy("exp_id").collect()]


def balanced(names: list[str], lo: int = 0) -> Node | None:
    """Halves of the ordered names, the first half the larger; inner nodes are named by their range."""
    if not names:
        return None
    if len(names) == 1:
        return Node(names[0])
    mid = (len(names) + 1) // 2
    return Node(f"{lo}_{lo + len(names)}", balanced(names[:mid], lo), balanced(names[mid:], lo + mid))


def from_merges(merges: list[tuple[str, str, str]]) -> Node | None:
    """The tree of merge lines (new, child 0, child 1), in either order; the root is the node that is no child."""
    children = {n: (a, b) for n, a, b in merges}
    below = {c for ab in children.values() for c in ab}
    roots = [n for n in children if n not in below]
    if not merges:
        return None
    if len(roots) != 1:
        raise ValueError(f"merge lines make {len(roots)} trees")
    done: dict[str, Node] = {}
    stack = [roots[0]]
    while stack:
        n = stack[-1]
        todo = [c for c in children.get(n, ()) if c not in done]
        if todo:
            stack += todo
            continue
        done[n] = Node(n, *(done[c] for c in children.get(n, ())))
        stack.pop()
    return done[roots[0]]


def merges_of(tree: DataFrame) -> DataFrame:
    """(step, new_node, c0, c1): merges that rebuild a tree, children first."""
    up = tree.where("parent_id IS NOT NULL").groupBy(F.col("parent_id").alias("new_node")).agg(
        F.max(F.when(F.col("child_ix") == 0, F.col("node_id"))).alias("c0"), F.max(F.when(F.col("child_ix") == 1, F.col("node_id"))).alias("c1")
    )
    at = tree.select(F.col("node_id").alias("new_node"), "depth", "preorder")
    rows = up.join(at, "new_node")
    return rows.selectExpr("cast(row_number() over (order by depth desc, preorder) as int) as step", "new_node", "c0", "c1")


def leaves_below(rows: DataFrame, tree: DataFrame) -> DataFrame:
    """rows (node_id, ...) with exp_id, a row for each experiment below its node; node_id goes. No more rows are made."""
    spans = rows.join(tree.select("node_id", "first_leaf", "last_leaf"), "node_id")
    each = spans.select(*(c for c in rows.columns if c != "node_id"), F.explode(F.sequence("first_leaf", "last_leaf")).alias("_leaf"))
    return each.join(tree.where("is_leaf").select(F.col("first_leaf").alias("_leaf"), "exp_id"), "_leaf").drop("_leaf")


@dataclass(frozen=True)
class Shape:
    """A topology as arrays in preorder: names, the place of each node's parent, places of the leaves from left to right."""

    names: np.ndarray
    parent: np.ndarray
    leaves: np.ndarray

    @classmethod
    def of(cls, tree: DataFrame) -> Shape:
        rows = tree.select("node_id", "parent_id", "is_leaf").orderBy("preorder").collect()  # 2N - 1 rows
        at = {r[0]: i for i, r in enumerate(rows)}
        return cls(np.array([r[0] for r in rows], object), np.array([at.get(r[1], -1) for r in rows], np.int64), np.array([i for i, r in enumerate(rows) if r[2]], np.int64))

    def up(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(every, some): of each node, the AND and the OR of the words of the leaves below; words has a row a leaf."""
        every = np.full((len(self.names), words.shape[1]), -1, np.int64)
        some = np.zeros_like(every)
        every[self.leaves] = some[self.leaves] = words
        for i in range(len(self.names) - 1, 0, -1):
            p = self.parent[i]
            every[p] &= every[i]
            some[p] |= some[i]
        return every, some

    def down(self, words: np.ndarray) -> np.ndarray:
        """Of each node, the OR of its own and its ancestors' words."""
        out = words.copy()
        for i in range(1, len(self.names)):
            out[i] |= out[self.parent[i]]
        return out


def _by_word(rows: DataFrame | Dealt, width: int, body, schema: str) -> DataFrame:
    """body(words, values) over rows (word_idx, ...) dealt by word: values are the columns behind word_idx of all rows of
    some words, and words the number of each row's word among them with the words' own numbers, in blocks of CELLS // width
    words. All rows of a word, at most `width`, meet in one task. Dealt rows do already, in order."""
    dealt = isinstance(rows, Dealt)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        most, held, n, last = max(1, CELLS // width), [], 0, None

        def put():
            t = pa.concat_batches(held)
            ids = np.asarray(t.column(0))
            first = np.append(True, ids[1:] != ids[:-1])
            return body(np.cumsum(first) - 1, ids[first], [np.asarray(c) for c in t.columns[1:]])

        for batch in batches:
            if not len(batch):
                continue
            ids = np.asarray(batch.column(0))
            if dealt and ((last is not None and ids[0] < last) or (ids[1:] < ids[:-1]).any()):
                raise ValueError("words that should be dealt and in order are not")
            new = np.append(last is None or ids[0] != last, ids[1:] != ids[:-1])
            upto = n + np.cumsum(new)
            cuts = [0, *(np.flatnonzero(new[1:] & (upto[1:] % most == 1 % most)) + 1).tolist(), len(batch)]
            if new[0] and n and n % most == 0:
                yield from put()
                held = []
            for a, b in zip(cuts, cuts[1:]):
                if a:
                    yield from put()
                    held = []
                held.append(batch.slice(a, b - a))
            n, last = int(upto[-1]), ids[-1]
        if held:
            yield from put()

    if dealt:
        return rows.through(run, schema)
    return rows.repartition("word_idx").sortWithinPartitions("word_idx").mapInArrow(run, schema)


def _leaves(names: list[str]):
    """Batches (exp_id, word_idx, word) to (word_idx, leaf, word): the place of each experiment among names; others go."""
    at = pa.array(names, pa.string())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            exp = batch.column(0).dictionary_encode()
            leaf = pc.index_in(exp.dictionary, at).take(exp.indices)
            rows = pa.record_batch([batch.column(1), leaf, batch.column(2)], ["word_idx", "leaf", "word"])
            yield rows.filter(leaf.is_valid()) if leaf.null_count else rows

    return run


def _leaf_words(tree: DataFrame, bits: DataFrame | Dealt, dealt: bool = False) -> DataFrame | Dealt:
    """(word_idx, leaf, word) of filters; a topology without an experiment of bits leaves it out."""
    if dealt or isinstance(bits, Dealt):
        names = [r[0] for r in tree.where("is_leaf").orderBy("first_leaf").select("exp_id").collect()]  # N rows
        return by_word(bits, dealt).after(_leaves(names))
    leaf = tree.where("is_leaf").select("exp_id", F.col("first_leaf").alias("leaf"))
    return packed(bits).join(F.broadcast(leaf), "exp_id").select("word_idx", "leaf", "word")  # a row an experiment


def _informative(shape: Shape, at: np.ndarray, ids: np.ndarray, cols: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(sim, dif) of all nodes at some words, of leaves and their words."""
    words = np.zeros((len(shape.leaves), len(ids)), np.int64)
    words[cols[0], at] = cols[1]
    every, some = shape.up(words)
    claimed = np.concatenate([every, np.zeros((1, len(ids)), np.int64)])[shape.parent]  # the root has no parent
    return every & ~claimed, some & ~every


def node_words(tree: DataFrame, bits: DataFrame | Dealt, dealt: bool = False, kinds: tuple[str, ...] = ("sim", "dif")) -> DataFrame:
    """(node_id, word_idx, sim, dif): the informative bits of every node, 64 positions a row; rows without any are left out.
    dealt: the filters are packed, and all rows of a word come from one task in order, as filter_words() deals them. kinds:
    the columns that are asked for; what has bits of no such kind is never a row."""
    shape = Shape.of(tree)
    names = pa.array(shape.names, pa.string())

    def body(at, ids, cols):
        got = dict(zip(("sim", "dif"), _informative(shape, at, ids, cols)))
        node, word = np.nonzero(np.bitwise_or.reduce([got[k] for k in kinds]))
        for i in range(0, len(node), ROWS):
            n, w = node[i : i + ROWS], word[i : i + ROWS]
            yield pa.record_batch([names.take(pa.array(n)), pa.array(ids[w].astype(np.int32)), *(pa.array(got[k][n, w]) for k in kinds)], ["node_id", "word_idx", *kinds])

    return _by_word(_leaf_words(tree, bits, dealt), max(1, len(shape.names)), body, "node_id string, word_idx int, " + ", ".join(f"{k} long" for k in kinds))


def node_ones(tree: DataFrame, bits: DataFrame | Dealt, dealt: bool = False) -> DataFrame:
    """(node_id, sim_ones, dif_ones): set bits of the nodes, counted in the pass that makes their words: these are not rows. A
    node without a bit has no row."""
    shape = Shape.of(tree)

    def body(at, ids, cols):
        sim, dif = (np.bitwise_count(x.view(np.uint64)).sum(axis=1, dtype=np.int64) for x in _informative(shape, at, ids, cols))
        some = np.flatnonzero(sim | dif)
        yield pa.record_batch([pa.array(shape.names[some], pa.string()), pa.array(sim[some]), pa.array(dif[some])], ["node_id", "sim_ones", "dif_ones"])

    parts = _by_word(_leaf_words(tree, bits, dealt), max(1, len(shape.names)), body, "node_id string, sim_ones long, dif_ones long")
    return parts.groupBy("node_id").agg(*(F.sum(c).alias(c) for c in ("sim_ones", "dif_ones")))


def sibling_counts(tree: DataFrame, bits: DataFrame | Dealt, dealt: bool = False) -> DataFrame:
    """split_pair_counts of the two children of every inner node, counted in the pass that makes the nodes' words: these are
    not rows. A pair without a bit has no row."""
    shape = Shape.of(tree)
    pairs: dict[int, list[int]] = {}
    for i in range(1, len(shape.names)):  # in preorder, so child 0 comes first
        pairs.setdefault(int(shape.parent[i]), []).append(i)
    a, b = (np.array([kids[i] for kids in pairs.values()], np.int64) for i in (0, 1))

    def body(at, ids, cols):
        sim, dif = _informative(shape, at, ids, cols)
        got = np.zeros((len(a), len(SPLIT)), np.int64)
        for row, (i, j) in enumerate(zip(a, b)):
            s1, s2, d1, d2 = sim[i], sim[j], dif[i], dif[j]
            got[row] = [_popcount(x) for x in (s1 & s2, d1 & s2, d1 ^ s2, d1 ^ s1, (s1 ^ s2) | (d1 ^ d2), (s1 | d1) ^ (s2 | d2), s1 | d1 | s2 | d2)]
        some = np.flatnonzero(got[:, -1])
        yield pa.record_batch([pa.array(shape.names[a[some]], pa.string()), pa.array(shape.names[b[some]], pa.string()), *(pa.array(got[some, c]) for c in range(len(SPLIT)))], ["a", "b", *SPLIT])

    parts = _by_word(_leaf_words(tree, bits, dealt), max(1, len(shape.names)), body, "a string, b string, " + ", ".join(f"{c} long" for c in SPLIT))
    return parts.groupBy("a", "b").agg(*(F.sum(c).alias(c) for c in SPLIT))


def bits_of_words(words: DataFrame) -> DataFrame:
    """(node_id, pos, kind) of node_words."""
    kinds = F.array(F.struct(F.lit("sim").alias("kind"), F.col("sim").alias("word")), F.struct(F.lit("dif").alias("kind"), F.col("dif").alias("word")))
    rows = words.select("node_id", "word_idx", F.inline(kinds)).where("word <> 0")
    bit = F.filter(F.sequence(F.lit(0), F.lit(63)), lambda i: F.getbit(F.col("word"), i) == 1)
    return rows.select("node_id", "word_idx", "kind", F.explode(bit).alias("_b")).select("node_id", (F.col("word_idx").cast("long") * 64 + F.col("_b")).alias("pos"), "kind")


def words_of_bits(nodes: DataFrame) -> DataFrame:
    """(node_id, word_idx, sim, dif) of rows (node_id, pos, kind)."""
    word = lambda kind: F.expr(f"bit_or(CASE WHEN kind = '{kind}' THEN shiftleft(1L, cast(pos % 64 as int)) ELSE 0L END)").alias(kind)
    return nodes.groupBy("node_id", F.floor(F.col("pos") / 64).cast("int").alias("word_idx")).agg(word("sim"), word("dif"))


def node_bits(tree: DataFrame, bits: DataFrame) -> DataFrame:
    """(node_id, pos, kind): the informative bits of every node, kind sim or dif."""
    return bits_of_words(node_words(tree, bits))


def node_sizes(tree: DataFrame, words: DataFrame, m: int) -> DataFrame:
    """(node_id, sim_ones, dif_ones, sim_size, dif_size) of node_words: set bits, and vector lengths without bits that say
    nothing."""
    return sizes_of(tree, words.groupBy("node_id").agg(*(F.sum(F.bit_count(kind)).alias(f"{kind}_ones") for kind in ("sim", "dif"))), m)


def sizes_of(tree: DataFrame, ones: DataFrame, m: int) -> DataFrame:
    """The same of node_ones."""
    own = tree.select("node_id", "parent_id").join(ones, "node_id", "left").fillna(0, ["sim_ones", "dif_ones"])
    above = own.select(F.col("node_id").alias("parent_id"), F.col("dif_ones").alias("size"))
    size = F.when(F.col("parent_id").isNull(), F.lit(m)).otherwise(F.col("size")).cast("long")
    return own.join(above, "parent_id", "left").select(
        "node_id", F.col("sim_ones").cast("long"), F.col("dif_ones").cast("long"), size.alias("sim_size"), (size - F.col("sim_ones")).cast("long").alias("dif_size")
    )


def observed(words: DataFrame, tree: DataFrame, m: int) -> tuple[DataFrame, Observation]:
    """(words, observation): node words, ordered by node and word, whose rows fail the job where they break what holds for any node: a position is
    not in sim and dif at once, lies below m, and is not in the dif of a leaf. The observation, of the pass that reads the
    words, has filter_bits: a set position of a filter is in the sim of exactly one node on its path, so the sims, each as
    often as its node has leaves, sum up to the filters' set positions."""
    at = tree.select("node_id", (F.col("last_leaf") - F.col("first_leaf") + 1).cast("long").alias("_leaves"))
    # in the order of storage first: finding the ranges runs what lies below twice, which an observation must not see
    rows = words.join(at, "node_id", "left").repartitionByRange("node_id", "word_idx").sortWithinPartitions("node_id", "word_idx")
    top = F.lit(m) - F.col("word_idx").cast("long") * 64
    beyond = F.when(top >= 64, F.lit(0).cast("long")).when(top <= 0, F.lit(-1).cast("long")).otherwise(F.expr(f"shiftleft(-1L, cast({m}L - word_idx * 64L as int))"))
    both = F.col("sim").bitwiseAND(F.col("dif")) != 0
    outside = F.col("sim").bitwiseOR(F.col("dif")).bitwiseAND(beyond) != 0
    fault = F.when(F.col("_leaves").isNull(), "is no node of the topology").when(both, "has a position in sim and dif").when(outside, "has a position beyond the filter").when((F.col("_leaves") == 1) & (F.col("dif") != 0), "is a leaf with a dif")
    sound = F.when(fault.isNotNull(), F.raise_error(F.concat(F.lit("node "), "node_id", F.lit(" "), fault)).cast("long")).otherwise(F.col("sim"))
    seen = Observation()
    checked = rows.withColumn("sim", sound).observe(seen, F.sum(F.bit_count("sim") * F.col("_leaves")).alias("filter_bits"))
    return checked.select("node_id", "word_idx", "sim", "dif"), seen


def rebuilt(tree: DataFrame, words: DataFrame) -> DataFrame:
    """(exp_id, pos): every experiment's filter again, from the sim bits of its nodes and its own."""
    return unpacked(rebuilt_words(tree, words))


def rebuilt_words(tree: DataFrame, words: DataFrame) -> DataFrame:
    """(exp_id, word_idx, word): the same packed; one pass down gives the filters of all experiments at a word."""
    shape = Shape.of(tree)
    names = np.array([r[0] for r in tree.where("is_leaf").orderBy("first_leaf").select("exp_id").collect()], object)  # N rows
    sims = words.where("sim <> 0").join(tree.select("node_id", "preorder"), "node_id").select("word_idx", "preorder", "sim")

    def body(at, ids, cols):
        own = np.zeros((len(shape.names), len(ids)), np.int64)
        own[cols[0], at] = cols[1]
        filters = shape.down(own)[shape.leaves]
        leaf, word = np.nonzero(filters)
        yield pa.record_batch([pa.array(names[leaf], pa.string()), pa.array(ids[word].astype(np.int32)), pa.array(filters[leaf, word])], ["exp_id", "word_idx", "word"])

    return _by_word(sims, max(1, 2 * len(shape.names)), body, "exp_id string, word_idx int, word long")


def roundtrip(tree: DataFrame, words: DataFrame, bits: DataFrame) -> DataFrame:
    """(exp_id, ones, rebuilt, same): set positions of each filter, of the filter that its nodes give, and of both.

    Filters and sims meet by word, where one pass down gives the filters again; what leaves a task is counts."""
    shape = Shape.of(tree)
    leaf = _leaf_words(tree, bits).select("word_idx", F.col("leaf").alias("at"), F.lit(True).alias("is_leaf"), "word")
    sims = words.where("sim <> 0").join(F.broadcast(tree.select("node_id", "preorder")), "node_id")  # 2N - 1 rows
    node = sims.select("word_idx", F.col("preorder").alias("at"), F.lit(False).alias("is_leaf"), F.col("sim").alias("word"))

    def body(at, ids, cols):
        place, is_leaf, word = cols
        own, said = np.zeros((len(shape.leaves), len(ids)), np.int64), np.zeros((len(shape.names), len(ids)), np.int64)
        own[place[is_leaf], at[is_leaf]] = word[is_leaf]
        said[place[~is_leaf], at[~is_leaf]] = word[~is_leaf]
        back = shape.down(said)[shape.leaves]
        counts = [np.bitwise_count(x.view(np.uint64)).sum(axis=1, dtype=np.int64) for x in (own, back, own & back)]
        some = np.flatnonzero(counts[0] | counts[1])
        yield pa.record_batch([pa.array(shape.names[shape.leaves[some]], pa.string()), *(pa.array(c[some]) for c in counts)], ["exp_id", "ones", "rebuilt", "same"])

    parts = _by_word(leaf.unionByName(node), max(1, 2 * len(shape.names)), body, "exp_id string, ones long, rebuilt long, same long")
    return parts.groupBy("exp_id").agg(*(F.sum(c).alias(c) for c in ("ones", "rebuilt", "same")))


def check(tree: DataFrame, words: DataFrame, bits: DataFrame) -> DataFrame:
    """(node_id, n_union, n_node, ok): sim of a node and its ancestors plus dif must be the union of the filters below.

    Filters and node_words meet by word: one pass up gives the unions, one pass down what the nodes say. A node of which
    neither has a bit has no row.
    """
    shape, zero = Shape.of(tree), F.lit(0).cast("long")
    leaf = _leaf_words(tree, bits).select("word_idx", F.col("leaf").alias("at"), F.lit(True).alias("is_leaf"), "word", zero.alias("dif"))
    node = words.join(tree.select("node_id", "preorder"), "node_id").select("word_idx", F.col("preorder").alias("at"), F.lit(False).alias("is_leaf"), F.col("sim").alias("word"), "dif")

    def body(at, ids, cols):
        place, is_leaf, word, dif = cols
        leaves, sims, difs = (np.zeros((n, len(ids)), np.int64) for n in (len(shape.leaves), len(shape.names), len(shape.names)))
        leaves[place[is_leaf], at[is_leaf]] = word[is_leaf]
        sims[place[~is_leaf], at[~is_leaf]], difs[place[~is_leaf], at[~is_leaf]] = word[~is_leaf], dif[~is_leaf]
        union, says = shape.up(leaves)[1], shape.down(sims) | difs
        a, b = (np.bitwise_count(x.view(np.uint64)).sum(axis=1, dtype=np.int64) for x in (union, says))
        some = np.flatnonzero(a | b)
        yield pa.record_batch([pa.array(shape.names[some], pa.string()), pa.array(a[some]), pa.array(b[some]), pa.array((union == says).all(axis=1)[some])], ["node_id", "n_union", "n_node", "ok"])

    parts = _by_word(leaf.unionByName(node), max(1, 2 * len(shape.names)), body, "node_id string, n_union long, n_node long, ok boolean")
    return parts.groupBy("node_id").agg(F.sum("n_union").alias("n_union"), F.sum("n_node").alias("n_node"), F.bool_and("ok").alias("ok"))


def edges(tree: DataFrame) -> DataFrame:
    """(parent, child) of every edge."""
    return tree.where("parent_id IS NOT NULL").select(F.col("parent_id").alias("parent"), F.col("node_id").alias("child"))


def to_dot(tree: DataFrame) -> str:
    """Graphviz text of a topology."""
    rows = tree.where("parent_id IS NOT NULL").orderBy("preorder").collect()
    return "digraph tree {\n" + "".join(f'    "{r.parent_id}" -> "{r.node_id}" ;\n' for r in rows) + "}\n"


def _popcount(x: np.ndarray) -> int:
    return int(np.bitwise_count(x.view(np.uint64)).sum())  # signed words would be counted by their absolute value


def _counts(kind: int, a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> tuple[int, int]:
    """The two bit counts of words that a similarity of this kind is made of; those of parts of the words add up."""
    (s1, d1), (s2, d2) = a, b
    if kind == 0:
        return _popcount((s1 | d1) ^ (s2 | d2)), 0
    if kind == 1:
        return _popcount(s1 | s2 | d1 | d2), _popcount((s1 ^ s2) | (d1 ^ d2))
    if kind == 2:
        return _popcount(s1 & s2), _popcount(d1 ^ s2)
    if kind == 3:
        return _popcount(s1 & s2), _popcount(d1 & s2)
    raise ValueError(f"no similarity of kind {kind}")


def _like(kind: int, x: int, y: int, m: int) -> int:
    """The similarity that _counts make."""
    if kind == 0:
        return m - x
    if kind == 1:
        return int(np.float32(np.float32(x - y) / np.float32(x)) * np.float32(m)) if x else 0
    if kind == 2:
        return x * m if x else m - y
    return x + y


def _sim(kind: int, a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray], m: int) -> int:
    return _like(kind, *_counts(kind, a, b), m)


def _by_place(words: DataFrame, names: list[str]) -> DataFrame:
    """(words): a row for each word_idx of packed filters, the words of all names at that place end to end."""
    at = words.sparkSession.createDataFrame(list(enumerate(names)), "leaf int, exp_id string")

    def body(place, ids, cols):
        wide = np.zeros((len(ids), len(names)), "<i8")
        wide[place, cols[0]] = cols[1]
        ends = np.arange(len(ids) + 1, dtype=np.int32) * (8 * len(names))
        yield pa.record_batch([pa.BinaryArray.from_buffers(pa.binary(), len(ids), [None, pa.py_buffer(ends.tobytes()), pa.py_buffer(wide.tobytes())])], ["words"])

    rows = words.join(F.broadcast(at), "exp_id").select("word_idx", "leaf", "word")
    return _by_word(rows, max(1, len(names)), body, "words binary")


def _likenesses(wide: DataFrame, tree: list[tuple[str, list[str]]], names: list[str], new: str, m: int, kind: int) -> dict[str, int]:
    """Of each child of a node of tree (inner nodes and their children, a parent before what is below it), how like it is
    to the experiment new that comes to its parent: one pass over the words, whose counts are summed up in Spark."""
    order = [tree[0][0], *(c for _, kids in tree for c in kids)]
    row = {n: i for i, n in enumerate(order)}
    column = {n: i for i, n in enumerate(names)}
    inner = [(row[n], [row[c] for c in kids]) for n, kids in tree]
    split = {i for i, _ in inner}
    leaves = [(i, column[n]) for n, i in row.items() if i not in split]
    most, own_at, width = max(1, CELLS // (4 * len(order))), column[new], len(names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((len(order), 2), np.int64)
        for batch in batches:
            every_word = np.frombuffer(b"".join(batch.column(0).to_pylist()), "<i8").reshape(-1, width)
            for a in range(0, len(every_word), most):
                words = np.ascontiguousarray(every_word[a : a + most].T)
                every, some, v = [None] * len(order), [None] * len(order), words[own_at]
                for i, c in leaves:
                    every[i] = some[i] = words[c]
                for i, (x, y) in reversed(inner):
                    every[i], some[i] = every[x] & every[y], some[x] | some[y]
                for i, kids in inner:
                    claimed = every[i] & v
                    for c in kids:
                        sums[c] += _counts(kind, (every[c] & ~claimed, some[c] & ~every[c]), (v & ~claimed, np.zeros_like(v)))
        yield pa.record_batch([pa.array(np.arange(len(order), dtype=np.int32)), pa.array(sums[:, 0].copy()), pa.array(sums[:, 1].copy())], ["node", "x", "y"])

    total = wide.mapInArrow(run, "node int, x long, y long").groupBy("node").agg(F.sum("x"), F.sum("y"))
    return {order[n]: _like(kind, x, y, m) for n, x, y in total.collect() if n}  # a row a node


def _preorder(root: str, kids: dict[str, list[str]]) -> list[tuple[str, list[str]]]:
    out, stack = [], [root]
    while stack:
        n = stack.pop()
        if n in kids:
            out.append((n, list(kids[n])))
            stack += kids[n]
    return out


def _spread(packs: DataFrame, names: list[str], m: int, kind: int) -> dict[str, list[str]]:
    """The children of each inner node of the greedy topology, by a pass of Spark over the packed filters an experiment."""
    base = scratch(packs.sparkSession)
    wide = stored(_by_place(packs, names), base)
    kids: dict[str, list[str]] = {}
    root = names[0]
    for name in names[1:]:
        up, at = None, root
        like = _likenesses(wide, _preorder(root, kids), names, name, m, kind) if kids else {}
        while at in kids:
            a, b = kids[at]
            up, at = at, b if like[b] >= like[a] else a
        kids[f"{name}_union"] = [at, name]
        if up:
            kids[up][kids[up].index(at)] = f"{name}_union"
        else:
            root = f"{name}_union"
    removed(packs.sparkSession, base)
    return kids


def greedy(bits: DataFrame, m: int, kind: int = 1, names: list[str] | None = None) -> Node | None:
    """Insert experiments in the order of names (by default sorted), each below the child that it is more like; ties go to child 1.

    Each step depends on all before it. Packed filters are held on the driver where they take no more than GREEDY_BYTES;
    larger ones stay in a table, a row a word, and each experiment is one pass over it, whose tasks hold a batch of rows.
    The answers of queries do not depend on the topology.
    """
    spark = bits.sparkSession
    base = scratch(spark)
    packs = stored(packed(bits), base)
    names = names if names is not None else experiments(packs)
    words = -(-m // 64)
    if len(names) * words * 8 * 3 > GREEDY_BYTES:
        kids = _spread(packs, names, m, kind) if names else {}
        removed(spark, base)
        return from_merges([(n, a, b) for n, (a, b) in kids.items()]) if kids else (Node(names[0]) if names else None)
    vectors = {n: np.zeros(words, np.int64) for n in names}
    for r in packs.toLocalIterator():
        vectors[r["exp_id"]][r["word_idx"]] = r["word"]
    removed(spark, base)
    every: dict[str, np.ndarray] = {}
    some: dict[str, np.ndarray] = {}
    kids: dict[str, list[str]] = {}
    up: dict[str, str] = {}
    root, zero = None, np.zeros(words, np.int64)
    for name in names:
        v = vectors[name]
        every[name] = some[name] = v
        at = root
        if at is None:
            root = name
            continue
        claimed = zero
        while at in kids:
            every[at], some[at] = every[at] & v, some[at] | v
            claimed = every[at]
            own = v & ~claimed, zero
            s = [_sim(kind, (every[c] & ~claimed, some[c] & ~every[c]), own, m) for c in kids[at]]
            at = kids[at][1 if s[1] >= s[0] else 0]
        new = f"{name}_union"
        every[new], some[new], kids[new] = every[at] & v, some[at] | v, [at, name]
        if at in up:
            p = up[at]
            kids[p][kids[p].index(at)] = new
            up[new] = p
        else:
            root = new
        up[at] = up[name] = new
    return from_merges([(n, a, b) for n, (a, b) in kids.items()]) if kids else (Node(root) if root else None)

