"""Queries over filters: threshold, boolean, segmented and weighted, as joins and sums; and a level-by-level tree plan.

queries has (query_id, seq, theta). A query's k-mers are its distinct raw windows, each hashed in canonical form; every
hash position counts, duplicates included. Sequences shorter than k, and null ones, are left out; an atom or segment
shorter than k is an error where its query would otherwise change its meaning, so callers check with too_short().

The join is on the k-mer or position. Spark broadcasts the query side when it is small enough by its own size check.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from kmerloom.functions.kmers import positions, windows
from kmerloom.operators.filters import at_least, first_of, part_of
from kmerloom.operators.tree import leaves_below
from kmerloom.plans.shared import removed, scratch, stored
from kmerloom.plans.spec import HashSpec


def query_kmers(queries: DataFrame, k: int, keys: tuple[str, ...] = ("query_id",)) -> DataFrame:
    """(keys, kmer, ord): distinct raw k-mers in canonical form, numbered by first occurrence. Equal canonical forms of
    different raw windows stay apart."""
    seen = windows(queries.select(*keys, "seq"), "seq", k).groupBy(*keys, "raw", "kmer").agg(F.min("place").alias("place"))
    order = F.row_number().over(W.partitionBy(*keys).orderBy("place")) - 1
    return seen.select(*keys, "kmer", order.cast("int").alias("ord"))


def query_positions(queries: DataFrame, spec: HashSpec, keys: tuple[str, ...] = ("query_id",)) -> DataFrame:
    """(keys, pos, mult): positions with multiplicity."""
    seen = windows(queries.select(*keys, "seq"), "seq", spec.k).select(*keys, "raw", "kmer").distinct()
    p = seen.select(*keys, F.explode(positions(F.col("kmer"), spec)).alias("pos"))
    return p.groupBy(*keys, "pos").agg(F.count("*").alias("mult"))


def too_short(queries: DataFrame, k: int) -> DataFrame:
    return queries.where(F.coalesce(F.length("seq"), F.lit(0)) < k)


def met(probe: DataFrame, index: DataFrame, on: str, spec: HashSpec) -> DataFrame:
    """probe joined with index (exp_id, on), with packed filters (exp_id, word_idx, word), or with stored ones, which have
    a part as well.

    Packed filters are met by word, and the bit decides: positions are never rows. A stored index is met by part too. The
    probe is written first, so Spark knows its size: one that is small enough is broadcast, and then only the parts that it
    has positions in are read. The condition on pos, which always holds, is what Spark asks for before it prunes.
    """
    word = F.floor(F.col("pos") / 64).cast("int")
    by = [c for c in ("part", "word_idx") if c in index.columns] if on == "pos" else []
    if "part" in by:
        probe = stored(probe.withColumn("part", part_of(first_of(word), spec))).where("pos >= 0")
    if "word_idx" in by:
        held = F.getbit("word", (F.col("pos") % 64).cast("int")) == 1
        return probe.withColumn("word_idx", word).join(index, by).where(held).drop("part", "word_idx", "word")
    return probe.join(index, [*by, on]).drop("part")


def counts(probe: DataFrame, index: DataFrame, on: str, spec: HashSpec, keys: tuple[str, ...] = ("query_id",)) -> DataFrame:
    """(keys, exp_id, hits) of probe (keys, on, mult) against index (exp_id, on); pairs without a hit have no row."""
    return met(probe, index, on, spec).groupBy(*keys, "exp_id").agg(F.sum("mult").alias("hits"))


def totals(probe: DataFrame, keys: tuple[str, ...] = ("query_id",)) -> DataFrame:
    return probe.groupBy(*keys).agg(F.sum("mult").alias("total"))


def probe_of(queries: DataFrame, spec: HashSpec, exact: bool = False, keys: tuple[str, ...] = ("query_id",)) -> DataFrame:
    """(keys, kmer or pos, mult): what a query looks up."""
    if exact:
        return query_kmers(queries, spec.k, keys).groupBy(*keys, "kmer").agg(F.count("*").alias("mult"))
    return query_positions(queries, spec, keys)


def threshold_query(queries: DataFrame, index: DataFrame, spec: HashSpec, exact: bool = False, experiments: DataFrame | None = None) -> DataFrame:
    """(query_id, exp_id, hits, total) where hits >= total * theta in 32-bit floats.

    index: (exp_id, pos), or (exp_id, kmer) with exact=True. Queries with theta <= 0 hold for every experiment, which
    then must be given as experiments (exp_id).
    """
    on = "kmer" if exact else "pos"
    probe = probe_of(queries, spec, exact)
    sums = totals(probe).join(queries.select("query_id", "theta"), "query_id")
    hits = counts(probe, index, on, spec)
    if experiments is not None:
        free = sums.where("theta <= 0").join(experiments)  # a row each by definition
        zero = free.join(hits, ["query_id", "exp_id"], "left").fillna(0, ["hits"]).select("query_id", "exp_id", "hits", "total")
        sums = sums.where("theta > 0")
    passed = hits.join(sums, "query_id").where(at_least(F.col("hits"), F.col("total"), F.col("theta"))).select("query_id", "exp_id", "hits", "total")
    return passed if experiments is None else passed.unionByName(zero)


def full_kmer_query(queries: DataFrame, index: DataFrame, spec: HashSpec) -> DataFrame:
    """Threshold query by k-mers that have all their nh positions in the filter."""
    k = query_kmers(queries, spec.k)
    p = k.select("query_id", "ord", F.explode(F.array_distinct(positions(F.col("kmer"), spec))).alias("pos"))
    need = k.select("query_id", "ord", F.size(F.array_distinct(positions(F.col("kmer"), spec))).alias("need"))
    found = met(p, index, "pos", spec).groupBy("query_id", "ord", "exp_id").agg(F.count("*").alias("n"))
    hits = found.join(need, ["query_id", "ord"]).where("n = need").groupBy("query_id", "exp_id").agg(F.count("*").alias("hits"))
    sums = k.groupBy("query_id").agg(F.count("*").alias("total")).join(queries.select("query_id", "theta"), "query_id")
    return hits.join(sums, "query_id").where(at_least(F.col("hits"), F.col("total"), F.col("theta"))).select("query_id", "exp_id", "hits", "total")


def weighted_query(queries: DataFrame, index: DataFrame, weights: DataFrame, spec: HashSpec) -> DataFrame:
    """(query_id, exp_id, score, total): the weights of the k-mers found, at least theta times the number of k-mers.

    weights (query_id, ord, w) go to k-mers in order of first occurrence; a k-mer without one fails the query's job.
    index: (exp_id, kmer).
    """
    k = query_kmers(queries, spec.k).join(weights, ["query_id", "ord"], "left")
    score = k.join(index, "kmer").groupBy("query_id", "exp_id").agg(F.sum(F.col("w").cast("double")).alias("score"))
    few = F.raise_error(F.lit("a query has fewer weights than k-mers")).cast("long")
    total = F.when(F.count("w") < F.count("*"), few).otherwise(F.count("*"))
    sums = k.groupBy("query_id").agg(total.alias("total")).join(queries.select("query_id", "theta"), "query_id")
    return score.join(sums, "query_id").where(at_least(F.col("score"), F.col("total"), F.col("theta"))).select("query_id", "exp_id", "score", "total")


#: Atoms of a line up to which it is judged by a truth table, and masks of a table's word.
TABLE_ATOMS, WORD = 12, 64


def true_atoms(atoms: DataFrame, index: DataFrame, spec: HashSpec, exact: bool = True, strict: bool = True) -> DataFrame:
    """(query_id, exp_id, mask): of each query and experiment with a true atom, the true ones as bits; at most 63 atoms."""
    keys = ("query_id", "atom_ix")
    probe = probe_of(atoms, spec, exact, keys)
    sums = totals(probe, keys).join(atoms.select(*keys, "theta"), list(keys))
    found = counts(probe, index, "kmer" if exact else "pos", spec, keys).join(sums, list(keys))
    true = found.where(at_least(F.col("hits"), F.col("total"), F.col("theta"), strict))
    return true.groupBy("query_id", "exp_id").agg(F.expr("bit_or(shiftleft(1L, atom_ix))").alias("mask"))


def judged(lines: DataFrame, masks: DataFrame, experiments: DataFrame) -> DataFrame:
    """The rows (query_id, ..., exp_id) for which lines (query_id, table, ...) hold, by masks of true atoms.

    table: a line's truth table, an array of longs; bit m says whether the line holds where the atoms of mask m are true.
    A line that does not hold at mask 0 is judged at experiments with a true atom only. One that does, a negation, holds
    for nearly all experiments: it has a row for each, as its meaning demands.
    """
    bit = lambda mask: F.getbit(F.element_at("table", (F.floor(mask / WORD) + 1).cast("int")), (mask % WORD).cast("int")) == 1
    keep = [c for c in lines.columns if c != "table"]
    free = bit(F.lit(0).cast("long"))
    some = lines.where(~free).join(masks, "query_id").where(bit(F.col("mask")))
    every = lines.where(free).join(experiments).join(masks, ["query_id", "exp_id"], "left").where(bit(F.coalesce("mask", F.lit(0).cast("long"))))
    return some.select(*keep, "exp_id").unionByName(every.select(*keep, "exp_id"))


def truth_table(spark: SparkSession, predicate: str, n: int) -> list[int]:
    """The table of a Spark SQL predicate over a0, ..., of n atoms: Spark evaluates it at each of the 2^n masks."""
    flags = {f"a{i}": F.getbit(F.col("id"), F.lit(i)) == 1 for i in range(n)}
    rows = spark.range(1 << n).withColumns(flags).where(F.expr(predicate)).select("id").collect() if n else spark.range(1).where(F.expr(predicate)).collect()
    words = [0] * max(1, (1 << n) // WORD)
    for r in rows:
        words[r[0] // WORD] |= 1 << r[0] % WORD
    return [w - (1 << WORD) if w >> WORD - 1 else w for w in words]


def bool_query(atoms: DataFrame, expressions: dict[str, str], experiments: DataFrame, index: DataFrame, spec: HashSpec, exact: bool = True, strict: bool = True) -> DataFrame:
    """(query_id, name, exp_id) where a boolean expression over atoms holds.

    atoms: (query_id, atom_ix, seq, theta), for each query the sequences a0, a1, ... ; expressions: name to a Spark SQL
    predicate over a0, a1, ... (xor is <>), applied to every query. Each becomes a truth table; with more than TABLE_ATOMS
    atoms, predicates are evaluated at every pair of query and experiment instead.
    """
    most = atoms.agg(F.max("atom_ix")).first()[0]
    n = 0 if most is None else most + 1
    masks, ids = true_atoms(atoms, index, spec, exact, strict), atoms.select("query_id").distinct()
    if n <= TABLE_ATOMS:
        tables = [(name, truth_table(atoms.sparkSession, e, n)) for name, e in expressions.items()]
        named = atoms.sparkSession.createDataFrame(tables, "name string, table array<long>")
        return judged(ids.join(F.broadcast(named)), masks, experiments).select("query_id", "exp_id", "name")  # a row an expression
    at = ids.join(experiments).join(masks, ["query_id", "exp_id"], "left")
    at = at.withColumns({f"a{i}": F.coalesce(F.getbit("mask", F.lit(i)) == 1, F.lit(False)) for i in range(n)})
    holds = F.array_compact(F.array(*(F.when(F.expr(e), F.lit(name)) for name, e in expressions.items())))
    return at.select("query_id", "exp_id", F.explode(holds).alias("name"))


def _holds(shape: str, bits: list[int], ones: int) -> int:
    """A shape, @ for each atom with ~ & ^ | and parentheses, over integers whose bits are cases side by side."""
    pieces = shape.replace("!", "~").split("@")
    text = pieces[0] + "".join(f"b[{i}]{p}" for i, p in enumerate(pieces[1:]))
    return eval(compile(text, "shape", "eval"), {"__builtins__": {}}, {"b": bits}) & ones  # noqa: S307  a shape has no names


def shape_tables(shapes: DataFrame) -> DataFrame:
    """(shape, n_atoms, table) of shapes (shape) of at most TABLE_ATOMS atoms, one row each; what is no shape fails the job.

    A table is the value of the shape over integers that hold all 2^n cases side by side.
    """

    def run(batches):
        for batch in batches:
            tables = []
            for shape in batch.column(0).to_pylist():
                n = shape.count("@")
                cases, ones = 1 << n, (1 << (1 << n)) - 1
                # case c has atom i where bit i of c is set: blocks of 2^i zeros and ones in turn
                atom = [((1 << (1 << i)) - 1 << (1 << i)) * (ones // ((1 << (2 << i)) - 1)) for i in range(n)]
                value = _holds(shape, atom, ones)
                tables.append(np.frombuffer(value.to_bytes(max(8, cases // 8), "little"), "<i8").tolist())
            yield pa.record_batch([batch.column(0), pa.array([s.count("@") for s in batch.column(0).to_pylist()], pa.int32()), pa.array(tables, pa.list_(pa.int64()))], ["shape", "n_atoms", "table"])

    return shapes.select("shape").distinct().mapInArrow(run, "shape string, n_atoms int, table array<long>")


def line_query(lines: DataFrame, atoms: DataFrame, experiments: DataFrame, index: DataFrame, spec: HashSpec, exact: bool = True, strict: bool = True) -> DataFrame:
    """(query_id, exp_id) where the lines of a batch of boolean queries hold.

    lines: (query_id, shape), a shape such as (@&!@)|@ over the line's atoms in order; atoms: (query_id, atom_ix, seq,
    theta). The plan is of one size whatever the number of lines: lines of one shape share its truth table. Lines of more
    than TABLE_ATOMS atoms are evaluated in place, those with more than 63 are an error.
    """
    masks = true_atoms(atoms, index, spec, exact, strict)
    n = F.length(F.regexp_replace("shape", "[^@]", ""))
    sized = lines.select("query_id", "shape", F.when(n > 63, F.raise_error(F.lit("a line has more than 63 atoms")).cast("int")).otherwise(n).alias("n"))
    short = sized.where(F.col("n") <= TABLE_ATOMS)
    found = judged(short.join(shape_tables(short).select("shape", "table"), "shape").select("query_id", "table"), masks, experiments)

    def run(batches):
        for batch in batches:
            shapes, mask = batch.column(2).to_pylist(), batch.column(3).to_pylist()
            ok = [_holds(s, [m >> i & 1 for i in range(s.count("@"))], 1) == 1 for s, m in zip(shapes, mask)]
            yield batch.select([0, 1]).filter(pa.array(ok, pa.bool_()))

    wide = sized.where(F.col("n") > TABLE_ATOMS).select("query_id", "shape").join(experiments).join(masks, ["query_id", "exp_id"], "left")
    kind = dict(lines.dtypes)["query_id"]
    wide = wide.select("query_id", "exp_id", "shape", F.coalesce("mask", F.lit(0).cast("long")).alias("mask")).mapInArrow(run, f"query_id {kind}, exp_id string")
    return found.select("query_id", "exp_id").unionByName(wide)


def segment_query(segments: DataFrame, index: DataFrame, spec: HashSpec) -> DataFrame:
    """(query_id, exp_id) where every group of sign + passes and none of sign - does.

    segments: (query_id, group_ix, sign, seg_ix, seq, theta); a group passes when its hits reach the sum of its
    segments' thresholds. index: (exp_id, kmer).
    """
    keys = ("query_id", "group_ix", "sign", "seg_ix")
    group = ["query_id", "group_ix", "sign"]
    probe = probe_of(segments, spec, True, keys)
    cut = F.sum((F.col("total").cast("float") * F.col("theta").cast("float")).cast("double")).alias("cut")
    need = totals(probe, keys).join(segments.select(*keys, "theta"), list(keys)).groupBy(*group).agg(cut)
    hits = probe.join(index, "kmer").groupBy(*group, "exp_id").agg(F.sum("mult").alias("hits"))
    passed = hits.join(need, group).where("hits >= cut")
    wanted = segments.where("sign = '+'").groupBy("query_id").agg(F.countDistinct("group_ix").alias("groups"))
    plus = passed.where("sign = '+'").groupBy("query_id", "exp_id").agg(F.count("*").alias("n")).join(wanted, "query_id").where("n = groups")
    minus = passed.where("sign = '-'").select("query_id", "exp_id")
    return plus.select("query_id", "exp_id").join(minus, ["query_id", "exp_id"], "left_anti")


def with_overlap(segments: DataFrame, k: int) -> DataFrame:
    """Segments of a group cut from one sequence, each but the last lengthened by the first k - 1 letters of the next."""
    after = F.lead("seq").over(W.partitionBy("query_id", "group_ix", "sign").orderBy("seg_ix"))
    return segments.withColumn("seq", F.concat("seq", F.coalesce(F.substring(after, 1, k - 1), F.lit(""))))


#: Queries of a group of the tree plan: those whose open positions share rows.
GROUP = 64


def _node_hits(frontier: DataFrame, nodes: DataFrame) -> DataFrame:
    """frontier (grp, node_id, pos, mult, live) with the kind of node bit that each position hits; others are left out."""
    if "pos" in nodes.columns:
        return frontier.join(nodes, ["node_id", "pos"])
    at = frontier.withColumn("word_idx", _word(F.col("pos"))).join(nodes, ["node_id", "word_idx"])
    bit = lambda c: F.getbit(F.col(c), (F.col("pos") % 64).cast("int")) == 1
    kind = F.when(bit("sim"), "sim").when(bit("dif"), "dif")
    return at.select("grp", "node_id", "pos", "mult", "live", kind.alias("kind")).where("kind IS NOT NULL")


def _word(pos: Column) -> Column:
    return F.floor(pos / 64).cast("int")


def _grouped(probe: DataFrame, queries: DataFrame) -> DataFrame:
    """(query_id, total, theta, grp, bit): queries in groups of GROUP at most, neighbours by the least hash of their
    positions, so that queries with many positions in common tend to share a group."""
    need = probe.groupBy("query_id").agg(F.sum("mult").alias("total"), F.min(F.xxhash64("pos")).alias("near")).join(queries.select("query_id", "theta"), "query_id")
    n = F.monotonically_increasing_id()  # counts up within a partition, whose number is in higher bits than a group's
    placed = need.repartitionByRange("near").sortWithinPartitions("near").withColumn("n", n)
    return placed.select("query_id", "total", "theta", F.floor(F.col("n") / GROUP).alias("grp"), (F.col("n") % GROUP).cast("int").alias("bit"))


def tree_rounds(queries: DataFrame, tree: DataFrame, nodes: DataFrame, spec: HashSpec, levels: list[dict] | None = None) -> DataFrame:
    """(level, query_id, node_id, total, matched, open, sure, may): every node that a query reaches, from the root down.

    matched counts the positions in sims on the way and here, open those in the node's dif. A query's state is one row a
    node. Its open positions are not its own: a row (grp, node_id, pos, mult, live) is shared by the queries of a group,
    as bits of live, and leaves the frontier when no query that goes on needs it. levels, where given, takes a dict a
    round: rows of the frontier, and the rows that it would have without sharing.

    Nodes are cut to the words that any query looks up once, before the rounds. Rounds are tables in the shared folder,
    so plans stay short however deep the tree is; the result is read from there.
    """
    spark = queries.sparkSession
    base = scratch(spark)
    probe = stored(query_positions(queries, spec), f"{base}/probe")
    need = stored(_grouped(probe, queries), f"{base}/need")
    key = F.col("pos") if "pos" in nodes.columns else _word(F.col("pos"))
    name = "pos" if "pos" in nodes.columns else "word_idx"
    nodes = stored(nodes.join(probe.select(key.alias(name)).distinct(), name, "left_semi"), f"{base}/nodes")
    flag = F.bit_or(F.expr("shiftleft(1L, bit)"))
    root = tree.where("parent_id IS NULL").select("node_id")
    frontier = probe.join(need, "query_id").groupBy("grp", "pos", "mult").agg(flag.alias("live")).join(root)  # one root
    state = need.join(root).withColumn("matched", F.lit(0).cast("long"))
    children = tree.where("parent_id IS NOT NULL").select(F.col("parent_id").alias("node_id"), F.col("node_id").alias("child"))
    each = F.filter(F.sequence(F.lit(0), F.lit(GROUP - 1)), lambda i: F.getbit("live", i) == 1)
    of = lambda kind: F.sum(F.when(F.col("kind") == kind, F.col("mult")).otherwise(0))
    level = 0
    while True:
        seen = Observation()
        frontier = frontier.observe(seen, F.count("*").alias("rows"), F.sum(F.bit_count("live")).alias("unshared"))
        met = stored(_node_hits(frontier, nodes), f"{base}/met/{level}")
        if levels is not None:
            levels.append({"level": level, "rows": seen.get["rows"], "unshared": seen.get["unshared"] or 0})
        # rows are unfolded within a task and summed there before they are shuffled
        sums = met.select("grp", "node_id", "mult", "kind", F.explode(each).alias("bit")).groupBy("grp", "bit", "node_id").agg(of("sim").alias("now"), of("dif").alias("open"))
        at = state.join(sums, ["grp", "bit", "node_id"], "left").fillna(0, ["now", "open"]).withColumn("matched", F.col("matched") + F.col("now"))
        sure = at_least(F.col("matched"), F.col("total"), F.col("theta"))
        may = at_least(F.col("matched") + F.col("open"), F.col("total"), F.col("theta"))
        at = stored(at.drop("now").withColumns({"sure": sure, "may": may}), f"{base}/at/level={level}")
        going = at.where("may AND NOT sure")
        if going.isEmpty():
            break
        wanted = going.groupBy("grp", "node_id").agg(flag.alias("wanted"))
        needed = met.where("kind = 'dif'").join(wanted, ["grp", "node_id"]).withColumn("live", F.col("live").bitwiseAND(F.col("wanted"))).where("live <> 0")
        frontier = needed.join(children, "node_id").select("grp", F.col("child").alias("node_id"), "pos", "mult", "live")
        state = going.join(children, "node_id").select("grp", "bit", F.col("child").alias("node_id"), "query_id", "total", "theta", "matched")
        level += 1
    for done in ("probe", "need", "nodes", "met"):
        removed(spark, f"{base}/{done}")
    kinds = T.StructType([*at.schema.fields, T.StructField("level", T.IntegerType())])
    return spark.read.schema(kinds).parquet(f"{base}/at").select("level", "query_id", "node_id", "total", "matched", "open", "sure", "may")


def tree_query(queries: DataFrame, tree: DataFrame, nodes: DataFrame, spec: HashSpec, levels: list[dict] | None = None) -> DataFrame:
    """The rows (query_id, exp_id) of threshold_query, found from the root down, one level a round.

    nodes: node bits (node_id, pos, kind), or node words (node_id, word_idx, sim, dif), whose bits are read in place. At a
    node, hits in sim are settled for all below, hits in dif stay open. A query that cannot reach its threshold
    leaves the node; one that has reached it takes all experiments below; the others go on to both children with their
    open positions. levels is told of in tree_rounds.
    """
    rounds = tree_rounds(queries, tree, nodes, spec, levels)
    return leaves_below(rounds.where("sure").select("query_id", "node_id"), tree).select("query_id", "exp_id")
