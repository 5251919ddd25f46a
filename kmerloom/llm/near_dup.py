"""Operator 5: MinHash near-duplicates by an inverted join on signature coordinates.

1. A text is the set of hashes of its distinct shingles (2 words in the query); texts with equal sets form a class, and
   only each class's representative (smallest id) goes on.
2. Representatives get a signature of COORDS minima. A (coordinate, value) pair is an element with a posting list. A
   pair of texts that agrees in at least MATCHES elements shares one of the first COORDS - MATCHES + 1 elements of each,
   in order of rising frequency. Only those prefixes are posted; elements that occur once take their place in it unposted.
3. Two rounds join most of each group at about a pair a row: every text with the smallest id of its lists, then
   neighbours of different components. Lists that lie within one component are skipped from then on.
4. Of the other lists, short ones are merged: collisions of pairs of different components are counted, and a pair goes on
   if its count and the lists that were not merged can still reach MATCHES.
5. In long lists no pairs are formed. The members' differences from one text of the list, their hub, are posted instead:
   two texts differ by what their differences do not share, so linked texts of different components share a rare part
   of their differences, which a second prefix join finds (`around_hubs`, `sharing`). Members far from the hub are
   compared among each other. This is exact for any hub.
6. Pairs that agree in MATCHES coordinates of the whole signature are confirmed on their full sets.

A link at similarity 0.8 agrees in fewer than MATCHES = 13 of 32 coordinates with probability below 1e-6; links above
that less.

Null and empty texts, and texts of white space, have the empty set, no links and are kept. A null id is never linked
and its row is kept. Repeated rows share a class, so each gives the same row. Rows of one id with different texts
have their own classes; their links are confirmed by the least text. Very long texts are read whole. Empty tables give
no rows; extra columns are not read. Ties in frequency are ordered by the element.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kmerloom.llm.common import BASE_A, Workspace, mixed, n_partitions, prefix_sums, sliced, span_hash, table, utf8, word_spans
from kmerloom.llm.components import components

COORDS, MATCHES = 32, 13
#: Links hold where 100 * intersection >= PERCENT * union.
PERCENT = 80
#: Rows up to which a posting list is merged into pairs; longer ones go through their hub. It changes no result.
MERGED = 16

_A = np.random.default_rng(11).integers(0, 1 << 63, COORDS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_X = np.random.default_rng(12).integers(0, 1 << 63, COORDS, dtype=np.uint64)


def shingle_sets(data: np.ndarray, offsets: np.ndarray, words: int = 2) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text; A-Z count as a-z; a text with fewer words is one shingle."""
    upper = (data >= 65) & (data <= 90)
    low = data + (upper * np.uint8(32))
    start, end, doc = word_spans(low, offsets)
    h = span_hash(prefix_sums(low, BASE_A), start, end, BASE_A)
    first = np.searchsorted(doc, np.arange(len(offsets)))
    m = len(h) - words + 1
    s = np.zeros(max(m, 0), np.uint64)
    for i in range(words):
        s = mixed(s * np.uint64(3) + h[i : m + i]) if m > 0 else s
    out = []
    for a, b in zip(first[:-1].tolist(), first[1:].tolist()):
        if b - a >= words:
            out.append(np.unique(s[a : b - words + 1]))
        elif b > a:
            one = np.uint64(b - a)
            for x in h[a:b]:
                one = mixed(np.array([one * np.uint64(3) ^ x]))[0]
            out.append(np.array([one], np.uint64))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """(texts, COORDS) of 32-bit minima; rows of empty sets are meaningless."""
    sizes = np.array([len(s) for s in sets])
    out = np.zeros((len(sets), COORDS), np.uint32)
    some = np.flatnonzero(sizes)
    if len(some):
        flat = np.concatenate([sets[i] for i in some])
        at = np.concatenate([[0], np.cumsum(sizes[some])[:-1]])
        for j in range(COORDS):
            out[some, j] = np.minimum.reduceat(((flat ^ _X[j]) * _A[j] >> np.uint64(32)).astype(np.uint32), at)
    return out


def _features(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches, "text"):
            sets = shingle_sets(*utf8(b.column(1)), words)
            sig = signatures(sets)
            # the whole set in 128 bits: two sums of its mixed members
            keys = [(int(mixed(s).sum(dtype=np.uint64)), int(mixed(s ^ _X[0]).sum(dtype=np.uint64))) for s in sets]
            k1, k2 = (np.array([k[i] for k in keys], np.uint64).view(np.int64) for i in (0, 1))
            yield pa.record_batch(
                [b.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array(k1), pa.array(k2), pa.array([r.tobytes() for r in sig], pa.binary())],
                ["id", "n", "k1", "k2", "sig"],
            )

    return run


def _elements(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    place = np.arange(COORDS, dtype=np.int64) << 32
    for b in batches:
        sig = np.frombuffer(b"".join(b.column(1).to_pylist()), np.uint32).reshape(-1, COORDS)
        yield pa.record_batch([pa.array(np.repeat(np.asarray(b.column(0)), COORDS)), pa.array((sig.astype(np.int64) | place).ravel())], ["id", "element"])


def _sets(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches, "text"):
            sets = shingle_sets(*utf8(b.column(1)), words)
            yield pa.record_batch([b.column(0), pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64()))], ["id", "members"])

    return run


def _agree(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        x, y = (np.frombuffer(b"".join(b.column(i).to_pylist()), np.uint32).reshape(-1, COORDS) for i in (2, 3))
        on = np.flatnonzero((x == y).sum(1) >= MATCHES)
        yield pa.record_batch([b.column(0).take(pa.array(on)), b.column(1).take(pa.array(on))], ["a", "b"])


def posted(reps: DataFrame) -> DataFrame:
    """(element, id, n, m): for each text the elements of its prefix that occur at least twice; m of all do."""
    elements = reps.select("id", "sig").mapInArrow(_elements, "id long, element long")
    often = elements.groupBy("element").count().where("count > 1")
    prefix = COORDS - MATCHES + 1
    by = elements.join(often, "element").groupBy("id").agg(F.sort_array(F.collect_list(F.struct("count", "element"))).alias("e"))
    rest = F.greatest(F.lit(0), F.lit(prefix - COORDS) + F.size("e"))
    rows = by.select("id", F.size("e").alias("m"), F.explode(F.slice("e", F.lit(1), rest)).alias("e"))
    return rows.select("e.element", "id", "m").join(reps.select("id", "n"), "id").select("element", "id", "n", "m")


def alike(pairs: DataFrame, reps: DataFrame) -> DataFrame:
    """Of pairs (a, b), those that agree in at least MATCHES coordinates."""
    s = reps.select("id", "sig")
    both = pairs.join(s.toDF("a", "sa"), "a").join(s.toDF("b", "sb"), "b").select("a", "b", "sa", "sb")
    return both.mapInArrow(_agree, "a long, b long")


def measured(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """(a, b, common, union) of the full sets of pairs (a, b)."""
    both = pairs.join(sets.toDF("a", "ma"), "a").join(sets.toDF("b", "mb"), "b")
    sizes = both.select("a", "b", F.size(F.array_intersect("ma", "mb")).alias("common"), (F.size("ma") + F.size("mb")).alias("n"))
    return sizes.select("a", "b", "common", (F.col("n") - F.col("common")).alias("union"))


def linked(pairs: DataFrame) -> DataFrame:
    return pairs.where(F.col("common") * 100 >= F.col("union") * PERCENT).select("a", "b")


def sets_table(docs: DataFrame, ids: DataFrame, words: int) -> str:
    """Name of a table (id, members) of the ids (id), bucketed by id. Of rows of one id, the least text counts.

    Every round asks for some of these sets: texts are dealt by id once, and rounds only ship their ids. The table is
    the caller's to drop.
    """
    spark, name = docs.sparkSession, f"kmerloom_sets_{uuid.uuid4().hex}"
    n = n_partitions(spark)
    texts = docs.join(ids, "id", "left_semi").repartition(n, "id").groupBy("id").agg(F.min("text").alias("text"))
    texts.mapInArrow(_sets(words), "id long, members array<long>").write.bucketBy(n, "id").saveAsTable(name)
    return name


def _sizes_fit(a: str, b: str):
    return (F.col(a) * 100 >= F.col(b) * PERCENT) & (F.col(b) * 100 >= F.col(a) * PERCENT)


def labelled(post: DataFrame, group: DataFrame) -> DataFrame:
    """(element, id, n, m, c, k): the lists of k rows in which texts of different components c meet."""
    named = post.join(group, post["id"] == group["node"], "left").select("element", "id", "n", "m", F.coalesce("component", "id").alias("c"))
    mixed_up = named.groupBy("element").agg(F.min("c").alias("lo"), F.max("c").alias("hi"), F.count("*").alias("k")).where("lo < hi")
    return named.join(mixed_up.select("element", "k"), "element")


def neighbours(here: DataFrame, reps: DataFrame) -> DataFrame:
    """Pairs of different components that are neighbours under an element, ordered by the coordinates after it.

    Texts that agree in a run of coordinates stand together, so nearly every text meets one that it is linked to, at
    one pair a row. Rows are dealt by ranges of that order, not by element: a frequent element is spread.
    """
    after = F.expr("substring(concat(sig, sig), cast(shiftright(element, 32) AS int) * 4 + 5, 16)")
    rows = here.join(reps.select("id", "sig"), "id").select("element", after.alias("order"), "id", "n", "c")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None
        for batch in batches:
            e, i, n, c = (np.asarray(batch.column(x)) for x in (0, 2, 3, 4))
            if last is not None:
                e, i, n, c = (np.concatenate([[x], y]) for x, y in zip(last, (e, i, n, c)))
            if not len(e):
                continue
            last = e[-1], i[-1], n[-1], c[-1]
            on = (e[1:] == e[:-1]) & (c[1:] != c[:-1]) & (100 * np.minimum(n[1:], n[:-1]) >= PERCENT * np.maximum(n[1:], n[:-1]))
            x, y = i[1:][on], i[:-1][on]
            yield pa.record_batch([pa.array(np.minimum(x, y)), pa.array(np.maximum(x, y))], ["a", "b"])

    dealt = rows.repartitionByRange(n_partitions(here.sparkSession), "element", "order").sortWithinPartitions("element", "order", "id")
    return dealt.mapInArrow(run, "a long, b long").distinct()


def _sides(rows: DataFrame, other: DataFrame, on: list[str]) -> DataFrame:
    """rows and other joined, their further columns with 1 and 2 after their names."""
    named = lambda df, x: df.select(*on, *(F.col(c).alias(c + x) for c in df.columns if c not in on))
    return named(rows, "1").join(named(other, "2"), on)


def counted(short: DataFrame) -> DataFrame:
    """Pairs (a, b) of different components that may agree in MATCHES elements, by merging the short lists.

    The lists hold s of a text's m repeated elements; a pair that collides in h of them agrees in at most
    h + min(m - s) in all.
    """
    merged = short.groupBy("id").agg(F.count("*").alias("s"))
    rows = short.join(merged, "id").select("element", "id", "n", "c", (F.col("m") - F.col("s")).alias("left"))
    met = _sides(rows, rows, ["element"]).where("id1 < id2 AND c1 <> c2").where(_sizes_fit("n1", "n2"))
    hits = met.groupBy(F.col("id1").alias("a"), F.col("id2").alias("b")).agg(F.count("*").alias("h"), F.first(F.least("left1", "left2")).alias("left"))
    return hits.where(F.col("h") + F.col("left") >= MATCHES).select("a", "b")


def around_hubs(long: DataFrame, sets: DataFrame, kept) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(links, core, outer) of the long lists (element, id, n, m, c).

    A list's hub is the least text of its largest component, and d the size of the symmetric difference of a text and
    the hub, which is a distance: linked texts are at most a ninth (at 80 percent) of n1 + n2 apart, so their d differ
    by no more. Rows with d above a quarter of the hub's size are the outer part of their list, to be compared among
    each other; core (hub, id, c, n, nh, d, items) has those below that, and those that may be linked to one of them,
    with the members of their differences. links (a, b) are those of texts with their hubs.
    """
    sizes = long.groupBy("element", "c").agg(F.count("*").alias("k")).groupBy("element").agg(F.max_by("c", F.struct("k", "c")).alias("hub"))
    named = kept(long.drop("k").join(sizes, "element"))
    both = named.select("hub", "id", "c").distinct().join(sets, "id").join(sets.toDF("hub", "other"), "hub")
    n, nh = F.size("members"), F.size("other")
    own = both.select("hub", "id", "c", n.alias("n"), nh.alias("nh"), F.array_except("members", "other").alias("more"), F.array_except("other", "members").alias("less"))
    own = own.withColumn("d", F.size("more") + F.size("less"))
    # the furthest that a text linked to x can be from x: sizes of linked texts differ by the factor PERCENT / 100
    reach = F.col("n") * ((1 + 100 / PERCENT) * (100 - PERCENT) / (100 + PERCENT)) + 0.001
    items = F.when(F.col("d") <= F.col("nh") / 4 + reach, F.concat("more", F.transform("less", F.bitwise_not)))
    own = kept(own.select("hub", "id", "c", "n", "nh", "d", items.alias("items")))
    far = own.where("d > nh / 4").select("hub", "id")
    outer = named.join(far, ["hub", "id"]).select("element", "id", "n", "m", "c")
    again = outer.groupBy("element").agg(F.min("c").alias("lo"), F.max("c").alias("hi"), F.count("*").alias("k")).where("lo < hi").select("element", "k")
    links = own.where((F.col("d") * (100 + PERCENT) <= (F.col("n") + F.col("nh")) * (100 - PERCENT)) & (F.col("c") != F.col("hub")))
    core = own.where("items IS NOT NULL AND d > 0")
    return links.select(F.least("id", "hub").alias("a"), F.greatest("id", "hub").alias("b")), core, kept(outer.join(again, "element"))


def sharing(own: DataFrame, kept) -> DataFrame:
    """Pairs (a, b) of different components that may be linked, of own (hub, id, c, n, nh, d, items).

    items are the members of a text's difference D from its hub, d of them; without a hub (null, of size 0) they are
    its whole set. Two texts of one hub differ in d1 + d2 - 2 * |D1 and D2| shingles. Two that are linked to the hub are
    in one component, and any other linked pair must share a member of D1 and D2. With each D in order of rising
    frequency in the hub's group, what a pair shares lies after its first common place in both, which bounds it from
    above; places too late for any partner are not posted at all.
    """
    above, below = 100 + PERCENT, 100 - PERCENT
    own = own.withColumn("near", F.col("d") * above <= (F.col("n") + F.col("nh")) * below).withColumn("far", F.col("hub").isNull()).withColumn("hub", F.coalesce("hub", F.lit(0)))
    items = own.select("hub", "far", "id", F.explode("items").alias("item"))
    often = items.groupBy("hub", "far", "item").count().where("count > 1")
    ranked = items.join(often, ["hub", "far", "item"]).groupBy("hub", "far", "id").agg(F.sort_array(F.collect_list(F.struct("count", "item"))).alias("e"))
    # twice the number that a pair must share: a partner's size is in reach, and its distance to the hub at least the
    # difference of their sizes; a partner of a text that is linked to the hub is not linked to it
    r, n, nh, d = below / above, F.col("n"), F.col("nh"), F.col("d")
    size = F.greatest(n * (PERCENT / 100), F.least(n * (100 / PERCENT), nh))
    twice = d - r * n + F.when(F.col("near"), nh * r).otherwise(F.abs(size - nh) - r * size)
    last = d - F.greatest(F.lit(1), F.ceil(twice / 2 - 0.001)).cast("int")
    placed = own.drop("items").join(ranked, ["hub", "far", "id"]).withColumn("alone", d - F.size("e"))
    placed = placed.withColumn("e", F.slice("e", F.lit(1), F.greatest(F.lit(0), last - F.col("alone") + 1)))
    rows = placed.select("hub", "far", "id", "c", "n", "near", "d", "alone", F.posexplode("e").alias("at", "e"))
    rows = kept(rows.select("hub", "far", "e.item", "id", "c", "n", "near", "d", (d - F.col("alone") - F.col("at")).alias("rest")))
    may = (F.col("d1") + F.col("d2") - 2 * F.least("rest1", "rest2")) * above <= (F.col("n1") + F.col("n2")) * below
    met = _sides(rows.where("NOT near"), rows, ["hub", "far", "item"]).where("c1 <> c2 AND (near2 OR id1 < id2)").where(_sizes_fit("n1", "n2") & may)
    return met.select(F.least("id1", "id2").alias("a"), F.greatest("id1", "id2").alias("b")).distinct()


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", words: int = 2) -> DataFrame:
    """By shingles of `words` words. Per row of docs: key, n_shingles, component_id and kept (this is the row of the component's smallest id)."""
    with Workspace(docs.sparkSession) as space:
        own = docs.select(F.col(key).cast("long").alias("id"), F.col(text).alias("text"))
        feats = space.stored(own.mapInArrow(_features(words), "id long, n long, k1 long, k2 long, sig binary"))
        some = feats.where("n > 0 AND id IS NOT NULL")
        reps = space.stored(some.groupBy("k1", "k2", "n").agg(F.min("id").alias("id"), F.min_by("sig", "id").alias("sig")))
        group = linked_groups(own, reps, words, space)

        named = reps.select("k1", "k2", "n", F.col("id").alias("rep")).join(group, F.col("rep") == F.col("node"), "left")
        named = named.select("k1", "k2", "n", F.coalesce("component", "rep").alias("component"))
        out = feats.select("id", "n", "k1", "k2").join(named, ["k1", "k2", "n"], "left")
        component = F.when(F.col("n") > 0, F.when(F.col("id").isNotNull(), F.col("component"))).otherwise(F.col("id"))
        result = out.select(F.col("id").alias(key), F.col("n").alias("n_shingles"), component.alias("component_id"))
        return space.result(result.withColumn("kept", F.coalesce(F.col(key) == F.col("component_id"), F.lit(True))))


def linked_groups(docs: DataFrame, reps: DataFrame, words: int, space: Workspace) -> DataFrame:
    """(node, component) of the representatives that are linked: docs (id, text), reps (id, n, sig)."""
    post = space.stored(posted(reps))
    name = sets_table(docs, post.select("id").distinct(), words)
    try:
        sets = docs.sparkSession.table(name)
        confirmed = lambda pairs: space.stored(linked(measured(space.stored(alike(pairs, reps)), sets)))

        # every text with a leader that it agrees with
        leader = post.groupBy("element").agg(F.min(F.struct("id", "n")).alias("l")).select("element", F.col("l.id").alias("b"), F.col("l.n").alias("nb"))
        met = post.join(leader, "element").where("id <> b").where(_sizes_fit("n", "nb")).select(F.col("id").alias("a"), "b").distinct()
        first = space.stored(alike(met, reps).groupBy("a").agg(F.min("b").alias("b")))
        links = space.stored(linked(measured(first, sets)))
        group = components(links, "a", "b", space)

        # neighbours of different components
        links = links.unionByName(confirmed(neighbours(space.stored(labelled(post, group)), reps)))
        group = components(links, "a", "b", space)

        # the rest: short lists are merged, long ones compared by differences from their hubs; what lies far from those
        # is short, or compared by its rarest shingles
        here = space.stored(labelled(post, group))
        sure, core, outer = around_hubs(here.where(F.col("k") > MERGED), sets, space.stored)
        short = here.unionByName(outer).where(F.col("k") <= MERGED)
        far = outer.where(F.col("k") > MERGED).select("id", "c").distinct().join(sets, "id")
        far = far.select(F.lit(None).cast("long").alias("hub"), "id", "c", F.size("members").alias("n"), F.lit(0).alias("nh"), F.size("members").alias("d"), F.col("members").alias("items"))
        pairs = counted(short).unionByName(sharing(core.unionByName(far), space.stored)).distinct()
        return components(links.unionByName(sure).unionByName(confirmed(pairs)), "a", "b", space)
    finally:
        docs.sparkSession.sql(f"DROP TABLE IF EXISTS {name}")


def op5_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


#: DuckDB: all pairs that share a shingle, by a join on shingles, confirmed, and the least id that each reaches.
OP5_SQL = r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, CASE WHEN len(w) = 1 THEN w[1] ELSE w[i] || ' ' || w[i + 1] END AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w), 2))) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 80 * (x.n + y.n - k)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r(id, c) AS (SELECT doc_id, doc_id FROM n UNION SELECT e.b, r.c FROM r JOIN e ON e.a = r.id WHERE r.c < e.b),
c AS (SELECT id AS doc_id, min(c) AS c FROM r GROUP BY 1)
SELECT doc_id, coalesce(n, 0)::BIGINT AS n_shingles, coalesce(c, doc_id) AS component_id, coalesce(coalesce(c, doc_id) = doc_id, true) AS kept
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN c USING (doc_id)
"""
