"""Operator 10: mix sources to target weights by a low-discrepancy schedule, in DataFrame functions only.

Each source's documents are shuffled by a seeded hash and laid end to end; that stream, repeated `max_repeat` times,
is cut into blocks of equal token counts. Golden-ratio points mapped through the cumulative shares of blocks deal the
slots to sources; the r-th slot of a source takes its r-th block, and the last block ends at the target.

The result says where each document stands: slot0, slot1, ... are those of the first block that each of its repeats is
in, and start is its place in its source's stream, so ordering the repeats by slot and place gives the mix.

Null texts have size 0 and are never taken; very long ones fill many blocks, and only their sizes are shuffled. Other
columns are not read. A null source is a source of its own, ordered last. Repeated rows are
separate rows of the stream. Empty tables give empty results. The same input gives the same rows whatever its order.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from kmerloom.llm.common import checkpointed, table, words

#: Weights by rank of the source, share of all sizes that is mixed, repeats of a document at most.
WEIGHTS = (5, 2, 1)
TOTAL_SHARE, MAX_REPEAT = 1.5, 2
#: Tokens of a block at most; smaller where the smallest share needs it.
BLOCK = 4096
GOLDEN = (math.sqrt(5) - 1) / 2


def source_targets(sizes: DataFrame, weights=WEIGHTS, share: float = TOTAL_SHARE, repeat: int = MAX_REPEAT) -> DataFrame:
    """(source, source_size, weight, target): shares by weight, none above `repeat` times its size, the rest reshared.

    The level at which shares stop growing is found in closed form: with sources ordered by cap / weight, the first k
    are at their cap and the others share what is left. One row a source; the windows order sources only.
    """
    by = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    n = len(weights)
    rank = F.row_number().over(W.orderBy(F.col("source").isNull(), F.col("source"))) - 1
    weight = F.element_at(F.array(*map(F.lit, weights)), (rank % n + 1).cast("int")).cast("double")
    cap = (F.lit(repeat) * F.col("source_size")).cast("double")
    order = W.orderBy(F.col("cap") / F.col("weight"), F.col("source").isNull(), F.col("source"))
    upto = order.rowsBetween(W.unboundedPreceding, W.currentRow)
    everyone = W.orderBy(F.lit(0)).rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    x = (
        by.withColumns({"weight": weight, "cap": cap})
        .withColumns(
            {
                "total": F.sum("source_size").over(everyone) * share,
                "cap_before": F.coalesce(F.sum("cap").over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0)),
                "weight_left": F.sum("weight").over(everyone) - F.sum("weight").over(upto) + F.col("weight"),
            }
        )
        .withColumn("level", (F.col("total") - F.col("cap_before")) / F.col("weight_left"))
    )
    # levels rise while capped sources are set aside and fall after that: the largest is the one that holds
    level = F.max("level").over(everyone)
    target = F.least(F.col("cap"), level * F.col("weight"))
    return x.withColumn("target", target).select("source", "source_size", "weight", "target")


def block_size(targets: DataFrame, most: int = BLOCK) -> int:
    """Tokens of a block: a two-hundredth of the smallest target, between 1/64 of `most` and `most`."""
    least = targets.where("target > 0").agg(F.min("target")).first()[0]
    return int(max(most // 64, min(most, (least or 0) // 200)))


def schedule(targets: DataFrame, block: int) -> DataFrame:
    """(slot, source, rank): the order in which sources give blocks; every source gets ceil(target / block) slots.

    Slot i takes the point frac(i * golden ratio) through the cumulative shares. Ranks are counted within stretches of
    slots first and then across stretches, so no source is ranked in one task. Points beyond a source's quota are
    passed over; slots that the points leave short come last, in order of source.
    """
    quota = targets.where("target > 0").select("source", F.ceil(F.col("target") / block).alias("quota"))
    order = W.orderBy(F.col("source").isNull(), F.col("source")).rowsBetween(W.unboundedPreceding, W.currentRow)
    shares = checkpointed(quota.withColumn("upto", F.sum("quota").over(order)))
    total = shares.agg(F.sum("quota")).first()[0] or 0
    spark = targets.sparkSession
    # the line of shares is cut into equal cells, so that looking up a point is a join on its cell
    width = max(1, total // (4 * max(1, shares.count())))
    cells = shares.withColumn("cell", F.explode(F.sequence(F.floor((F.col("upto") - F.col("quota")) / width), F.floor((F.col("upto") - 1) / width))))
    points = spark.range(0, 2 * total).select(
        F.col("id").alias("slot"),
        F.least(F.floor(F.col("id") * GOLDEN % 1.0 * total), F.lit(total - 1)).alias("at"),
        F.floor(F.col("id") / (1 + math.isqrt(2 * total))).alias("stretch"),
    )
    dealt = points.withColumn("cell", F.floor(F.col("at") / width)).join(cells, "cell").where("at < upto AND at >= upto - quota").drop("cell")
    inside = W.partitionBy("source", "stretch").orderBy("slot")
    counts = dealt.groupBy("source", "stretch").agg(F.count("*").alias("n"))
    base = counts.select(
        "source",
        "stretch",
        (F.sum("n").over(W.partitionBy("source").orderBy("stretch")) - F.col("n")).alias("before"),
    )
    ranked = dealt.select("source", "stretch", "slot", "quota", F.row_number().over(inside).alias("r")).join(
        base.withColumnRenamed("source", "s").withColumnRenamed("stretch", "k"),
        F.col("source").eqNullSafe(F.col("s")) & (F.col("stretch") == F.col("k")),
    )
    got = ranked.select("slot", "source", (F.col("before") + F.col("r") - 1).alias("rank"), "quota").where("rank < quota").drop("quota")
    have = dealt.groupBy(F.col("source").alias("s")).agg(F.count("*").alias("have"))
    late = (
        shares.join(have, F.col("source").eqNullSafe(F.col("s")), "left")
        .withColumn("have", F.coalesce("have", F.lit(0)))
        .where("have < quota")
        .select("source", (F.col("upto") - F.col("quota")).alias("from"), F.explode(F.sequence("have", F.col("quota") - 1)).alias("rank"))
    )
    return got.unionByName(late.select((F.lit(2 * total) + F.col("from") + F.col("rank")).alias("slot"), "source", "rank"))


def placed(docs: DataFrame, seed: int = 7) -> DataFrame:
    """docs plus start: tokens of its source before it, in the seeded order.

    Sums run over pieces of the hash range first and then inside each; there are as many pieces as documents in one.
    """
    pieces = max(1, math.isqrt(docs.count()))
    h = F.md5(F.concat_ws(":", F.lit(seed), F.col("doc_id"), F.col("size")).cast("binary"))
    # the leading hex digits of the hash, so pieces follow the order
    part = F.floor(F.conv(F.substring("_h", 1, 8), 16, 10).cast("long") * pieces / 2**32)
    x = docs.withColumn("_h", h).withColumn("_p", part)
    inside = W.partitionBy("source", "_p").orderBy("_h", "doc_id", "size", "row").rowsBetween(W.unboundedPreceding, W.currentRow)
    sums = x.groupBy(F.col("source").alias("_s"), F.col("_p").alias("_q")).agg(F.sum("size").alias("_n"))
    across = W.partitionBy("_s").orderBy("_q").rowsBetween(W.unboundedPreceding, -1)
    sums = sums.select("_s", "_q", F.coalesce(F.sum("_n").over(across), F.lit(0)).alias("_before"))
    return (
        x.withColumn("_in", F.sum("size").over(inside) - F.col("size"))
        .join(sums, F.col("source").eqNullSafe(F.col("_s")) & (F.col("_p") == F.col("_q")))
        .withColumn("start", F.col("_before") + F.col("_in"))
        .drop("_h", "_p", "_in", "_s", "_q", "_before")
    )


def mix(docs: DataFrame, most: int = BLOCK, keep: tuple[str, ...] = ()) -> DataFrame:
    """docs has (doc_id, source, size); returns them and row, source_size, target, taken, slot, start and, of each repeat
    p, passp (the words taken) and slotp; keep: further columns of docs that the result carries.

    slot is the least of the repeats' ones; slots are null where nothing is taken. Text never moves: only sizes are shuffled.
    """
    sized = checkpointed(docs.select("doc_id", "source", "size", *keep, F.monotonically_increasing_id().alias("row")))
    targets = checkpointed(source_targets(sized))
    block = block_size(targets, most)
    slots = schedule(targets, block)
    t = targets.select(F.col("source").alias("_s"), "source_size", "target")
    at = checkpointed(placed(sized).join(t, F.col("source").eqNullSafe(F.col("_s"))).drop("_s"))
    begin = F.col("start") + F.col("pass") * F.col("source_size")
    pieces = (
        at.where("size > 0")
        .withColumn("pass", F.explode(F.sequence(F.lit(0), F.lit(MAX_REPEAT - 1))))
        .withColumn("begin", begin)
        .where("begin < floor(target)")
        .withColumn("end", F.least(F.col("begin") + F.col("size"), F.floor("target")))
        .select("row", "source", "pass", "begin", "end", F.explode(F.sequence(F.floor(F.col("begin") / block), F.floor((F.col("end") - 1) / block))).alias("block"))
    )
    slot = slots.select(F.col("source").alias("_s"), F.col("rank").alias("_r"), "slot")
    hit = pieces.join(slot, F.col("source").eqNullSafe(F.col("_s")) & (F.col("block") == F.col("_r")))
    part = F.least("end", (F.col("block") + 1) * block) - F.greatest("begin", F.col("block") * block)
    taken = hit.groupBy(F.col("row").alias("_row")).agg(
        F.sum(part).alias("taken"),
        F.min("slot").alias("slot"),
        *(F.sum(F.when(F.col("pass") == p, part).otherwise(0)).alias(f"pass{p}") for p in range(MAX_REPEAT)),
        *(F.min(F.when(F.col("pass") == p, F.col("slot"))).alias(f"slot{p}") for p in range(MAX_REPEAT)),
    )
    cols = ["taken", *(f"pass{p}" for p in range(MAX_REPEAT))]
    return (
        at.join(taken, F.col("row") == F.col("_row"), "left")
        .withColumns({c: F.coalesce(c, F.lit(0)).cast("long") for c in cols})
        .select("doc_id", "source", *keep, "row", "size", "source_size", "target", "slot", "start", *cols, *(f"slot{p}" for p in range(MAX_REPEAT)))
    )


def op10_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", F.size(words(F.col("text"))).cast("long").alias("size"))
    return mix(docs).select("doc_id", "size", "source_size", "target", "taken", "slot")


#: DuckDB: places by sums over each source, and the schedule by its points.
OP10_SQL = rf"""
WITH RECURSIVE d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size, [5.0, 2.0, 1.0][((row_number() OVER (ORDER BY source NULLS LAST)) - 1) % 3 + 1]::DOUBLE AS w FROM d GROUP BY 1),
fill(step, source, source_size, w, target, capped) AS (
  SELECT 0, source, source_size, w, 0::DOUBLE, false FROM s
  UNION ALL
  SELECT step + 1, source, source_size, w, least(2.0 * source_size, lev * w), lev * w >= 2.0 * source_size FROM (
    SELECT *, (1.5 * sum(source_size) OVER () - coalesce(sum(CASE WHEN capped THEN 2.0 * source_size END) OVER (), 0)) / nullif(sum(CASE WHEN NOT capped THEN w END) OVER (), 0) AS lev_new,
      CASE WHEN capped THEN 1e300 ELSE lev_new END AS lev FROM fill WHERE step < 60)),
t AS (SELECT source, source_size, target FROM fill WHERE step = 60),
o AS (SELECT row_number() OVER () AS r, doc_id, d.source, size, source_size, target, sum(size) OVER (PARTITION BY d.source ORDER BY md5('7:' || coalesce(doc_id || ':', '') || size), doc_id ROWS UNBOUNDED PRECEDING) - size AS start
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
k AS (SELECT greatest({BLOCK // 64}, least({BLOCK}, floor(coalesce(min(target), 0) / 200)))::BIGINT AS block FROM t WHERE target > 0),
q AS (SELECT source, ceil(target / block)::BIGINT AS quota, sum(ceil(target / block)::BIGINT) OVER (ORDER BY source NULLS LAST)::BIGINT AS upto FROM t, k WHERE target > 0),
a AS (SELECT coalesce(sum(quota), 0)::BIGINT AS total FROM q),
p AS (SELECT i AS slot, least(floor((i * {GOLDEN!r}::DOUBLE) % 1.0::DOUBLE * total)::BIGINT, total - 1) AS pt FROM (SELECT total, unnest(range(0, 2 * total)) AS i FROM a)),
h AS (SELECT slot, source, quota, row_number() OVER (PARTITION BY source ORDER BY slot) - 1 AS rank FROM p JOIN q ON pt < upto AND pt >= upto - quota),
n AS (SELECT source, count(*) AS have FROM h GROUP BY 1),
late AS (SELECT q.source, upto - quota AS lo, unnest(range(coalesce(have, 0), quota)) AS rank FROM q LEFT JOIN n ON q.source IS NOT DISTINCT FROM n.source),
slots AS (SELECT slot, source, rank FROM h WHERE rank < quota UNION ALL SELECT 2 * total + lo + rank, source, rank FROM late, a),
e AS (SELECT r, source, start + pass * source_size AS b, least(start + pass * source_size + size, floor(target)::BIGINT) AS e FROM o, (VALUES (0), (1)) v(pass) WHERE size > 0 AND start + pass * source_size < floor(target)),
f AS (SELECT r, source, unnest(range((b // block)::BIGINT, ((e - 1) // block + 1)::BIGINT)) AS block FROM e, k),
g AS (SELECT f.r, min(slot)::BIGINT AS slot FROM f JOIN slots ON f.source IS NOT DISTINCT FROM slots.source AND f.block = slots.rank GROUP BY 1)
SELECT doc_id, size, source_size, target,
  (greatest(0, least(start + size, floor(target)) - start) + greatest(0, least(start + source_size + size, floor(target)) - start - source_size))::BIGINT AS taken, slot
FROM o LEFT JOIN g USING (r)
"""
