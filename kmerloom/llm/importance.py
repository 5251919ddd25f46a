"""Operator 11: importance resampling towards a target, from a position table of n-grams.

Every text is exploded into rows (row, pos, word); for orders above one, window lead() puts the following words behind
each. n-grams are hashed into buckets, counted over all documents and over the target, and the gains of the buckets are
joined to the positions again and averaged by document. Seeded Gumbel noise on top of a weight makes the largest scores
a sample without replacement.

A text's positions are windowed in stretches that overlap by the words a gram reaches over, so a very long text is no
hot key. Counts and sums combine before their shuffles, so neither a frequent word nor a frequent bucket is one. Ranks
come from a range partition by score, id and row, so ties and copies of one id are dealt out too. The only table that is
broadcast has a row a bucket, or a row a partition.

Null and empty texts have no features: weight 0. A null id is hashed as the empty text and ranks after all ids among
equal scores. Repeated rows are rows of their own. Only the key and the text are read; other columns may have any names.
Empty tables give no rows; with an empty target all gains follow from t = T = 0.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from kmerloom.llm.common import Workspace, n_partitions, table

#: The words of a text before A-Z are lower-cased, orders of grams, buckets, seed, share drawn in percent of
#: the documents with at least MIN_WORDS words.
WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
ORDERS, BUCKETS, SEED, PERCENT, MIN_WORDS = 1, 10_000, 2024, 10, 20
#: Positions of a text that one window holds.
STRETCH = 1 << 16
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Rows of a partition have monotonically increasing ids whose lower bits count from 0.
_PART_BITS = 33


def position_table(docs: DataFrame, text: str = "text") -> DataFrame:
    """All other columns of docs, pos and word, one row a word; a text without words has one row, both null."""
    keep = [F.col(f"`{c}`") for c in docs.columns if c != text]
    rows = docs.select(*keep, F.posexplode_outer(F.regexp_extract_all(F.col(f"`{text}`"), F.lit(WORD), F.lit(0))).alias("pos", "word"))
    # lower() is fast but maps other letters too, which ASCII words do not have
    low = F.when(F.octet_length("word") == F.char_length("word"), F.lower("word")).otherwise(F.translate("word", _UPPER, _LOWER))
    return rows.withColumn("word", low)


def grams(positions: DataFrame, orders: int = ORDERS, stretch: int = STRETCH) -> DataFrame:
    """positions with gram instead of word: a row for every run of 1 to `orders` words. row must tell texts apart."""
    if orders == 1:
        return positions.withColumnRenamed("word", "gram")
    keep = [c for c in positions.columns if c != "word"]
    home = F.floor(F.col("pos") / stretch)
    lent = (F.col("pos") % stretch < orders - 1) & (F.col("pos") >= stretch)
    # the first words of a stretch also close the grams of the stretch before it
    at = F.array_compact(F.array(F.struct(home.alias("s"), F.lit(True).alias("own")), F.when(lent, F.struct((home - 1).alias("s"), F.lit(False).alias("own")))))
    cut = positions.withColumn("_at", F.explode(at)).select(*keep, "word", F.col("_at.s").alias("_s"), F.col("_at.own").alias("_own"))
    order = W.partitionBy("row", "_s").orderBy("pos")
    following = [F.lead("word", n).over(order) for n in range(1, orders)]
    named = cut.withColumns({f"_w{n}": w for n, w in enumerate(following, 1)}).where("_own")
    runs = [F.col("word"), *(F.when(F.col(f"_w{n}").isNotNull(), F.concat_ws(" ", "word", *(f"_w{i}" for i in range(1, n + 1)))) for n in range(1, orders))]
    # one row stays for a text without words
    return named.select(*keep, F.explode(F.when(F.col("word").isNull(), F.array(F.lit(None).cast("string"))).otherwise(F.array_compact(F.array(*runs)))).alias("gram"))


def bucket_of(gram: Column, buckets: int = BUCKETS) -> Column:
    return F.crc32(gram.cast("binary")) % buckets


def gains(docs: DataFrame, target: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """(bucket, gain) of every bucket that grams (gram) of docs or target fall into: at most `buckets` rows.

    gain: floor of 1000 times the logarithm of the target's smoothed share of the bucket over the documents' one.
    """
    count = lambda g: g.where("gram IS NOT NULL").groupBy(bucket_of(F.col("gram"), buckets).alias("bucket")).agg(F.count("*").alias("n"))
    zero = F.lit(0).cast("long")
    both = count(docs).select("bucket", F.col("n").alias("s"), zero.alias("t")).unionByName(count(target).select("bucket", zero.alias("s"), F.col("n").alias("t")))
    by = both.groupBy("bucket").agg(F.sum("s").cast("double").alias("s"), F.sum("t").cast("double").alias("t"))
    everything = W.partitionBy()  # a row a bucket
    total = {"S": F.sum("s").over(everything), "T": F.sum("t").over(everything)}
    ratio = (F.col("t") + 1) * (F.col("S_") + buckets) / ((F.col("s") + 1) * (F.col("T_") + buckets))
    return by.withColumns({f"{c}_": v for c, v in total.items()}).select("bucket", F.floor(F.ln(ratio) * 1000).cast("long").alias("gain"))


def weighted(positions: DataFrame, gain: DataFrame, keys: list[str], orders: int = ORDERS, buckets: int = BUCKETS) -> DataFrame:
    """(keys, n_words, n_features, weight): the floored mean of the gains of a document's grams."""
    rows = grams(positions, orders).withColumn("bucket", bucket_of(F.col("gram"), buckets))
    met = rows.join(F.broadcast(gain), "bucket", "left")  # bounded by the number of buckets
    sums = met.groupBy(*keys).agg((F.coalesce(F.max("pos"), F.lit(-1)) + 1).cast("long").alias("n_words"), F.count("gram").alias("n_features"), F.coalesce(F.sum("gain"), F.lit(0)).alias("_sum"))
    mean = F.when(F.col("n_features") == 0, 0).otherwise(F.expr("(_sum - pmod(_sum, n_features)) div n_features"))
    return sums.select(*keys, "n_words", "n_features", mean.cast("long").alias("weight"))


def noise(key: Column, seed: int = SEED) -> Column:
    """1000 times a Gumbel variate that follows from seed and key, floored."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))).cast("binary"), 256)
    u = (F.conv(F.substring(digest, 1, 8), 16, 10).cast("long").cast("double") + 0.5) / 4294967296.0
    return F.floor(F.ln(-F.ln(u)) * -1000).cast("long")


def drawn(scored: DataFrame, space: Workspace, key: str, percent: int = PERCENT, least: int = MIN_WORDS) -> DataFrame:
    """scored (key, row, n_words, score) plus rank: 1, 2, ... for the drawn share of documents with at least `least` words.

    Rows are range-partitioned in the order of the draw, numbered inside their partition, and numbered on from one
    partition to the next by the partitions' counts.
    """
    able = F.col("n_words") >= least
    order = [F.when(able, 0).otherwise(1), F.col("score").desc(), F.col(f"`{key}`").asc_nulls_last(), F.col("row")]
    dealt = scored.repartitionByRange(n_partitions(scored.sparkSession), *order).sortWithinPartitions(*order)
    rows = space.stored(dealt.withColumn("_at", F.monotonically_increasing_id()))
    part = F.shiftright("_at", _PART_BITS)
    counts = rows.groupBy(part.alias("_part")).agg(F.count_if(able).alias("_n"))
    upto = W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    base = counts.select("_part", F.coalesce(F.sum("_n").over(upto), F.lit(0)).alias("_before"), F.sum("_n").over(W.partitionBy()).alias("_all"))
    rank = F.col("_before") + F.col("_at").bitwiseAND(F.lit((1 << _PART_BITS) - 1)) + 1
    met = rows.withColumn("_part", part).join(F.broadcast(base), "_part")  # a row a partition
    return met.withColumn("rank", F.when(able & (rank <= F.expr(f"({percent} * _all) div 100")), rank)).drop("_part", "_at", "_before", "_all")


def resampled(docs: DataFrame, target: DataFrame, key: str = "doc_id", text: str = "text", orders: int = ORDERS, buckets: int = BUCKETS, percent: int = PERCENT, least: int = MIN_WORDS, seed: int = SEED) -> DataFrame:
    """Per row of docs: key, n_words, n_features, weight, score and rank (null where it is not drawn)."""
    own = docs.select(F.col(f"`{key}`").alias("key"), F.col(f"`{text}`").alias("text"))
    goal = target.select(F.col(f"`{text}`").alias("text"))
    row = F.monotonically_increasing_id().alias("row")
    with Workspace(docs.sparkSession) as space:
        gain = gains(grams(position_table(own.select("text", row)), orders), grams(position_table(goal.select("text", row)), orders), buckets)
        sums = weighted(position_table(own.select("key", "text", row)), space.stored(gain), ["key", "row"], orders, buckets)
        scored = space.stored(sums.withColumn("score", F.col("weight") + noise(F.col("key"), seed)))
        out = drawn(scored, space, "key", percent, least)
        return space.result(out.select(F.col("key").alias(key), "n_words", "n_features", "weight", "score", "rank"))


def op11_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = resampled(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return out.select("doc_id", "n_features", "weight", "score", "rank")


#: DuckDB: crc32 byte by byte over a table made by its rule, once a distinct word.
OP11_SQL = rf"""
WITH RECURSIVE step(i, k, c) AS (SELECT i, 0, i::BIGINT FROM range(256) r(i) UNION ALL SELECT i, k + 1, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END FROM step WHERE k < 8),
crc AS (SELECT list(c ORDER BY i) AS tab FROM step WHERE k = 8),
d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
dw AS (SELECT r, unnest(w) AS word FROM d),
tw AS (SELECT unnest(regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS word FROM benchmark),
bytes AS (SELECT word, hex(encode(word)) AS h FROM (SELECT word FROM dw UNION SELECT word FROM tw)),
b AS (SELECT word, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(1, len(h) // 2 + 1), lambda i: ('0x' || substr(h, 2 * i - 1, 2))::BIGINT)),
  lambda c, x: xor(c >> 8, tab[(xor(c, x) & 255) + 1])), 4294967295) % {BUCKETS} AS bucket FROM bytes, crc),
s AS (SELECT bucket, count(*) AS s FROM dw JOIN b USING (word) GROUP BY 1),
t AS (SELECT bucket, count(*) AS t FROM tw JOIN b USING (word) GROUP BY 1),
g AS (SELECT bucket, floor(1000 * ln((coalesce(t, 0) + 1.0::DOUBLE) * ((SELECT count(*) FROM dw) + {BUCKETS}.0::DOUBLE) / ((s + 1.0::DOUBLE) * ((SELECT count(*) FROM tw) + {BUCKETS}.0::DOUBLE))))::BIGINT AS gain FROM s LEFT JOIN t USING (bucket)),
m AS (SELECT r, sum(gain)::BIGINT AS total, count(*)::BIGINT AS n FROM dw JOIN b USING (word) JOIN g USING (bucket) GROUP BY 1),
x AS (SELECT r, doc_id, coalesce(n, 0) AS n_features, coalesce((total - ((total % n) + n) % n) // n, 0)::BIGINT AS weight,
  floor(-1000 * ln(-ln((('0x' || substr(sha256('{SEED}:' || coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296)))::BIGINT AS noise FROM d LEFT JOIN m USING (r)),
o AS (SELECT *, weight + noise AS score, row_number() OVER (PARTITION BY n_features >= {MIN_WORDS} ORDER BY weight + noise DESC, doc_id NULLS LAST, r) AS place FROM x)
SELECT doc_id, n_features, weight, score, CASE WHEN n_features >= {MIN_WORDS} AND place <= {PERCENT} * (SELECT count(*) FROM x WHERE n_features >= {MIN_WORDS}) // 100 THEN place END AS rank FROM o
"""
