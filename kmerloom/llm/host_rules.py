"""Operator 6: host-level quality rules, in DataFrame functions only.

Every document is measured against a few rules. Failures are summed by host, each rule's rate is shrunk with a
beta prior fitted to all hosts by moments, and hosts whose shrunk rate passes a limit lose all their documents.

Null texts have no words and fail the length rule. A null host is a host of its own. Repeated rows count as often
as they occur. Extra columns are kept out of the work; the caller joins on its key. Empty tables give no rows. Texts
are measured whole, whatever their length, within their row: a very long one makes arrays of its words in one task.
Rules fail beyond their limits, a document that meets one exactly passes; so does a host at HOST_LIMIT. 3-word windows
are equal where their 64-bit hashes are, so two different ones of a text may be taken for one with probability 2^-64.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kmerloom.llm.common import WORD, checkpointed, let, table, words

#: Characters of the symbol rule, fixed values.
SYMBOLS = "#*$%&|<>"
#: Limits of the rules beside the base ones: symbols a word, duplicate lines a word, characters a word.
RULES = ("short", "repeats", "symbols", "lines", "length")
HOST_LIMIT = 0.6


def _repeated_words(w: Column) -> Column:
    """Words inside a 3-word window that the text holds twice or more. Windows are compared by their 64-bit hash."""

    def count(h: Column) -> Column:
        def covered(pairs: Column) -> Column:
            hit = F.filter(
                F.transform(
                    pairs,
                    lambda x, i: F.when(
                        (F.get(pairs, i - 1)["h"] == x["h"]) | (F.get(pairs, i + 1)["h"] == x["h"]), x["i"]
                    ),
                ),
                lambda i: i.isNotNull(),
            )
            return F.size(F.array_distinct(F.flatten(F.transform(hit, lambda i: F.array(i, i + 1, i + 2)))))

        return F.when(F.size(F.array_distinct(h)) == F.size(h), 0).otherwise(
            let(F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i")))), covered)
        )

    windows = F.transform(
        F.sequence(F.lit(0), F.size(w) - 3),
        lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)),
    )
    return F.when(F.size(w) < 4, 0).otherwise(let(windows, count))


def measured(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs plus n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, as longs."""
    t = F.coalesce(F.col(text), F.lit(""))
    lines = F.filter(F.split(t, "\n", -1), lambda x: x.rlike(WORD))
    m = let(
        words(F.col(text)),
        lambda w: F.struct(
            F.size(w).cast("long").alias("n_words"),
            F.coalesce(F.aggregate(w, F.lit(0).cast("long"), lambda a, x: a + F.length(x)), F.lit(0)).alias("word_chars"),
            _repeated_words(w).cast("long").alias("n_repeat_words"),
        ),
    )
    extra = F.struct(
        (F.length(t) - F.length(F.translate(t, SYMBOLS, ""))).cast("long").alias("n_symbols"),
        let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
    )
    return docs.withColumns({"_m": m, "_x": extra}).select(
        *docs.columns,
        "_m.n_words",
        "_m.word_chars",
        "_x.n_symbols",
        "_x.n_dup_lines",
        "_m.n_repeat_words",
    )


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def _failures() -> dict[str, Column]:
    n = F.greatest(F.col("n_words"), F.lit(1))
    return {
        "short": F.col("n_words") < 50,
        "repeats": 100 * F.col("n_repeat_words") > 50 * F.col("n_words"),
        "symbols": F.col("n_symbols") > 0.5 * n,
        "lines": F.col("n_dup_lines") > 0.1 * n,
        "length": (F.col("word_chars") < 2 * n) | (F.col("word_chars") > 20 * n),
    }


def host_rates(measures: DataFrame, host: str) -> DataFrame:
    """(host, n, rate_<rule> ...): shrunk failure rates. Prior: beta with the mean and variance of the hosts' rates."""
    by_host = measures.groupBy(host).agg(
        F.count("*").alias("n"), *(F.sum(f.cast("long")).alias(r) for r, f in _failures().items())
    )
    stats = by_host.agg(
        F.coalesce(F.avg(1 / F.col("n")), F.lit(1.0)).alias("inv_n"),
        *(F.avg(F.col(r) / F.col("n")).alias(f"{r}_mean") for r in RULES),
        *(F.coalesce(F.var_pop(F.col(r) / F.col("n")), F.lit(0.0)).alias(f"{r}_var") for r in RULES),
    )

    def shrunk(r: str) -> Column:
        mean = F.least(F.greatest(F.col(f"{r}_mean"), F.lit(1e-6)), F.lit(1 - 1e-6))
        # variance between hosts, without what sampling alone makes
        between = F.greatest(F.col(f"{r}_var") - mean * (1 - mean) * F.col("inv_n"), mean * (1 - mean) * 1e-4)
        strength = F.greatest(mean * (1 - mean) / between - 1, F.lit(1.0))
        return ((F.col(r) + mean * strength) / (F.col("n") + strength)).alias(f"rate_{r}")

    # stats is one row by construction
    return by_host.crossJoin(F.broadcast(stats)).select(host, "n", *(shrunk(r) for r in RULES))


def host_rules(docs: DataFrame, key: str = "doc_id", text: str = "text", host: str = "source", limit: float = HOST_LIMIT) -> DataFrame:
    """Per document: key, host, the measures, base_failed, host_failed and kept.

    A host fails when the shrunk rate of any rule is over `limit`. Documents are measured once; the text takes part
    in no shuffle, and host sums are combined before they move.
    """
    m = checkpointed(measured(docs.select(key, host, text), text).drop(text))
    bad = F.greatest(*(F.col(f"rate_{r}") for r in RULES)) > limit
    rates = host_rates(m, host).select(F.col(host).alias("_host"), bad.alias("host_failed"))
    return (
        m.join(rates, m[host].eqNullSafe(F.col("_host")), "left")
        .withColumn("host_failed", F.coalesce("host_failed", F.lit(False)))
        .withColumn("base_failed", base_failed())
        .withColumn("kept", ~F.col("base_failed") & ~F.col("host_failed"))
        .drop("_host")
    )


def op6_host_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return host_rules(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "host_failed", "kept"
    )


#: DuckDB. The repeated words come from windows joined by position, the rates from the same moments.
OP6_SQL = r"""
WITH d AS (SELECT doc_id, source, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
win AS (SELECT doc_id, i, w[i] || ' ' || w[i+1] || ' ' || w[i+2] AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM d)),
rep AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS c FROM win) WHERE c > 1),
rw AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM rep, range(0, 3) r(k) GROUP BY 1),
ln AS (SELECT doc_id, count(*) - count(DISTINCT l) AS n FROM (SELECT doc_id, unnest(string_split(t, chr(10))) AS l FROM d) WHERE regexp_matches(l, '[^\x20\x09-\x0D]') GROUP BY 1),
m AS (SELECT d.doc_id, d.source, len(w)::BIGINT AS n_words, length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g'))::BIGINT AS word_chars,
  (length(t) - length(translate(t, '#*$%&|<>', '')))::BIGINT AS n_symbols, coalesce(ln.n, 0)::BIGINT AS n_dup_lines, coalesce(rw.n, 0)::BIGINT AS n_repeat_words
  FROM d LEFT JOIN rw USING (doc_id) LEFT JOIN ln USING (doc_id)),
f AS (SELECT *, greatest(n_words, 1) AS q FROM m),
h AS (SELECT source, rule, count(*) AS n, sum(bad::INT) AS k FROM (
  SELECT source, unnest(['short', 'repeats', 'symbols', 'lines', 'length']) AS rule, unnest([n_words < 50, 100 * n_repeat_words > 50 * n_words,
  n_symbols > 0.5 * q, n_dup_lines > 0.1 * q, word_chars < 2 * q OR word_chars > 20 * q]) AS bad FROM f) GROUP BY ALL),
s AS (SELECT rule, least(greatest(avg(k / n), 1e-6), 1 - 1e-6) AS mu, var_pop(k / n) AS v, avg(1 / n) AS inv_n FROM h GROUP BY 1),
p AS (SELECT rule, mu, greatest(mu * (1 - mu) / greatest(v - mu * (1 - mu) * inv_n, mu * (1 - mu) * 1e-4) - 1, 1) AS a FROM s),
bad AS (SELECT source, max((k + mu * a) / (n + a)) > 0.6 AS host_failed FROM h JOIN p USING (rule) GROUP BY 1)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed, host_failed,
  NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND NOT host_failed AS kept
FROM m JOIN bad ON m.source IS NOT DISTINCT FROM bad.source
"""
