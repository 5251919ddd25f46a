"""Readers of the query files with more than a sequence a line, of weights, filter lists and sketches.

Ids are numbers of lines, 0, 1, 2, ..., whatever splits Spark reads a file in; those of several files go on from file to
file, in order of path. Blank lines give no rows but keep their number. Nothing is parsed by hand: atoms and segments are
taken out by regular expressions, and the rest of a boolean line is an expression over bits, whose operators bind as the
file's do (! before & before ^ before |).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kmerloom.operators.query import line_query, too_short, with_overlap
from kmerloom.plans.spec import HashSpec
from kmerloom.sources.lines import numbered

ATOM = r"\[([^\]]*)\]"


def _lines(spark: SparkSession, path: str) -> DataFrame:
    rows = numbered(spark, path).select(F.col("number").alias("query_id"), F.regexp_replace("value", r"\s", "").alias("line"))
    return rows.where("line <> ''")


def _atom(text, theta: float):
    """seq and theta of the inside of brackets; a theta that is left out is the given one."""
    parts = F.split(text, ",")
    return F.get(parts, F.lit(0)).alias("seq"), F.coalesce(F.get(parts, F.lit(1)).cast("float"), F.lit(theta).cast("float")).alias("theta")


def _long_enough(rows: DataFrame, k: int, what: str) -> DataFrame:
    """rows, or an error: a sequence without a k-mer would change its query's meaning, not leave it out."""
    if not too_short(rows, k).isEmpty():
        raise ValueError(f"{what} shorter than {k}")
    return rows


def read_bool_queries(spark: SparkSession, path: str, k: int, theta: float = 0.5) -> tuple[DataFrame, DataFrame]:
    """(lines, atoms) of lines such as `[ACGT,0.9] & !([GGTT] | [CCCC,0.8]);`.

    lines: (query_id, shape), the line with @ for each atom and without its `;`; atoms: (query_id, atom_ix, seq, theta).
    Lines shorter than k are left out; a line without its `;` or with anything but atoms, operators and parentheses, and
    an atom shorter than k, are errors. No line goes to the driver.
    """
    lines = _lines(spark, path).where(F.length("line") >= k)
    atoms = lines.select("query_id", F.posexplode(F.regexp_extract_all("line", F.lit(ATOM), F.lit(1))).alias("atom_ix", "atom")).select("query_id", "atom_ix", *_atom(F.col("atom"), theta))
    rest = F.regexp_replace("line", ATOM, "@")
    wrong = F.raise_error(F.concat(F.lit("line "), (F.col("query_id") + 1).cast("string"), F.lit(" is no boolean query: "), rest)).cast("string")
    shape = F.when(rest.rlike(r"^[@()&|^!]*@[@()&|^!]*;$"), F.regexp_replace(rest, ";$", "")).otherwise(wrong)
    return lines.select("query_id", shape.alias("shape")), _long_enough(atoms, k, "an atom is")


def bool_file_query(spark: SparkSession, path: str, experiments: DataFrame, index: DataFrame, spec: HashSpec, exact: bool = False, theta: float = 0.5) -> DataFrame:
    """(query_id, exp_id) of the lines of a boolean query file; experiments (exp_id), index as in bool_query."""
    lines, atoms = read_bool_queries(spark, path, spec.k, theta)
    return line_query(lines, atoms, experiments, index, spec, exact)


def read_segments(spark: SparkSession, path: str, k: int, theta: float = 0.9) -> DataFrame:
    """(query_id, group_ix, sign, seg_ix, seq, theta) of lines such as `[ACGT,0.9][TTGA,0.5]-[CCCC,0.9]`.

    Groups are joined by + and -, the first is +; segments of a group overlap by k - 1 letters. Segments shorter than k
    are errors.
    """
    groups = _lines(spark, path).select("query_id", F.posexplode(F.regexp_extract_all("line", F.lit(r"[+-]?(?:\[[^\]]*\])+"), F.lit(0))).alias("group_ix", "g"))
    sign = F.when(F.col("g").startswith("-"), "-").otherwise("+").alias("sign")
    parts = groups.select("query_id", "group_ix", sign, F.posexplode(F.regexp_extract_all("g", F.lit(ATOM), F.lit(1))).alias("seg_ix", "atom"))
    return with_overlap(_long_enough(parts.select("query_id", "group_ix", "sign", "seg_ix", *_atom(F.col("atom"), theta)), k, "a segment is"), k)


def read_weights(spark: SparkSession, path: str) -> DataFrame:
    """(query_id, ord, w): the numbers of each line, in order; what is no number fails the job."""
    rows = numbered(spark, path).select(F.col("number").alias("query_id"), F.trim("value").alias("line")).where("line <> ''")
    number = F.coalesce(F.col("w").try_cast("float"), F.raise_error(F.concat(F.lit("not a weight: "), "w")).cast("float"))
    return rows.select("query_id", F.posexplode(F.split("line", r"\s+")).alias("ord", "w")).select("query_id", "ord", number.alias("w"))


def read_filter_list(spark: SparkSession, path: str) -> list[str]:
    """Names of experiments, one a line, in the order in which a greedy build inserts them: one row an experiment."""
    rows = numbered(spark, path).select(F.col("number").alias("i"), F.trim("value").alias("name")).where("name <> ''")
    return [r["name"] for r in rows.orderBy("i").collect()]


def read_shifts(spark: SparkSession, path: str) -> tuple[tuple[int, int, int], ...]:
    """Shift triples of xorshift sketches, three numbers a line: a table as long as a sketch, in order of slot."""
    rows = numbered(spark, path).where(F.trim("value") != "").orderBy("number").collect()
    found = tuple(tuple(map(int, r["value"].split())) for r in rows)
    if not found or any(len(t) != 3 or not all(0 < x < 64 for x in t) for t in found):
        raise ValueError("shift triples are three numbers from 1 to 63 a line")
    return found


def read_sketches(spark: SparkSession, path: str) -> DataFrame:
    """(exp_id, hash_ix, val) of a folder of sketches, a folder an experiment and a value a line in order of slot."""
    files = spark.read.text(path, wholetext=True).select(F.col("exp_id").cast("string"), F.regexp_extract_all("value", F.lit(r"-?\d+"), F.lit(0)).alias("v"))
    return files.select("exp_id", F.posexplode("v").alias("hash_ix", "val")).select("exp_id", "hash_ix", F.col("val").cast("long").alias("val"))
