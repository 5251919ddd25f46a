"""Readers and writers of the text formats: reads, queries, topologies, merge lists, sketches and results.

Everything is read and written by Spark, so paths may be of any file system and files may be gzipped.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kmerloom.functions.kmers import sequence_of
from kmerloom.operators.tree import Node, tree_table
from kmerloom.sources.lines import numbered


def _experiment():
    """The file's name without its format suffixes."""
    return F.regexp_replace(F.element_at(F.split(F.input_file_name(), "/"), -1), r"(\.(fa|fasta|fq|fastq|txt|gz))+$", "")


def read_fasta(spark: SparkSession, path: str) -> DataFrame:
    """(exp_id, read_id, seq): a file is an experiment, a record a read; lines of a record are joined, in upper case."""
    raw = spark.read.option("lineSep", "\n>").text(path).select(_experiment().alias("exp_id"), F.regexp_replace("value", "^>", "").alias("v"))
    seq = F.upper(F.regexp_replace(F.regexp_replace("v", r"^[^\n]*\n?", ""), r"\s", ""))
    return raw.where("length(v) > 0").select("exp_id", F.split("v", r"\s", 2)[0].alias("read_id"), seq.alias("seq"))


def read_fastq(spark: SparkSession, path: str) -> DataFrame:
    """(exp_id, read_id, seq) of four-line records: records are split at the line of each header, which follows a quality line."""
    raw = spark.read.option("lineSep", "\n@").text(path).select(_experiment().alias("exp_id"), F.regexp_replace("value", "^@", "").alias("v"))
    # a quality line may begin with @ too: only pieces with a + line of their own are records
    lines = F.split("v", "\n")
    ok = (F.size(lines) >= 3) & F.get(lines, F.lit(2)).startswith("+")
    return raw.where(ok).select("exp_id", F.split(F.get(lines, F.lit(0)), r"\s", 2)[0].alias("read_id"), F.upper(F.trim(F.get(lines, F.lit(1)))).alias("seq"))


def read_queries(spark: SparkSession, path: str, k: int, theta: float = 0.9) -> DataFrame:
    """(query_id, seq, theta): one sequence a line, trimmed; lines shorter than k are left out. Ids are
    numbers of lines, from 0, whatever splits the file is read in."""
    seq = F.trim(F.regexp_replace("value", "\r$", ""))
    rows = numbered(spark, path).select(F.col("number").alias("query_id"), seq.alias("seq"))
    return rows.where(F.length("seq") >= k).withColumn("theta", F.lit(theta).cast("float"))


def reads_of(docs: DataFrame, exp: str = "source", read: str = "doc_id", text: str = "text") -> DataFrame:
    """(exp_id, read_id, seq): texts as reads of experiments, by the letters-to-bases rule."""
    return docs.where(F.col(exp).isNotNull()).select(F.col(exp).cast("string").alias("exp_id"), F.col(read).alias("read_id"), sequence_of(F.col(text)).alias("seq"))


def queries_of(items: DataFrame, key: str = "item_id", text: str = "text", theta: float = 0.9) -> DataFrame:
    return items.where(F.col(text).isNotNull()).select(F.col(key).alias("query_id"), sequence_of(F.col(text)).alias("seq"), F.lit(theta).cast("float").alias("theta"))


def write_tree(tree: DataFrame, path: str) -> None:
    """One node a line in preorder, depth as stars: a small table by design, hence one file."""
    line = F.concat(F.expr("repeat('*', depth)"), "node_id")
    tree.orderBy("preorder").coalesce(1).select(line.alias("value")).write.mode("overwrite").text(path)


def read_tree(spark: SparkSession, path: str) -> DataFrame:
    """The tree table of a text topology; attributes after a comma are ignored."""
    lines = [r[0] for r in spark.read.text(path).collect() if r[0].strip()]  # 2N - 1 lines
    return tree_table(spark, parse_tree(lines))


def parse_tree(lines: list[str]) -> Node | None:
    kids: dict[int, list[int]] = {}
    names, path = [], []
    for i, line in enumerate(lines):
        name = line.lstrip("*").split(",")[0].strip()
        depth = len(line) - len(line.lstrip("*"))
        if depth > len(path) or (depth == 0) != (i == 0):
            raise ValueError(f"line {i + 1}: depth {depth} does not follow")
        del path[depth:]
        if path:
            kids.setdefault(path[-1], []).append(i)
            if len(kids[path[-1]]) > 2:
                raise ValueError(f"line {i + 1}: a third child")
        path.append(i)
        names.append(name)
    made: dict[int, Node] = {}
    for i in range(len(names) - 1, -1, -1):
        own = kids.get(i, [])
        if len(own) == 1:
            raise ValueError(f"line {i + 1}: a single child")
        made[i] = Node(names[i], *(made[c] for c in own))
    return made.get(0)


def write_merges(merges: DataFrame, path: str) -> None:
    merges.orderBy("step").coalesce(1).select(F.concat_ws(" ", "new_node", "c0", "c1").alias("value")).write.mode("overwrite").text(path)


def read_merges(spark: SparkSession, path: str) -> list[tuple[str, str, str]]:
    """Merge lines; lines without three fields are ignored."""
    split = [r[0].split() for r in spark.read.text(path).collect()]  # N - 1 lines
    return [tuple(x) for x in split if len(x) == 3]


def write_sketch(sketch: DataFrame, path: str) -> None:
    """One folder an experiment, its values one a line in order of slot.

    A sketch is one row of several lines: a writer by folders sorts rows by folder and may lose their order.
    """
    slots = F.sort_array(F.collect_list(F.struct("hash_ix", "val")))
    rows = sketch.groupBy("exp_id").agg(F.concat_ws("\n", F.transform(slots, lambda x: x["val"].cast("string"))).alias("value"))
    rows.write.mode("overwrite").partitionBy("exp_id").text(path)


def result_lines(results: DataFrame, queries: DataFrame, tree: DataFrame | None = None) -> DataFrame:
    """The text report: for each query a line *SEQ n and then its experiments, in order of query and of the tree."""
    named = results if tree is None else results.join(tree.where("is_leaf").select("exp_id", "preorder"), "exp_id")
    order = F.col("preorder") if tree is not None else F.col("exp_id")
    lists = named.groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct(order.alias("o"), "exp_id"))).alias("l"))
    rows = queries.select("query_id", "seq").join(lists, "query_id", "left")
    head = F.concat(F.lit("*"), "seq", F.lit(" "), F.coalesce(F.size("l"), F.lit(0)).cast("string"))
    body = F.coalesce("l.exp_id", F.array().cast("array<string>"))
    return rows.select("query_id", F.posexplode(F.concat(F.array(head), body)).alias("line", "value"))
