"""Operator 7: secret scans over an incremental blob ledger.

Every version of every path is content-addressed. Only (blob, rule version) pairs that the ledger lacks are scanned;
their findings are appended to it and joined back to all paths that ever held the blob.

A null text is the empty blob. Repeated rows share their blob. Very long texts are scanned whole. Empty tables give
empty ledgers. Rows with a null id are paths like others. The query takes part with its key and text columns only.
Spans of different kinds may start at one place: they are listed in the order of the kinds, and where they overlap, what
is cut out of a text is their disjoint form. scan_versions reads the columns blob and text, others may have any name. A
blob that very many paths hold is scanned once; copies are dropped in each partition before texts move.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kmerloom.llm.common import fresh, scratch, table

RULE_VERSION = 1

#: Base rules, fixed values: kind, pattern, least length, group that the length is of.
BASE_RULES = (
    ("assign", re.compile(r"""(?:(?ai:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""), 12, 1),
    ("access", re.compile(r"AKIA[A-Z0-9]+"), 18, 0),
    ("hex", re.compile(r"[0-9a-f]{16,}"), 16, 0),
)
#: Further kinds of this scanner: private key headers, signed web tokens, and prefixed service tokens.
MORE_RULES = (
    ("pem", re.compile(r"-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----"), 1, 0),
    ("jwt", re.compile(r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"), 1, 0),
    ("service", re.compile(r"(?:ghp|gho|ghs|glpat|xox[abp]|sk_live)[_-][A-Za-z0-9-]{20,}"), 1, 0),
)
KINDS = [k for k, *_ in BASE_RULES + MORE_RULES]

FINDINGS = "blob string, rule_version int, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, cuts string"


def find_spans(text: str, rules=BASE_RULES + MORE_RULES) -> list[tuple[int, int, str]]:
    """(start, end, kind) in code points, by start and then by the order of the rules."""
    out = []
    for order, (kind, pattern, least, group) in enumerate(rules):
        out += [(m.start(), order, m.end(), kind) for m in pattern.finditer(text) if len(m[group]) >= least]
    return [(a, b, kind) for a, _, b, kind in sorted(out)]


def _joined(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{kind}:{a}:{b}" for a, b, kind in spans)


def disjoint(spans: list[tuple[int, int, str]]) -> list[tuple[int, int, str]]:
    """Overlapping spans joined, under the kind of the first."""
    out: list[tuple[int, int, str]] = []
    for a, b, kind in spans:
        if out and a < out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]), out[-1][2])
        else:
            out.append((a, b, kind))
    return out


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    base = {k for k, *_ in BASE_RULES}
    for batch in batches:
        out = []
        for blob, version, text in zip(*(batch.column(i).to_pylist() for i in range(3))):
            spans = find_spans(text or "")
            own = [s for s in spans if s[2] in base]
            n = [sum(s[2] == k for s in own) for k in ("assign", "access", "hex")]
            out.append((blob, version, *n, hashlib.sha256(_joined(own).encode()).hexdigest(), _joined(spans), _joined(disjoint(spans))))
        cols = list(zip(*out)) if out else [()] * 8
        types = [pa.string(), pa.int32(), *[pa.int64()] * 3, *[pa.string()] * 3]
        names = [f.split()[0] for f in FINDINGS.split(", ")]
        yield pa.record_batch([pa.array(c, t) for c, t in zip(cols, types)], names)


def open_ledger(spark: SparkSession, path: str) -> DataFrame:
    """The ledger at path, created empty if there is none."""
    spark.createDataFrame([], FINDINGS).write.mode("append").parquet(path)
    return spark.read.schema(FINDINGS).parquet(path)


def scan_versions(versions: DataFrame, ledger_path: str, rule_version: int = RULE_VERSION) -> int:
    """Scan the blobs of versions(blob, text) that the ledger lacks for this rule version; append; rows appended.

    Texts move once, to meet their copies; copies within a partition are dropped before that.
    """
    spark = versions.sparkSession
    seen = open_ledger(spark, ledger_path).where(F.col("rule_version") == rule_version).select("blob")
    unseen = versions.groupBy("blob").agg(F.first("text").alias("text")).join(seen, "blob", "left_anti")
    unseen.select("blob", F.lit(rule_version).alias("rule_version"), "text").mapInArrow(_scan, FINDINGS).write.mode("append").parquet(ledger_path)
    return spark.read.schema(FINDINGS).parquet(ledger_path).where(F.col("rule_version") == rule_version).count()


def blob_of(text: str = "text"):
    """The SHA-256 of a text in UTF-8."""
    return F.sha2(F.coalesce(F.col(text), F.lit("")), 256)


def addressed(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs plus blob, its text's address, in place of a column of that name."""
    return docs.withColumn("blob", blob_of(text))


def findings(paths: DataFrame, ledger: DataFrame, rule_version: int = RULE_VERSION) -> DataFrame:
    """Every path with its blob's findings."""
    return paths.join(ledger.where(F.col("rule_version") == rule_version).drop("rule_version"), "blob")


def redacted(docs: DataFrame, ledger: DataFrame, rule_version: int = RULE_VERSION, text: str = "text") -> DataFrame:
    """docs with every found span replaced by its kind in brackets, from the last to the first; no other change.

    Null and empty texts, repeated rows and null ids are kept as they are; columns of any name may be there.
    """
    own, blob, cuts = (fresh(docs, c) for c in ("own_blob", "blob", "cuts"))
    dirty = ledger.where((F.col("rule_version") == rule_version) & (F.col("cuts") != "")).select(F.col("blob").alias(blob), F.split("cuts", ",").alias(cuts))

    def cut(value, span):
        kind, a, b = (F.split(span, ":")[i] for i in range(3))
        return F.overlay(value, F.concat(F.lit("["), kind, F.lit("]")), a.cast("int") + 1, b.cast("int") - a.cast("int"))

    joined = docs.withColumn(own, blob_of(text)).join(dirty, F.col(own) == F.col(blob), "left")
    clean = F.when(F.col(cuts).isNull(), F.col(text)).otherwise(F.aggregate(F.reverse(cuts), F.col(text), cut))
    return joined.select(*(clean.alias(c) if c == text else F.col(f"`{c}`") for c in docs.columns))


def op7_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = addressed(table(spark, sf_dir, "documents").select("doc_id", "text"))
    path = scratch(spark)
    scan_versions(docs.select("blob", "text"), path)
    ledger = spark.read.schema(FINDINGS).parquet(path)
    return findings(docs.select("doc_id", "blob"), ledger).select("doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans")


#: DuckDB cannot give the places of all matches; tests hold the query against a plain scan of each row.
OP7_SQL = None
