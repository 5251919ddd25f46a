"""Operator 8: document fingerprints from closed syncmers.

A k-mer of code points is an anchor when the smallest hash among its inner s-mers sits at its first or last place.
That depends on the k-mer alone, so equal stretches of text have equal anchors wherever they stand. The fingerprint
holds the distinct anchors with the smallest hashes, each with its first place in the text: one in RATE of them, and
SKETCH at least, so it grows with the text. Likeness is positional: common anchors count where they stand in a run of
two or more whose places differ by one offset; it is twice their number by the number of both fingerprints' anchors,
of those hashes that neither has cut off.

Null is the empty text, with the empty fingerprint; two empty texts are alike (1), an empty and another are not (0).
A text shorter than k has one anchor, itself. Equal ids are ordered by text; null ids come first. Repeated rows are
neighbours of each other; a single row is its own next. Very long texts are read whole. Empty tables give no rows. The
order is cut into pieces by value, so the key must be a number: a text key is an error. Extra columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from kmerloom.llm.common import BASE_A, BASE_B, mixed, n_partitions, prefix_sums, span_hash, table

K, S = 8, 3
#: Anchors of a fingerprint: all up to SKETCH, beyond that one in RATE, and SKETCH at least.
SKETCH, RATE = 64, 16


def anchors(text: str, k: int = K, s: int = S) -> tuple[np.ndarray, np.ndarray]:
    """(places, hashes) of the closed syncmers of a text; a short text is one anchor at 0."""
    code = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    n = len(code)
    if n == 0:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    sums = prefix_sums(code, BASE_A)
    if n < k:
        return np.zeros(1, np.int64), span_hash(sums, np.zeros(1, np.int64), np.full(1, n), BASE_A)
    small = np.zeros(n - s + 1, np.uint64)
    for i in range(s):
        small = small * np.uint64(BASE_B) + code[i : n - s + 1 + i]
    small = mixed(small)
    w, m = k - s + 1, n - k + 1
    # minimum of every w neighbours, by doubling the width
    low, width = small, 1
    while width < w:
        step = min(width, w - width)
        low = np.minimum(low[: len(low) - step], low[step:])
        width += step
    at = np.flatnonzero((small[:m] == low) | (small[w - 1 : w - 1 + m] == low))
    return at, span_hash(sums, at, at + k, BASE_A)


Fingerprint = np.ndarray
#: An anchor of a fingerprint; hashes are cut to 48 bits.
_ANCHOR = np.dtype([("at", "<i8"), ("hash", "<u8")])


def sketch(places: np.ndarray, hashes: np.ndarray) -> Fingerprint:
    """The anchors with the smallest distinct hashes, in order of hash, each at its first place."""
    h, first = np.unique(hashes >> np.uint64(16), return_index=True)
    n = min(len(h), max(SKETCH, len(h) // RATE))
    out = np.empty(n, _ANCHOR)
    out["at"], out["hash"] = places[first[:n]], h[:n]
    return out


def fingerprint(text: str) -> tuple[Fingerprint, bool]:
    """(fingerprint of a text, whether anchors were left out)."""
    places, hashes = anchors(text)
    f = sketch(places, hashes)
    return f, len(f) < len(np.unique(hashes >> np.uint64(16)))


def likeness(a: tuple[Fingerprint, bool], b: tuple[Fingerprint, bool]) -> float:
    (x, cut_x), (y, cut_y) = a, b
    if not len(x) or not len(y):
        return float(len(x) == len(y))
    # hashes above the smaller of both ends are unknown on one side
    end = min([f["hash"][-1] for f, cut in (a, b) if cut], default=None)
    if end is not None:
        x, y = x[x["hash"] <= end], y[y["hash"] <= end]
    if len(x) + len(y) <= 2:  # single anchors have no run
        return float(np.array_equal(x["hash"], y["hash"]))
    _, i, j = np.intersect1d(x["hash"], y["hash"], assume_unique=True, return_indices=True)
    order = np.argsort(x["at"][i])
    offset = (y["at"][j] - x["at"][i])[order]
    same = offset[1:] == offset[:-1]
    runs = np.concatenate([[False], same]) | np.concatenate([same, [False]])
    return 2 * int(runs.sum()) / (len(x) + len(y))


def matched(a: str, b: str, k: int = K, s: int = S) -> list[tuple[int, int, int]]:
    """(place in a, place in b, length) of common stretches: equal anchors chained where their offset stays the same."""
    pa_, ha = anchors(a, k, s)
    pb, hb = anchors(b, k, s)
    order = np.argsort(hb, kind="stable")
    i, j = np.searchsorted(hb[order], ha, "left"), np.searchsorted(hb[order], ha, "right")
    pairs = sorted((int(pb[order[x]]) - int(p), int(p)) for p, lo, hi in zip(pa_, i, j) for x in range(lo, hi))
    out: list[list[int]] = []
    for offset, p in pairs:
        if out and out[-1][1] - out[-1][0] == offset and p <= out[-1][0] + out[-1][2]:
            out[-1][2] = p + k - out[-1][0]
        else:
            out.append([p, p + offset, k])
    return [tuple(x) for x in out]


def as_text(f: Fingerprint) -> str:
    """Hex of the anchors' hashes, then of their places: 12 and 8 digits each."""
    return (f["hash"].astype(">u8").view(np.uint8).reshape(-1, 8)[:, 2:].tobytes() + f["at"].astype(">u4").tobytes()).hex()


def _pieces(own: DataFrame, key: str, n: int) -> DataFrame:
    """own plus piece: n ranges of the key that hold about equal numbers of rows; null keys are in the first.

    The cuts are found by one pass over the keys; a row's range is looked up by binary search in the JVM.
    """
    cuts = own.where(F.col(key).isNotNull()).approxQuantile(key, [i / n for i in range(1, n)], 0.25 / n) if n > 1 else []
    cuts = sorted({float(c) for c in cuts})
    placed = own.withColumn("_at", F.coalesce(F.col(key).cast("double"), F.lit(float("-inf"))))
    if not cuts:
        return placed.withColumn("piece", F.lit(0)).drop("_at")
    found = Bucketizer(splits=[float("-inf"), *cuts, float("inf")], inputCol="_at", outputCol="_piece").transform(placed)
    return found.withColumn("piece", F.col("_piece").cast("int")).drop("_at", "_piece")


def with_next(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows (piece, key, text, ahead), in order inside each piece: the piece's own rows, then the first of the piece after.

    The text is shuffled once. There are as many pieces as shuffle partitions; the table of their first keys has a row
    each, so that it may be broadcast, and says which piece awaits a row: that before it, or for the first piece the last.
    """
    n = n_partitions(docs.sparkSession)
    own = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    placed = _pieces(own, "key", n)
    first = placed.groupBy("piece").agg(F.min(F.struct(F.col("key").isNotNull().alias("some"), "key")).alias("m"))
    order = W.orderBy("piece")
    before = F.coalesce(F.lag("piece").over(order), F.max("piece").over(order.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)))
    wanted = first.select(F.col("piece").alias("_piece"), F.col("m.key").alias("_key"), before.alias("lead"))
    both = placed.join(F.broadcast(wanted), (F.col("piece") == F.col("_piece")) & F.col("key").eqNullSafe(F.col("_key")), "left")
    here = F.struct("piece", F.lit(0).alias("ahead"))
    there = F.struct(F.col("lead").alias("piece"), F.lit(1).alias("ahead"))
    sent = both.select(F.explode(F.when(F.col("lead").isNull(), F.array(here)).otherwise(F.array(here, there))).alias("to"), "key", "text")
    dealt = sent.select("to.*", "key", "text").repartitionById(n, F.col("piece")).sortWithinPartitions("piece", "ahead", "key", "text")
    return dealt.withColumnsRenamed({"key": key, "text": text} if key != text else {})


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per document its fingerprint, that of its edited text, and the likeness to that and to the next document."""
    ordered = with_next(docs, key, text)

    def row(key_value, own: str, own_f: tuple, after: str, after_f: tuple) -> tuple:
        half = len(own) // 2
        edited = own[: len(own) - half] + after[:half]
        f = fingerprint(edited)
        return key_value, len(own), hashlib.sha256(edited.encode()).hexdigest(), as_text(own_f[0]), as_text(f[0]), likeness(own_f, f), likeness(own_f, after_f)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None  # the row that waits for the next one of its piece
        for b in batches:
            out = []
            for piece, ahead, k, t in zip(*(b.column(i).to_pylist() for i in range(4))):
                t = t or ""
                if last and last[0] == piece:
                    f = fingerprint(t)
                    out.append(row(*last[1:], t, f))
                    last = None if ahead else (piece, k, t, f)
                elif not ahead:
                    last = piece, k, t, fingerprint(t)
            cols = list(zip(*out)) if out else [()] * 7
            types = [b.schema.field(2).type, pa.int64(), *[pa.string()] * 3, *[pa.float64()] * 2]
            yield pa.record_batch([pa.array(c, x) for c, x in zip(cols, types)], names)

    names = [key, "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    kind = docs.schema[key].dataType.simpleString()
    return ordered.mapInArrow(run, f"{key} {kind}, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")


def op8_syncmers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints(table(spark, sf_dir, "documents"))


#: Hash sketches; tests hold the query against a plain version of each step.
OP8_SQL = None
