"""Operator 12: documents packed into sequences by best-fit decreasing, with a segment tree over remaining capacities.

Best-fit decreasing looks at nothing but lengths, and these are bounded by the capacity: what it does is fixed by one
count of pieces a length. A segment tree over the remaining capacities 0 to `capacity` finds the tightest open sequence
in logarithmic time; pieces of equal length take equal steps there, so they are placed in runs, and the plan is a bounded
list of runs, however many documents there are. Pieces are range-partitioned by decreasing length, which numbers them
over all partitions; each finds its run by bisection. The packing is that of one best-fit decreasing over all pieces: no
partition closes sequences of its own.

A text's ids are followed by the end id; a longer document is cut into full pieces, behind a first one that may be
shorter. Null and empty texts are one piece of the end id alone. Very long texts are encoded whole. Ties in length are
placed in the order of id, row and piece; repeated rows are documents of their own; null ids stay. Only the key and the
text are read. Empty tables give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from kmerloom.llm.common import Workspace, n_partitions, sliced, table
from kmerloom.llm.encoders import BYTE_MODEL, ByteEncoder

#: Tokens of a sequence, and the id behind every document.
CAPACITY, END_ID = 2048, 0
_PART_BITS = 33


def pieces(docs: DataFrame, key: str = "doc_id", text: str = "text", capacity: int = CAPACITY, end_id: int = END_ID, model: str = BYTE_MODEL) -> DataFrame:
    """(key, row, piece, start, length, ids): the pieces of every document; ids are 32-bit little-endian integers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, end = ByteEncoder(model), np.array([end_id], np.uint32)
        for batch in sliced(batches, "_text"):
            parts = [x for t in batch.column(2).to_pylist() for x in ((encode(t), end) if t else (end,))]
            size = np.array([len(p) for p in parts])
            texts = np.asarray(batch.column(2).is_valid()) & (np.asarray(pc.fill_null(pc.binary_length(batch.column(2)), 0)) > 0)
            # a text's ids and its end id are two parts, an empty one's is one
            first = np.cumsum(1 + texts) - (1 + texts)
            total = np.add.reduceat(size, first) if len(first) else size
            n = -(-total // capacity)
            of = np.repeat(np.arange(len(total)), n)
            piece = np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n)
            head = total - (n - 1) * capacity
            start = np.where(piece == 0, 0, head[of] + (piece - 1) * capacity)
            length = np.where(piece == 0, head[of], capacity)
            upto = np.concatenate([[0], np.cumsum(length)]).astype(np.int32) * 4
            data = np.concatenate(parts).astype("<u4") if parts else np.zeros(0, "<u4")
            ids = pa.BinaryArray.from_buffers(pa.binary(), len(of), [None, pa.py_buffer(upto.tobytes()), pa.py_buffer(data.tobytes())])
            own = batch.select([0, 1]).take(pa.array(of))
            yield pa.record_batch([*own.columns, pa.array(piece.astype(np.int32)), pa.array(start), pa.array(length), ids], names)

    names = ["key", "row", "piece", "start", "length", "ids"]
    kind = docs.schema[key].dataType.simpleString()
    rows = docs.select(F.col(f"`{key}`").alias("key"), F.monotonically_increasing_id().alias("row"), F.col(f"`{text}`").alias("_text"))
    return rows.mapInArrow(run, f"key {kind}, row long, piece int, start long, length long, ids binary")


class OpenSequences:
    """Runs of equal open sequences by remaining capacity, and the segment tree that finds the tightest that is enough."""

    def __init__(self, capacity: int):
        self.leaves = 1 << capacity.bit_length()
        self.some = bytearray(2 * self.leaves)
        self.runs: list[list[tuple[int, int]]] = [[] for _ in range(capacity + 1)]

    def _mark(self, room: int) -> None:
        at = room + self.leaves
        self.some[at] = bool(self.runs[room])
        while at > 1:
            at >>= 1
            self.some[at] = self.some[2 * at] | self.some[2 * at + 1]

    def put(self, room: int, first: int, n: int) -> None:
        """n sequences from number `first` on have `room` tokens left."""
        if room and n:
            self.runs[room].append((first, n))
            if not self.some[room + self.leaves]:
                self._mark(room)

    def take(self, room: int) -> tuple[int, int]:
        run = self.runs[room].pop()
        if not self.runs[room]:
            self._mark(room)
        return run

    def tightest(self, need: int) -> int | None:
        """The smallest remaining capacity of an open sequence that is at least `need`."""
        at = need + self.leaves
        while at > 1 and not self.some[at]:
            # up to the next subtree of larger capacities that has any
            while at & 1:
                at >>= 1
            if not at:
                return None
            at += 1
        if at <= 1:
            return None
        while at < self.leaves:
            at = 2 * at if self.some[2 * at] else 2 * at + 1
        return at - self.leaves


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> tuple[np.ndarray, int]:
    """Runs of best-fit decreasing over counts (length to number of pieces), and the number of sequences.

    A run is (place of its first piece in decreasing order of length, pieces a sequence, first sequence, offset there,
    length). Each fills a sequence with as many pieces of a length as fit, since one that was tightest stays tightest.
    The number of runs depends on the capacity, not on how many pieces there are.
    """
    still, runs, at, used = OpenSequences(capacity), [], 0, 0
    for length in sorted(counts, reverse=True):
        left = counts[length]
        while left:
            room = still.tightest(length)
            if room is None:
                room, n = capacity, -(-left // (capacity // length))
                first, used = used, used + n
            else:
                first, n = still.take(room)
            each = room // length
            for each, full in ((each, min(n, left // each)), (left % each, int(n > left // each and left % each > 0))):
                if full:
                    runs.append((at, each, first, capacity - room, length))
                    still.put(room - each * length, first, full)
                    at, left, first, n = at + full * each, left - full * each, first + full, n - full
            still.put(room, first, n)
    return np.array(runs, np.int64).reshape(-1, 5), used


def packed(parts: DataFrame, space: Workspace, order: list[str], capacity: int = CAPACITY) -> DataFrame:
    """parts (length, ...) plus sequence_id and offset; order: columns that settle ties in length.

    What reaches the driver is a count for each length, at most `capacity` rows.
    """
    spark = parts.sparkSession
    by = [F.col("length").desc(), *(F.col(c).asc_nulls_last() for c in order)]
    dealt = parts.repartitionByRange(n_partitions(spark), *by).sortWithinPartitions(*by)
    rows = space.stored(dealt.withColumn("_at", F.monotonically_increasing_id()))
    counts = {r[0]: r[1] for r in rows.groupBy("length").agg(F.count("*")).collect()}
    runs, _ = plan(counts, capacity)
    part = F.shiftright("_at", _PART_BITS)
    upto = W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    base = rows.groupBy(part.alias("_part")).agg(F.count("*").alias("_n")).select("_part", F.coalesce(F.sum("_n").over(upto), F.lit(0)).alias("_before"))
    place = F.col("_before") + F.col("_at").bitwiseAND(F.lit((1 << _PART_BITS) - 1))
    numbered = rows.withColumn("_part", part).join(F.broadcast(base), "_part").withColumn("_place", place)  # a row a partition
    keep = parts.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            g = np.asarray(batch.column(len(keep)))
            start, each, first, offset, length = runs[np.searchsorted(runs[:, 0], g, side="right") - 1].T
            inside = g - start
            yield pa.record_batch([*batch.columns[: len(keep)], pa.array(first + inside // each), pa.array(offset + inside % each * length)], [*keep, "sequence_id", "offset"])

    schema = ", ".join(f"`{c}` {parts.schema[c].dataType.simpleString()}" for c in keep)
    return numbered.select(*(F.col(f"`{c}`") for c in keep), "_place").mapInArrow(run, f"{schema}, sequence_id long, offset long")


def packed_documents(docs: DataFrame, key: str = "doc_id", text: str = "text", capacity: int = CAPACITY, end_id: int = END_ID, model: str = BYTE_MODEL, ids: bool = False) -> DataFrame:
    """(key, piece, start, length, ids_crc32, sequence_id, offset) of every piece; with ids=True also its ids (binary)."""
    with Workspace(docs.sparkSession) as space:
        parts = pieces(docs, key, text, capacity, end_id, model).withColumn("ids_crc32", F.crc32("ids"))
        # sizes are all that packing moves, unless the ids are asked for
        parts = space.stored(parts if ids else parts.drop("ids"))
        out = packed(parts, space, ["key", "row", "piece"], capacity)
        return space.result(out.withColumnRenamed("key", key).drop("row"))


def sequences(placed: DataFrame) -> DataFrame:
    """(sequence_id, length, ids) of packed documents with ids: a row a sequence, its pieces put together by offset."""
    parts = F.sort_array(F.collect_list(F.struct("offset", "ids")))
    rows = placed.groupBy("sequence_id").agg(F.sum("length").alias("length"), parts.alias("parts"))
    return rows.select("sequence_id", "length", F.aggregate("parts", F.lit("").cast("binary"), lambda a, x: F.concat(a, x["ids"])).alias("ids"))


def op12_best_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed_documents(table(spark, sf_dir, "documents")).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


#: Byte-pair merges cannot be put in SQL; tests hold ids, pieces and the number of sequences against plain versions.
OP12_SQL = None
