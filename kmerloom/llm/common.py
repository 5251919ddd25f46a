"""Shared pieces of the training-data operators: tables, shared scratch space, batch slicing, word spans."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The white space of the word definition, and that definition itself.
SPACES = (0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D)
WORD = r"[^\x20\x09-\x0D]+"
GAP = r"[\x20\x09-\x0D]+"

#: Rows of an Arrow batch: whole texts travel in it, so it is kept far below Spark's 10,000.
BATCH_ROWS = 512
#: Bytes of text that numpy code holds at once; one longer text is taken alone.
SLICE_BYTES = 1 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch(spark: SparkSession) -> str:
    """A new folder below spark.checkpoint.dir, which driver and executors share."""
    return f"{shared_dir(spark)}/kmerloom-{uuid.uuid4().hex}"


def shared_dir(spark: SparkSession) -> str:
    """The folder that the session names in spark.checkpoint.dir. Where none is named, one is made in local mode only, as
    in tests: on a cluster a folder of the driver's machine would not be seen by the executors."""
    sc = spark.sparkContext
    own = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not own:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        own = "file://" + tempfile.mkdtemp(prefix="kmerloom-checkpoints-")
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(own)
    return own


def removed(spark: SparkSession, path: str) -> None:
    """Delete a folder of the shared file system, if it is there."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def stored(df: DataFrame, path: str | None = None) -> DataFrame:
    """df as a table in the shared folder, read back: cuts lineage and keeps columns prunable."""
    spark = df.sparkSession
    path = path or scratch(spark)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


class Workspace:
    """The intermediate tables of one run, in one folder that is deleted at its end; results stay in a folder of their own."""

    def __init__(self, spark: SparkSession):
        self.spark, self.path, self.count = spark, scratch(spark), 0

    def stored(self, df: DataFrame) -> DataFrame:
        self.count += 1
        return stored(df, f"{self.path}/{self.count}")

    @contextmanager
    def bucketed(self, df: DataFrame, column: str, buckets: int) -> Iterator[DataFrame]:
        """df as a table bucketed by a column, which a join on that column need not shuffle; its name goes at the end."""
        self.count += 1
        name = f"kmerloom_{uuid.uuid4().hex}"
        try:
            df.write.bucketBy(buckets, column).option("path", f"{self.path}/{self.count}").saveAsTable(name)
            yield self.spark.table(name)
        finally:
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")

    def result(self, df: DataFrame) -> DataFrame:
        return stored(df)

    def __enter__(self) -> Workspace:
        return self

    def __exit__(self, *_) -> None:
        removed(self.spark, self.path)


def checkpointed(df: DataFrame) -> DataFrame:
    shared_dir(df.sparkSession)
    return df.checkpoint()


def identified(df: DataFrame, name: str) -> DataFrame:
    """df plus a column that tells its rows apart and is the same whenever df is read again: the file and the row's place
    in it where df is a table as read, else numbers that a checkpoint fixes."""
    read = df._jdf.queryExecution().analyzed().getClass().getSimpleName() == "LogicalRelation"
    if read and "_metadata" not in {c.lower() for c in df.columns}:
        return df.withColumn(name, F.struct("_metadata.file_path", "_metadata.row_index"))
    return checkpointed(df.withColumn(name, F.monotonically_increasing_id()))


def fresh(df: DataFrame, name: str) -> str:
    """A column name that df does not have."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def n_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def bucket(col: Column, n: int) -> Column:
    """crc32 of the value as text, modulo n: the documented split into folds."""
    return F.crc32(col.cast("string").cast("binary")) % n


def words(text: Column) -> Column:
    """Array of the words of a text, in order; empty for null."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(WORD), F.lit(0))


def let(value: Column, body) -> Column:
    """body(value) with value worked out once: a lambda variable is not expanded again by the optimizer."""
    return F.element_at(F.transform(F.array(value), body), 1)


def sliced(batches: Iterator[pa.RecordBatch], column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches cut so that the named string column holds about `limit` bytes a piece."""
    for batch in batches:
        col = batch.column(batch.schema.get_field_index(column))
        sizes = np.asarray(pc.fill_null(pc.binary_length(col), 0)).astype(np.int64)
        piece = np.cumsum(sizes) // limit
        cuts = [0, *(np.flatnonzero(np.diff(piece)) + 1).tolist(), len(batch)] if len(batch) else []
        for a, b in zip(cuts, cuts[1:]):
            yield batch.slice(a, b - a)


def utf8(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts end to end and the n + 1 offsets; null counts as empty."""
    col = pc.fill_null(col.cast(pa.large_string()), "")
    offsets = np.frombuffer(col.buffers()[1], np.int64)[col.offset : col.offset + len(col) + 1] if len(col) else np.zeros(1, np.int64)
    raw = col.buffers()[2] if len(col) else None
    data = np.frombuffer(raw, np.uint8)[offsets[0] : offsets[-1]] if raw is not None and raw.size else np.zeros(0, np.uint8)
    return data, offsets - offsets[0]


_SPACE = np.zeros(256, bool)
_SPACE[list(SPACES)] = True


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and document index of every word; words end at document borders."""
    n = len(data)
    if not n:
        return (np.zeros(0, np.int64),) * 3
    solid = ~_SPACE[data]
    border = np.zeros(n + 1, bool)
    border[offsets] = True
    before = np.empty(n, bool)
    before[0], before[1:] = False, solid[:-1]
    after = np.empty(n, bool)
    after[-1], after[:-1] = False, solid[1:]
    start = np.flatnonzero(solid & (~before | border[:n]))
    end = np.flatnonzero(solid & (~after | border[1:])) + 1
    return start, end, np.searchsorted(offsets, start, side="right") - 1


_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64 for i <= n; base is odd."""
    if base not in _POWERS or len(_POWERS[base][0]) <= n:
        made = []
        for b in (base, pow(base, -1, 1 << 64)):
            p = np.full(n + 1, b, np.uint64)
            p[0] = 1
            made.append(np.cumprod(p))
        _POWERS[base] = tuple(made)
    return _POWERS[base]


def mixed(h: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer: spreads every input bit over the result."""
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


#: Odd multipliers of the rolling hashes.
BASE_A, BASE_B = 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F


def prefix_sums(data: np.ndarray, base: int) -> np.ndarray:
    """Prefix sums of byte * base**i: the hash of any span follows by one subtraction."""
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * powers(base, len(data))[0][: len(data)], out=out[1:])
    return out


def span_hash(sums: np.ndarray, start: np.ndarray, end: np.ndarray, base: int) -> np.ndarray:
    """64-bit hash of each span; equal spans at any place have equal hashes."""
    inverse = powers(base, len(sums) - 1)[1]
    return mixed((sums[end] - sums[start]) * inverse[start] ^ ((end - start).astype(np.uint64) << np.uint64(40)))
