"""Operator 9: SentencePiece encoding and decoding through a distinct-chunk table.

A chunk is a run of word markers and the text up to the next marker. No piece of the vocabulary has a marker after
another character (checked when the model is opened), so segmentation never crosses a chunk border: each distinct
chunk of the corpus is segmented once, and a text's ids are its chunks' ids joined by position.

Positions travel packed. A block of documents is kept as its distinct chunks, combined before any shuffle and dealt
into PARTS by hash, and the place in that list of every chunk of its texts. Blocks form groups of about GROUP_BLOCKS, some
GB of text, and a part of all blocks of a group meets in one task, whose table segments each chunk once; ids go back to
the blocks, one row a block and part, and are joined there by place. Neither the rows of a block nor the size of a table
depends on how many blocks there are, so rows grow with the input and not with its square: a chunk is segmented once a
group. Blocks are kept bucketed, so that only ids travel to that join, and all lists are compressed.

Null and empty texts have no ids and decode to the empty text. Very long texts and texts without spaces are encoded
whole; one that is longer than a block is a block alone. Repeated rows repeat. Only the key and text columns are read.
Empty tables give no rows.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from array import array
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import sentencepiece
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kmerloom.llm.common import Workspace, n_partitions, sliced, table

MODEL = "piece_bpe_32k.model"
MARK = "▁"
_CHUNK = re.compile(f"{MARK}+[^{MARK}]*")
#: Between the chunks of a frame: a byte that UTF-8 does not have.
END = b"\xff"
#: Characters of a block's texts, beyond which the next block begins.
BLOCK_CHARS = 16 << 20
#: Parts of a block's distinct chunks, and blocks that share tables: more blocks are more groups.
PARTS, GROUP_BLOCKS = 32, 64
#: Chunks that are put together at once from a block's places; one longer text is taken alone.
STEP = 1 << 18
#: Buckets that Spark allows a table.
MOST_BUCKETS = 100_000


def chunks_of(text: str | None) -> list[str]:
    """The chunks of a text, in order; the library puts the first marker itself, except before an empty text."""
    return _CHUNK.findall(MARK + text.replace(" ", MARK)) if text else []


def pressed(values: np.ndarray) -> bytes:
    """An array of integers, compressed: the first bytes of all, then the second ones, and so on."""
    return zstandard.compress(np.ascontiguousarray(values.view(np.uint8).reshape(-1, values.itemsize).T).tobytes())


def opened(raw: bytes, kind: str) -> np.ndarray:
    planes = np.frombuffer(zstandard.decompress(raw), np.uint8).reshape(np.dtype(kind).itemsize, -1)
    return np.ascontiguousarray(planes.T).view(kind).ravel()


class Segmenter(dict):
    """chunk in UTF-8 -> its ids, 16 bits each."""

    def __init__(self, model_file: str):
        super().__init__()
        self.sp = sentencepiece.SentencePieceProcessor(model_file=model_file)
        pieces = list(map(self.sp.id_to_piece, range(self.sp.get_piece_size())))
        if any(MARK in p.lstrip(MARK) for p in pieces):
            raise ValueError("a piece of this model crosses word markers")
        if len(pieces) > 1 << 16:
            raise ValueError("ids of this model do not fit 16 bits")
        self.mark = [self.sp.piece_to_id(MARK)]

    def of(self, chunks: list[bytes]) -> list[array]:
        """The ids of chunks; those that are not in the table yet are segmented, each once."""
        new = list({c for c in chunks if c not in self})
        plain = [c.decode()[1:].replace(MARK, " ") for c in new]
        self.update((c, array("H", ids or self.mark)) for c, ids in zip(new, self.sp.encode(plain, num_threads=1)))
        return list(map(self.__getitem__, chunks))


def blocks(docs: DataFrame, key: str, text: str, parts: int = PARTS, chars: int = BLOCK_CHARS) -> DataFrame:
    """Rows (block, keys, sizes, places, dealt, frames): ids of a block's documents, the number of chunks of each, the place
    of every chunk among the block's distinct ones, the part of each of these (a hash of the chunk), and they, by part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, count = TaskContext.get().partitionId(), 0
        keys, sizes, places, book, used = [], [], [], defaultdict(), 0
        book.default_factory = book.__len__

        def packed() -> pa.RecordBatch:
            chunks = [c.encode() for c in book]
            part = np.fromiter((zlib.crc32(c) % parts for c in chunks), "<u4", len(chunks))
            order = np.argsort(part, kind="stable")
            names_, first = np.unique(part[order], return_index=True)
            chunks = [chunks[i] for i in order.tolist()]
            held = [zstandard.compress(END.join(chunks[a:b])) for a, b in zip(first.tolist(), [*first[1:].tolist(), len(chunks)])]
            frames = pa.StructArray.from_arrays([pa.array(names_.astype(np.int32)), pa.array(held, pa.binary())], ["part", "chunks"])
            lists = [pa.ListArray.from_arrays(pa.array([0, len(v)], pa.int32()), v) for v in (pa.concat_arrays(keys), pa.array(sizes, pa.int32()), frames)]
            flat = [pa.array([pressed(v)], pa.binary()) for v in (np.concatenate(places), part)]
            return pa.record_batch([pa.array([task << 32 | count], pa.int64()), *lists[:2], *flat, lists[2]], names)

        for batch in sliced(batches, text):
            keys.append(batch.column(0))
            for t in batch.column(1).to_pylist():
                found = chunks_of(t)
                sizes.append(len(found))
                places.append(np.fromiter(map(book.__getitem__, found), "<u4", len(found)))
                used += len(t or "")
            if used >= chars or len(sizes) >= chars // 64:
                yield packed()
                count += 1
                keys, sizes, places, used = [], [], [], 0
                book.clear()
        if keys:
            yield packed()

    names = ["block", "keys", "sizes", "places", "dealt", "frames"]
    kind = docs.schema[key].dataType.simpleString()
    schema = f"block long, keys array<{kind}>, sizes array<int>, places binary, dealt binary, frames array<struct<part: int, chunks: binary>>"
    return docs.select(F.col(key).alias("key"), F.col(text).alias(text)).mapInArrow(run, schema)


def segmented(frames: DataFrame, model_file: str, groups: int, parts: int = PARTS) -> DataFrame:
    """(block, part, counts, ids) of rows (block, part, chunks): all frames of a part and group meet in one task and share
    its table."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, at = Segmenter(model_file), None
        for batch in batches:
            for row in range(len(batch)):
                table_ = batch.column(3)[row].as_py()
                if table_ != at:
                    known.clear()
                    at = table_
                found = known.of(zstandard.decompress(batch.column(2)[row].as_py()).split(END))
                counts, ids = np.fromiter(map(len, found), "<u4", len(found)), np.frombuffer(b"".join(found), np.uint16).astype("<u2")
                lists = [pa.array([pressed(v)], pa.binary()) for v in (counts, ids)]
                yield pa.record_batch([*(batch.column(i).slice(row, 1) for i in range(2)), *lists], ["block", "part", "counts", "ids"])

    table_of = (F.pmod(F.xxhash64("block"), F.lit(groups)) * parts + F.col("part")).alias("table")
    n = min(groups * parts, max(parts, n_partitions(frames.sparkSession)))
    dealt = frames.select("block", "part", "chunks", table_of).repartitionById(n, F.pmod("table", F.lit(n)).cast("int")).sortWithinPartitions("table")
    return dealt.mapInArrow(run, "block long, part int, counts binary, ids binary")


def encoded(docs: DataFrame, key: str = "doc_id", text: str = "text", model_file: str | None = None, ids: bool = False, chars: int = BLOCK_CHARS) -> DataFrame:
    """Per row of docs: key, n_tokens, ids_sha256, decoded_sha256; with ids=True also ids (array) and decoded."""
    path = model_file or public_tokenizers.path(MODEL)
    kind = docs.schema[key].dataType.simpleString()
    buckets = min(n_partitions(docs.sparkSession), MOST_BUCKETS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        name = list(map(str, range(sp.get_piece_size())))
        for batch in batches:
            for row in range(len(batch)):
                keys, sizes, places, dealt, frames = (batch.column(i)[row] for i in range(5))
                frames, flat = frames.as_py() or [], opened(places.as_py(), "<u4")
                counts = np.concatenate([np.zeros(0, np.int64), *(opened(f["counts"], "<u4").astype(np.int64) for f in frames)])
                own = np.concatenate([np.zeros(0, "<u2"), *(opened(f["ids"], "<u2") for f in frames)])
                count, start = np.empty_like(counts), np.empty_like(counts)
                order = np.argsort(opened(dealt.as_py(), "<u4"), kind="stable")
                count[order], start[order] = counts, np.cumsum(counts) - counts
                upto = np.cumsum(np.asarray(sizes.values, np.int64))
                cuts = [0, *(np.flatnonzero(np.diff(upto // STEP)) + 1).tolist(), len(upto)]
                for a, b in zip(cuts, cuts[1:]):
                    base = int(upto[a - 1]) if a else 0
                    at = flat[base : upto[b - 1]]
                    n, first = count[at], start[at]
                    ends = np.cumsum(n)
                    run_ids = own[np.repeat(first - ends + n, n) + np.arange(n.sum())].tolist()
                    edges = np.concatenate([[0], ends])[np.concatenate([[0], upto[a:b] - base])].tolist()
                    got = [run_ids[x:y] for x, y in zip(edges, edges[1:])]
                    text_of = [sp.decode(g) if g else "" for g in got]
                    cols = [keys.values.slice(a, b - a), pa.array(list(map(len, got)), pa.int64()), pa.array([sha(",".join([name[i] for i in g])) for g in got], pa.string()), pa.array(list(map(sha, text_of)), pa.string())]
                    if ids:
                        cols += [pa.array(got, pa.list_(pa.int32())), pa.array(text_of, pa.string())]
                    yield pa.record_batch(cols, names)

    names = [key, "n_tokens", "ids_sha256", "decoded_sha256"] + ["ids", "decoded"] * ids
    schema = f"`{key}` {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>, decoded string" * ids
    with Workspace(docs.sparkSession) as space, space.bucketed(blocks(docs, key, text, PARTS, chars), "block", buckets) as own:
        groups = max(1, -(-own.count() // GROUP_BLOCKS))
        rows = segmented(own.select("block", F.explode("frames").alias("f")).select("block", "f.part", "f.chunks"), path, groups)
        met = rows.groupBy(F.col("block").alias("_block")).agg(F.sort_array(F.collect_list(F.struct("part", "counts", "ids"))).alias("rows"))
        joined = own.join(met, F.col("block") == F.col("_block"), "left")
        return space.result(joined.select("keys", "sizes", "places", "dealt", "rows").mapInArrow(run, schema))


def op9_piece_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encoded(table(spark, sf_dir, "documents"))


#: Segmentation by merges cannot be put in SQL; tests hold the query against the library itself.
OP9_SQL = None
