"""Operator 13: alignment of two tokenizers over the corpus.

Byte-level tokens (A, of space + text) and pieces (B, of text) of a document cover the same bytes. The documents of a
slice of an Arrow batch are laid end to end: one bincount of A's ends and one of B's over their bytes give the places
where both end, which cut the tokens into groups, and the places where either ends, each of which closes exactly one
pair of overlapping tokens, a link. Prefix sums at the documents' borders recover every document's figures.

How often an id pair is linked counts over the whole corpus. Links leave a task in blocks of documents: a block keeps its
distinct pairs once, and the place of every link's pair among them, compressed. The pairs of all blocks, a row a block
and pair, are summed, the highest count of every B id (a row a B id, at most the vocabulary) is joined to the sums, and
the counts go back to the blocks, where places turn them into sums by document. Links themselves are never shuffled.

Null and empty texts, and texts whose tokens' bytes are not space + text, have no tokens: zeros and an empty column
groups_sha256. Special tokens' strings are ordinary text. Very long texts are aligned whole; one longer than a slice is a
slice alone. Repeated rows count and appear as often as they are there; null ids stay. Only the key and the text are read.
Empty tables give no rows.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import public_tokenizers
import pyarrow as pa
import sentencepiece
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kmerloom.llm.common import Workspace, sliced, table
from kmerloom.llm.encoders import BYTE_MODEL, ByteEncoder
from kmerloom.llm.piece_codec import MARK, MODEL

#: Links of a block, beyond which the next block begins.
BLOCK_LINKS = 2 << 20
#: Bytes of text that one bincount covers; one longer text is taken alone.
SLICE = 1 << 20
#: Bits of a B id in a pair.
B_BITS = 16


def piece_bytes(sp) -> list[bytes]:
    """The bytes of each piece: markers are spaces, byte pieces are their byte."""
    raw = [re.fullmatch("<0x([0-9A-F]{2})>", p) for p in map(sp.id_to_piece, range(sp.get_piece_size()))]
    return [bytes([int(m[1], 16)]) if m and sp.is_byte(i) else sp.id_to_piece(i).replace(MARK, " ").encode() for i, m in enumerate(raw)]


def ends_of(ids: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    return np.cumsum(sizes[ids])


def align(a: np.ndarray, b: np.ndarray, a_sizes: np.ndarray, b_sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(group of each A token, group of each B token, A token and B token of each link, end of each link's bytes) of two
    runs of ids over the same bytes; links are in order of their bytes."""
    a_end, b_end = ends_of(a, a_sizes), ends_of(b, b_sizes)
    n = int(a_end[-1]) + 1 if len(a_end) else 1
    at_a, at_b = np.bincount(a_end, minlength=n), np.bincount(b_end, minlength=n)
    before = lambda x: np.cumsum(x) - x
    group = before((at_a > 0) & (at_b > 0))
    close = np.flatnonzero(at_a + at_b)
    return group[a_end], group[b_end], before(at_a)[close], before(at_b)[close], close


class Names:
    """Decimal ids with what follows them: a comma in a group, and between groups a bar or a semicolon."""

    def __init__(self, n_a: int, n_b: int):
        self.n_a, self.n_b = n_a, n_b
        self.text = [f"{i}{c}" for n, ends in ((n_a, ",|"), (n_b, ",;")) for c in ends for i in range(n)]

    def of(self, a: np.ndarray, b: np.ndarray, group_a: np.ndarray, group_b: np.ndarray) -> tuple[list[str], np.ndarray]:
        """The texts of all tokens in order of group, A before B, and the group of each."""
        last = lambda g: np.append(g[1:] != g[:-1], True)[: len(g)]
        code = np.concatenate([a + last(group_a) * self.n_a, b.astype(np.int64) + last(group_b) * self.n_b + 2 * self.n_a])
        group = np.concatenate([group_a, group_b])
        order = np.argsort(group, kind="stable")
        return list(map(self.text.__getitem__, code[order].tolist())), group[order]


def pressed(values: np.ndarray) -> bytes:
    return zstandard.compress(values.tobytes())


def opened(raw: bytes, kind: str) -> np.ndarray:
    return np.frombuffer(zstandard.decompress(raw), kind)


def blocks(docs: DataFrame, key: str, text: str, links: int = BLOCK_LINKS, byte_model: str = BYTE_MODEL, piece_model: str | None = None) -> DataFrame:
    """Rows (block, docs, pairs, counts, places): what is known of each document of a block, its distinct id pairs
    (A << B_BITS | B, ascending) with their links, and the place among them of the pair of each link, in order."""
    path = piece_model or public_tokenizers.path(MODEL)
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, sp = ByteEncoder(byte_model, plain=True), sentencepiece.SentencePieceProcessor(model_file=path)
        a_bytes, b_bytes = encode.token_bytes(), piece_bytes(sp)
        if len(b_bytes) > 1 << B_BITS:
            raise ValueError(f"ids of this model do not fit {B_BITS} bits")
        a_sizes, b_sizes = (np.array(list(map(len, x))) for x in (a_bytes, b_bytes))
        names = Names(len(a_bytes), len(b_bytes))
        task, count = TaskContext.get().partitionId(), 0
        done: list[pa.RecordBatch] = []
        seen: list[np.ndarray] = []

        def tokens(texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray] | None]:
            """A and B ids of texts; None where B's do not spell space + text, as A's do by construction: every byte is a token."""
            for t, b in zip(texts, sp.encode(texts, num_threads=1)):
                spelt = b"".join(map(b_bytes.__getitem__, b)) == f" {t}".encode()
                yield (encode(" " + t).astype(np.int64), np.array(b, np.uint16)) if spelt else None

        def packed() -> pa.RecordBatch:
            code, found = pd.factorize(np.concatenate(seen))
            order = np.argsort(found)
            rank = np.empty_like(order)
            rank[order] = np.arange(len(order))
            values, places, counts = found[order], rank[code], np.bincount(code, minlength=len(order))[order]
            rows = pa.Table.from_batches(done).combine_chunks().to_struct_array()
            rows = rows.combine_chunks() if isinstance(rows, pa.ChunkedArray) else rows
            held = pa.ListArray.from_arrays(pa.array([0, len(rows)], pa.int32()), rows)
            return pa.record_batch([pa.array([task << 32 | count]), held, *(pa.array([pressed(v.astype(f))], pa.binary()) for v, f in ((values, "<i8"), (counts, "<i8"), (places, "<u4")))], ["block", "docs", "pairs", "counts", "places"])

        for batch in sliced(batches, "_text", SLICE):
            texts = batch.column(1).to_pylist()
            found = tokens([t for t in texts if t])
            got = [next(found) if t else None for t in texts]
            some = [g for g in got if g]
            n_a, n_b = (np.array([len(g[i]) if g else 0 for g in got], np.int64) for i in (0, 1))
            a = np.concatenate([np.zeros(0, np.int64), *(g[0] for g in some)])
            b = np.concatenate([np.zeros(0, np.uint16), *(g[1] for g in some)])
            group_a, group_b, link_a, link_b, _ = align(a, b, a_sizes, b_sizes)
            # every document with tokens ends a group, so borders in tokens give borders in groups and links
            border = np.cumsum(n_a)
            groups = np.concatenate([[0], group_a + 1])[border]
            links_upto = np.searchsorted(link_a, border)
            n_groups, n_links = np.diff(groups, prepend=0), np.diff(links_upto, prepend=0)
            text, of = names.of(a, b, group_a, group_b)
            cuts = np.searchsorted(of, groups)
            sha = [hashlib.sha256("".join(text[x:y])[:-1].encode()).hexdigest() if y > x else "" for x, y in zip([0, *cuts[:-1].tolist()], cuts.tolist())]
            done.append(pa.record_batch([batch.column(0), *(pa.array(v) for v in (n_a, n_b, n_groups, n_links)), pa.array(sha, pa.string())], ["key", "n_a", "n_b", "n_groups", "n_links", "groups_sha256"]))
            seen.append(a[link_a] << B_BITS | b[link_b])
            if sum(map(len, seen)) >= links or sum(map(len, done)) >= links >> 6:
                yield packed()
                count += 1
                done, seen = [], []
        if done:
            yield packed()

    row = f"struct<key: {kind}, n_a: long, n_b: long, n_groups: long, n_links: long, groups_sha256: string>"
    rows = docs.select(F.col(f"`{key}`").alias("key"), F.col(f"`{text}`").alias("_text"))
    return rows.mapInArrow(run, f"block long, docs array<{row}>, pairs binary, counts binary, places binary")


def _opened_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in range(len(batch)):
            pairs, counts = (opened(batch.column(i)[row].as_py(), "<i8") for i in (1, 2))
            yield pa.record_batch([pa.array(np.full(len(pairs), batch.column(0)[row].as_py())), pa.array(pairs), pa.array(counts)], ["block", "pair", "n"])


def pair_counts(by_block: DataFrame) -> DataFrame:
    """(pair, count, best) of rows (block, pair, n): an id pair's links, and whether no pair of its B id has more."""
    sums = by_block.groupBy("pair").agg(F.sum("n").alias("count"))
    b = F.col("pair").bitwiseAND(F.lit((1 << B_BITS) - 1))
    most = sums.groupBy(b.alias("b")).agg(F.max("count").alias("most"))
    return sums.withColumn("b", b).join(F.broadcast(most), "b").select("pair", "count", (F.col("count") == F.col("most")).alias("best"))  # a row a B id


def aligned(docs: DataFrame, key: str = "doc_id", text: str = "text", links: int = BLOCK_LINKS, byte_model: str = BYTE_MODEL, piece_model: str | None = None) -> DataFrame:
    """Per row of docs: key, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256."""
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(len(batch)):
                docs_, places, sums = (batch.column(i)[row] for i in range(3))
                cols = docs_.values.flatten()
                at = opened(places.as_py(), "<u4")
                found = sums.values.flatten() if sums.is_valid else (pa.array([], pa.int64()),) * 3
                order = np.argsort(np.asarray(found[0]))
                count, best = np.asarray(found[1])[order][at], np.asarray(found[2].cast(pa.int64()))[order][at]
                upto = np.concatenate([[0], np.cumsum(np.asarray(cols[4]))])
                by_doc = lambda v: np.diff(np.concatenate([[0], np.cumsum(v)])[upto])
                out = [*cols[:5], pa.array(by_doc(best)), pa.array(by_doc(count)), cols[5]]
                yield pa.record_batch(out, names)

    names = ["key", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    with Workspace(docs.sparkSession) as space:
        held = space.stored(blocks(docs, key, text, links, byte_model, piece_model))
        rows = space.stored(held.select("block", "pairs", "counts").mapInArrow(_opened_pairs, "block long, pair long, n long"))
        counted = space.stored(pair_counts(rows))
        # both sides hold a pair once a block, or once; Spark may split the frequent ones
        back = rows.select("block", "pair").join(counted.hint("merge"), "pair").groupBy(F.col("block").alias("_block")).agg(F.collect_list(F.struct("pair", "count", "best")).alias("sums"))
        met = held.join(back, F.col("block") == F.col("_block"), "left").select("docs", "places", "sums")
        schema = ", ".join([f"key {kind}", *(f"{n} long" for n in names[1:7]), "groups_sha256 string"])
        return space.result(met.mapInArrow(run, schema).withColumnRenamed("key", key))


def op13_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aligned(table(spark, sf_dir, "documents"))


#: Neither vocabulary's merges can be put in SQL; a test counts all overlapping pairs one by one.
OP13_SQL = None
