"""k-mer counts by minimizers: stretches of reads travel to the count, two bits a letter, instead of k-mers.

Neighbouring windows of a read mostly share their minimizer, the w-letter word in them whose canonical form hashes least.
A run of such windows, a super-k-mer, is cut out whole: c windows take c + k - 1 letters. A window and its reverse
complement have one minimizer, so all occurrences of a k-mer come to one bucket of minimizers, and the count there is
final. Runs travel in frames, a row an experiment, bucket and piece of reads.

A bucket that holds far more than its share of a piece, as repeats make it, travels as counted k-mers instead, at most
its distinct ones: no minimizer is so frequent that its bucket grows with its occurrences. An experiment, however large,
is spread over all buckets. A task reads frames in the order of bucket and holds one slice and the distinct k-mers of one
bucket.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kmerloom.functions.kmers import joined, letters

#: Letters of a minimizer, windows of a run at most, letters of reads or frames that numpy code holds at once.
WIDTH, MOST_RUN, PIECE = 8, 200, 1 << 22
#: A bucket with more than this many windows of a piece, and HEAVY_SHARE times the mean, is counted before it travels.
HEAVY, HEAVY_SHARE = 4096, 8
_FRAME = "exp_id string, bucket int, runs binary, letters binary, kmers binary, counts binary"


def buckets_for(df: DataFrame) -> int:
    """Minimizer buckets of an experiment: a power of two, some for each partition of a shuffle."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return 1 << max(6, min(12, (4 * n - 1).bit_length()))


def _hash(code: np.ndarray) -> np.ndarray:
    """A bijection of 32-bit integers, so that words of few letters are not the least ones."""
    x = code.astype(np.uint32)
    x = (x ^ x >> np.uint32(16)) * np.uint32(0x7FEB352D)
    x = (x ^ x >> np.uint32(15)) * np.uint32(0x846CA68B)
    return x ^ x >> np.uint32(16)


def _minima(x: np.ndarray, n: int) -> np.ndarray:
    """The least of every n neighbours."""
    width = 1
    while 2 * width <= n:
        x = np.minimum(x[:-width], x[width:])
        width *= 2
    return x if width == n else np.minimum(x[: len(x) - (n - width)], x[n - width :])


def super_kmers(data: np.ndarray, k: int, most: int = MOST_RUN) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, windows, minimizer hash) of the runs of windows of bytes that share a minimizer; windows with other letters
    than ACGT are in none."""
    n = len(data) - k + 1
    if n < 1:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint32)
    v, bad = letters(data)
    w = min(WIDTH, k)
    low = _minima(_hash(np.minimum(*joined(v, w))), k - w + 1)
    ok = bad[k:] == bad[:-k]
    new = ok.copy()
    new[1:] &= (low[1:] != low[:-1]) | ~ok[:-1]
    start, stops = np.flatnonzero(new), np.append(np.flatnonzero(new | ~ok), n)
    windows = stops[np.searchsorted(stops, start, side="right")] - start
    parts = -(-windows // most)
    nth = np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
    start, left = np.repeat(start, parts) + nth * most, np.repeat(windows, parts) - nth * most
    return start, np.minimum(left, most), low[start]


def _spans(start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """The places of all spans, one after another."""
    return np.repeat(start - np.cumsum(length) + length, length) + np.arange(length.sum())


def _cut(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    """The batches with reads of more than PIECE letters cut into parts that overlap by the k - 1 letters of a window."""
    for batch in batches:
        if not (pc.max(pc.binary_length(batch.column(1))).as_py() or 0) > PIECE:
            yield batch
            continue
        for row in range(len(batch)):
            seq = batch.column(1)[row].as_py() or ""
            for a in range(0, max(1, len(seq) - k + 1), PIECE):
                yield pa.record_batch([batch.column(0).slice(row, 1), pa.array([seq[a : a + PIECE + k - 1]])], batch.schema.names)


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Array, np.ndarray, np.ndarray]]:
    """(experiments, bytes with a line feed behind each read, their ends), about PIECE letters each."""
    held, size = [], 0

    def put():
        t = pa.Table.from_batches(held).combine_chunks()
        seq = pc.fill_null(t.column(1).combine_chunks() if t.num_rows else pa.array([], pa.string()), "")
        seq = seq.combine_chunks() if isinstance(seq, pa.ChunkedArray) else seq
        data = np.frombuffer(("\n".join(seq.to_pylist()) + "\n").encode(), np.uint8)
        exp = t.column(0).combine_chunks()
        exp = exp.combine_chunks() if isinstance(exp, pa.ChunkedArray) else exp
        return exp, data, np.cumsum(np.asarray(pc.binary_length(seq)).astype(np.int64) + 1)

    for batch in batches:
        length = np.asarray(pc.fill_null(pc.binary_length(batch.column(1)), 0)).astype(np.int64)
        piece = (size + np.cumsum(length)) // PIECE
        cuts = [0, *(np.flatnonzero(np.diff(piece)) + 1).tolist(), len(batch)]
        for a, b in zip(cuts, cuts[1:]):
            if a and held:
                yield put()
                held, size = [], 0
            held.append(batch.slice(a, b - a))
            size += int(length[a:b].sum())
        if size >= PIECE:
            yield put()
            held, size = [], 0
    if held:
        yield put()


def _binaries(data: np.ndarray, sizes: np.ndarray) -> pa.Array:
    upto = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
    return pa.BinaryArray.from_buffers(pa.binary(), len(sizes), [None, pa.py_buffer(upto.tobytes()), pa.py_buffer(np.ascontiguousarray(data).tobytes())])


def _summed(group: np.ndarray, kmer: np.ndarray, n: np.ndarray | None, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(group, kmer, n), distinct and in order; n None: one each."""
    if not len(kmer):
        return group, kmer, np.zeros(0, np.int64)
    if int(group.max()) >> 63 - 2 * k:
        order = np.lexsort((kmer, group))
        group, kmer = group[order], kmer[order]
        new = np.append(True, (kmer[1:] != kmer[:-1]) | (group[1:] != group[:-1]))
    else:
        key = group << 2 * k | kmer
        order = np.argsort(key) if n is not None else None
        key = np.sort(key) if n is None else key[order]
        group, kmer, new = key >> 2 * k, key & (1 << 2 * k) - 1, np.append(True, key[1:] != key[:-1])
    at = np.flatnonzero(new)
    return group[at], kmer[at], np.diff(np.append(at, len(kmer))) if n is None else np.add.reduceat(n[order], at)


def frames(reads: DataFrame, k: int, buckets: int) -> DataFrame:
    """Rows (exp_id, bucket, runs, letters, kmers, counts) of reads (exp_id, seq): a frame of super-k-mers (windows of each
    run, a byte each, and its letters, each run filled up to whole bytes), or of counted k-mers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for exp, data, ends in _pieces(_cut(batches, k)):
            start, windows, low = super_kmers(data, k)
            if not len(start):
                continue
            names = exp.dictionary_encode()
            x = np.asarray(names.indices)[np.searchsorted(ends, start, side="right")].astype(np.int64)
            key = x * buckets + (low >> np.uint32(5)) % buckets
            order = np.argsort(key, kind="stable")
            key, start, windows = key[order], start[order], windows[order]
            first = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
            held = np.add.reduceat(windows, first)
            heavy = (held > HEAVY) & (held > HEAVY_SHARE * (windows.sum() // len(first)))
            of = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(key))))
            v, _ = letters(data)
            rows = lambda g, *cols: pa.record_batch([names.dictionary.take(pa.array(key[first[g]] // buckets)), pa.array((key[first[g]] % buckets).astype(np.int32)), *cols], ["exp_id", "bucket", "runs", "letters", "kmers", "counts"])
            none = lambda n: pa.nulls(n, pa.binary())
            light = np.flatnonzero(~heavy)
            if len(light):
                mine = ~heavy[of]
                size = -(-(windows[mine] + k - 1) // 4)
                four = v[np.minimum(_spans(start[mine], 4 * size), len(v) - 1)].reshape(-1, 4)
                packed = four[:, 0] << 6 | four[:, 1] << 4 | four[:, 2] << 2 | four[:, 3]
                edge = np.flatnonzero(np.append(True, np.diff(of[mine]) > 0))
                yield rows(light, _binaries(windows[mine].astype(np.uint8), np.diff(np.append(edge, mine.sum()))), _binaries(packed, np.add.reduceat(size, edge)), none(len(light)), none(len(light)))
            if heavy.any():
                g = np.flatnonzero(heavy)
                mine = heavy[of]
                kmer = np.minimum(*joined(v, k))[_spans(start[mine], windows[mine])]
                group, kmer, n = _summed(np.repeat(of[mine], windows[mine]), kmer, None, k)
                sizes = 8 * np.bincount(np.searchsorted(g, group), minlength=len(g))
                yield rows(g, none(len(g)), none(len(g)), _binaries(kmer.astype("<i8").view(np.uint8), sizes), _binaries(n.astype("<i8").view(np.uint8), sizes))

    return reads.where(F.col("exp_id").isNotNull()).select("exp_id", "seq").mapInArrow(run, _FRAME)


_FOUR = (np.arange(256)[:, None] >> np.array([6, 4, 2, 0]) & 3).astype(np.uint8)


def _bytes(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes end to end and the size of each; null is empty."""
    sizes = np.asarray(pc.fill_null(pc.binary_length(col), 0)).astype(np.int64)
    return np.frombuffer(b"".join(col.drop_null().to_pylist()), np.uint8), sizes


def _counted(k: int):
    """Frames in the order of experiment and bucket to (exp_id, kmer, n)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        carry = None  # (experiment, bucket, kmers, counts) of the group that may go on

        def rows(exp, kmer, n):
            return pa.record_batch([exp, pa.array(kmer), pa.array(n)], ["exp_id", "kmer", "n"])

        alone = lambda c: rows(pa.array([c[0]] * len(c[2]), pa.string()), *c[2:])
        for batch in batches:
            size = np.asarray(pc.add(pc.fill_null(pc.multiply(pc.binary_length(batch.column(3)), 4), 0), pc.fill_null(pc.binary_length(batch.column(4)), 0))).astype(np.int64)
            cuts = [0, *(np.flatnonzero(np.diff(np.cumsum(size) // PIECE)) + 1).tolist(), len(batch)]
            for a, b in zip(cuts, cuts[1:]):
                part = batch.slice(a, b - a)
                exp = part.column(0).dictionary_encode()
                x, bucket = np.asarray(exp.indices).astype(np.int64), np.asarray(part.column(1)).astype(np.int64)
                group = np.cumsum(np.append(0, (x[1:] != x[:-1]) | (bucket[1:] != bucket[:-1])))
                windows, n_runs = _bytes(part.column(2))
                packed, _ = _bytes(part.column(3))
                windows = windows.astype(np.int64)
                room = 4 * -(-(windows + k - 1) // 4)
                kmer = np.minimum(*joined(_FOUR[packed].ravel(), k))[_spans(np.cumsum(room) - room, windows)] if len(windows) else np.zeros(0, np.int64)
                owner = np.repeat(np.repeat(group, n_runs), windows)
                ready, sizes = _bytes(part.column(4))
                more = [(np.repeat(group, sizes // 8), ready.view("<i8"), _bytes(part.column(5))[0].view("<i8"))] if len(ready) else []
                if carry and carry[:2] == (exp.dictionary[int(x[0])].as_py(), int(bucket[0])):
                    more.append((np.zeros(len(carry[2]), np.int64), *carry[2:]))
                elif carry:
                    yield alone(carry)
                n = np.concatenate([np.ones(len(kmer), np.int64), *(m[2] for m in more)]) if more else None
                owner, kmer, n = _summed(np.concatenate([owner, *(m[0] for m in more)]), np.concatenate([kmer, *(m[1] for m in more)]), n, k)
                last = np.searchsorted(owner, group[-1])
                if last:
                    lead = x[np.searchsorted(group, np.arange(group[-1] + 1))]
                    yield rows(exp.dictionary.take(pa.array(lead[owner[:last]])), kmer[:last], n[:last])
                carry = (exp.dictionary[int(x[-1])].as_py(), int(bucket[-1]), kmer[last:], n[last:])
        if carry:
            yield alone(carry)

    return run


def counted_by_minimizer(reads: DataFrame, k: int, buckets: int | None = None) -> DataFrame:
    """(exp_id, kmer, n): occurrences of canonical k-mers in reads (exp_id, seq); k <= 31. Null experiments and sequences
    are left out. One shuffle, of frames; the result needs no further aggregate."""
    buckets = buckets or buckets_for(reads)
    n = int(reads.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = frames(reads, k, buckets).repartition(n, "exp_id", "bucket").sortWithinPartitions("exp_id", "bucket")
    return dealt.mapInArrow(_counted(k), "exp_id string, kmer long, n long")
