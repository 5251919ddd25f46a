"""Packed filters from reads or positions: positions travel in frames of sorted offsets instead of rows.

A filter is cut into blocks of positions. A task gathers MOST positions, sorts them and makes the repeated ones one; a
frame has those of one experiment in one block, two bytes each, or three where a block has more than 2^16. Frames meet by
block, and a task makes the words of one block at a time, about a thousandth of the packed filters.

The words of all experiments at a place come from one task, in the order of place. What goes through filters word by word
may use that (Dealt, or dealt=True in the operators) and needs no further shuffle. Of Dealt filters words are not even rows:
they are made and used in one Python worker a task.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kmerloom.functions.kmers import placed
from kmerloom.plans.spec import HashSpec

#: Positions that a task gathers before it makes frames of them; blocks of a filter, about; words of a batch.
MOST, BLOCKS, WORDS = 1 << 21, 1 << 10, 1 << 16
#: Bits of a block's offsets, at least and at most.
LEAST_BITS, MOST_BITS = 10, 24
#: Bits of a position next to which an experiment's number fits: word numbers are ints.
_POS = 38
_FRAME = "exp_id string, block int, low binary, high binary"


Batches = Iterator[pa.RecordBatch]
_WORD = "exp_id string, word_idx int, word long"


@dataclass(frozen=True)
class Dealt:
    """Packed filters dealt by word: rows that come to a task in the order of place, and what makes words of them there."""

    sent: DataFrame
    opened: Callable[[Batches], Batches] = iter

    def through(self, body: Callable[[Batches], Batches], schema: str) -> DataFrame:
        """body over batches (exp_id, word_idx, word), in the Python worker that makes them."""
        opened = self.opened
        return self.sent.mapInArrow(lambda batches: body(opened(batches)), schema)

    def after(self, body: Callable[[Batches], Batches]) -> Dealt:
        """The same with another step in the worker."""
        opened = self.opened
        return Dealt(self.sent, lambda batches: body(opened(batches)))

    def words(self) -> DataFrame:
        """(exp_id, word_idx, word) as rows."""
        return self.sent.mapInArrow(self.opened, _WORD)


def block_bits(m: int) -> int:
    """Bits of the offsets of a block, for filters of m positions."""
    return min(MOST_BITS, max(LEAST_BITS, ((m - 1) // BLOCKS).bit_length()))


def _binaries(data: np.ndarray, first: np.ndarray) -> pa.Array:
    """Runs of an array that begin at first, as binaries."""
    ends = (np.append(first, len(data)) * data.itemsize).astype(np.int32)
    return pa.BinaryArray.from_buffers(pa.binary(), len(first), [None, pa.py_buffer(ends.tobytes()), pa.py_buffer(data.tobytes())])


def framed(parts: Iterator[tuple[pa.Array, np.ndarray | None, np.ndarray]], bits: int) -> Iterator[pa.RecordBatch]:
    """Frames of (experiments, row of each position or None where each has its own, positions)."""
    names: dict[str, int] = {}
    held, n = [], 0

    def put() -> pa.RecordBatch:
        key = np.concatenate(held)
        held.clear()
        key.sort()
        key = key[np.append(True, key[1:] != key[:-1])]
        of = key >> bits
        first = np.flatnonzero(np.append(True, of[1:] != of[:-1]))
        of = of[first]
        low = _binaries((key & (1 << min(bits, 16)) - 1).astype("<u2"), first)
        high = _binaries((key >> 16 & (1 << bits - 16) - 1).astype(np.uint8), first) if bits > 16 else pa.nulls(len(first), pa.binary())
        exp = pa.array(list(names), pa.string()).take(pa.array(of >> _POS - bits))
        return pa.record_batch([exp, pa.array((of & (1 << _POS - bits) - 1).astype(np.int32)), low, high], ["exp_id", "block", "low", "high"])

    for exp, rows, pos in parts:
        exp = exp.dictionary_encode()
        if not len(pos):
            continue
        ids = np.array([names.setdefault(x, len(names)) for x in exp.dictionary.to_pylist()], np.int64)[np.asarray(exp.indices)]
        held.append((ids if rows is None else ids[rows]) << _POS | pos)
        n += len(pos)
        if n >= MOST:
            yield put()
            names, n = {}, 0
    if held:
        yield put()


def _worded(bits: int):
    """Frames in the order of block and experiment to (exp_id, word_idx, word) in the order of word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mask, now, done = np.zeros(1 << bits, bool), None, []  # done: (experiment, places, words) of the block so far

        def filled() -> None:
            word = np.packbits(mask, bitorder="little").view("<i8")
            at = np.flatnonzero(word)
            done.append((now[1], at, word[at]))
            mask[:] = False

        def put() -> Iterator[pa.RecordBatch]:
            names = pa.array([e for e, _, _ in done], pa.string())
            exp, at, word = np.repeat(np.arange(len(done)), [len(i) for _, i, _ in done]), *(np.concatenate([x[i] for x in done]) for i in (1, 2))
            order = np.argsort(at, kind="stable")
            at = (at + (now[0] << bits - 6)).astype(np.int32)
            for i in range(0, len(order), WORDS):
                o = order[i : i + WORDS]
                yield pa.record_batch([names.take(pa.array(exp[o])), pa.array(at[o]), pa.array(word[o])], ["exp_id", "word_idx", "word"])
            done.clear()

        for batch in batches:
            if not len(batch):
                continue
            exp = batch.column(0).dictionary_encode()
            x, block = np.asarray(exp.indices), np.asarray(batch.column(1))
            first = np.flatnonzero(np.concatenate([[True], (x[1:] != x[:-1]) | (block[1:] != block[:-1])]))
            for a, b in zip(first.tolist(), [*first[1:].tolist(), len(batch)]):
                key = int(block[a]), exp.dictionary[int(x[a])].as_py()
                if now is not None and key != now:
                    filled()
                    if key[0] != now[0]:
                        yield from put()
                now = key
                for i in range(a, b, 1024):
                    low, high = (c.slice(i, min(b - i, 1024)).to_pylist() for c in batch.columns[2:])
                    at = np.frombuffer(b"".join(low), "<u2")
                    mask[at if bits <= 16 else at | np.frombuffer(b"".join(high), np.uint8).astype(np.int32) << 16] = True
        if now is not None:
            filled()
            yield from put()

    return run


def _packed(frames: DataFrame, bits: int) -> Dealt:
    return Dealt(frames.repartition("block").sortWithinPartitions("block", "exp_id"), _worded(bits))


def packed_reads(reads: DataFrame, spec: HashSpec) -> Dealt:
    """Packed filters of all k-mers of reads (exp_id, seq) by universal hashes. One shuffle, of frames."""
    bits = block_bits(spec.m)
    rows = reads.where(F.col("exp_id").isNotNull()).select("exp_id", "seq")
    return _packed(rows.mapInArrow(lambda batches: framed(placed(batches, spec), bits), _FRAME), bits)


def packed_positions(rows: DataFrame, m: int) -> Dealt:
    """The same of rows (exp_id, pos) below m, which may repeat."""
    bits = block_bits(m)
    parts = lambda batches: ((b.column(0), None, np.asarray(b.column(1))) for b in batches)
    return _packed(rows.select("exp_id", "pos").mapInArrow(lambda batches: framed(parts(batches), bits), _FRAME), bits)
