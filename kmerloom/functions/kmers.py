"""k-mers of sequences, their canonical form and their hash positions.

A k-mer of k <= 31 is a long, two bits a letter (A 0, C 1, G 2, T 3, the first letter highest), so the order of longs is
that of the texts; a longer one is a string. Windows are cut in Arrow batches in time linear in the text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kmerloom.plans.spec import LONG_K, HashSpec

#: Letters of a text, both cases, and the bases that they stand for in turn.
LETTERS = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ"
BASES = ("ACGT" * 13)[: len(LETTERS)]
#: Bytes of sequence that numpy code holds at once, however long a sequence is.
PIECE = 1 << 18

_CODE = np.full(256, 255, np.uint8)
_CODE[list(b"ACGT")] = range(4)
_COMPLEMENT = str.maketrans("ACGT", "TGCA")


def sequence_of(text: Column) -> Column:
    """A sequence derived from a text: letters become bases in turn, everything else goes."""
    return F.regexp_replace(F.translate(text, LETTERS, BASES), "[^ACGT]", "")


def letters_of(kmer: Column, k: int) -> Column:
    """The text of a k-mer."""
    if k > LONG_K:
        return kmer
    return F.concat(*(F.substring(F.lit("ACGT"), (F.shiftright(kmer, 2 * i).bitwiseAND(F.lit(3)) + 1).cast("int"), F.lit(1)) for i in range(k - 1, -1, -1)))


def joined(v: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(forward, reverse-complement) codes of all windows of an array of letters 0 to 3; k <= 31.

    Windows of twice the width come from two neighbours, and those of width k from the widths that k is the sum of.
    """
    v = v.astype(np.int64)
    forward, back, width, ahead, behind, done = v, 3 - v, 1, None, None, 0
    while True:
        if k & width:
            if done:
                m = min(len(ahead), len(forward) - done)
                ahead = ahead[:m] << 2 * width | forward[done : done + m]
                behind = back[done : done + m] << 2 * done | behind[:m]
            else:
                ahead, behind = forward, back
            done += width
        if done == k:
            return ahead, behind
        m = len(forward) - width
        forward, back = forward[:m] << 2 * width | forward[width:], back[width:] << 2 * width | back[:m]
        width *= 2


def letters(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(letters 0 to 3, how many others come before each place and at the end) of bytes."""
    v = _CODE[data]
    return v & 3, np.concatenate([[0], np.cumsum(v > 3)])


def codes(data: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(places, forward codes, canonical codes) of the windows of bytes that are all letters ACGT; k <= 31."""
    if len(data) < k:
        return (np.zeros(0, np.int64),) * 3
    v, bad = letters(data)
    at = np.flatnonzero(bad[k:] == bad[:-k])
    ahead, behind = (x[at] for x in joined(v, k))
    return at, ahead, np.minimum(ahead, behind)


def _strings(text: str, k: int) -> list[tuple[int, str, str]]:
    out = []
    for i in range(len(text) - k + 1):
        w = text[i : i + k]
        if not w.strip("ACGT"):
            out.append((i, w, min(w, w[::-1].translate(_COMPLEMENT))))
    return out


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches in slices of whole rows: a slice has at most PIECE letters besides those of its last sequence."""
    for batch in batches:
        size = np.cumsum(np.asarray(pc.fill_null(pc.binary_length(batch.column(batch.num_columns - 1)), 0)).astype(np.int64) + 1)
        cuts = [0, *(np.flatnonzero(np.diff(size // PIECE)) + 1).tolist(), len(batch)]
        for a, b in zip(cuts, cuts[1:]):
            if b > a:
                yield batch.slice(a, b - a)


def _windows(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray, pa.Array, pa.Array]]:
    """(batch, rows, places, windows, canonical windows) in pieces; the last column of a batch is the sequence."""
    for batch in _slices(batches):
        seq = batch.column(batch.num_columns - 1)
        if k > LONG_K:
            for row, text in enumerate(seq.to_pylist()):
                got = _strings(text or "", k)
                for a in range(0, len(got), PIECE // k):
                    places, raw, low = zip(*got[a : a + PIECE // k])
                    yield batch, np.full(len(places), row), np.array(places), pa.array(raw), pa.array(low)
            continue
        # sequences end to end with a byte between them that is no letter
        joined = np.frombuffer("\n".join(pc.fill_null(seq, "").to_pylist()).encode(), np.uint8)
        ends = np.cumsum(np.asarray(pc.fill_null(pc.binary_length(seq), 0)).astype(np.int64) + 1)
        for a in range(0, len(joined), PIECE):
            at, raw, low = codes(joined[a : a + PIECE + k - 1], k)
            rows = np.searchsorted(ends, at + a, side="right")
            if len(at):
                yield batch, rows, at + a - np.concatenate([[0], ends])[rows], pa.array(raw), pa.array(low)


def _kind(k: int) -> str:
    return "string" if k > LONG_K else "long"


def windows(df: DataFrame, seq: str, k: int) -> DataFrame:
    """One row per k-mer occurrence of column seq, which is dropped: place (from 0), raw, and kmer, its canonical form.

    Windows with other letters than ACGT are skipped. Null and short sequences give no rows. No shuffle.
    """
    keep = [c for c in df.columns if c != seq]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, rows, places, raw, low in _windows(batches, k):
            kept = batch.select(keep).take(pa.array(rows))
            yield pa.record_batch([*kept.columns, pa.array(places.astype(np.int32)), raw, low], [*keep, "place", "raw", "kmer"])

    schema = [f"`{c}` {df.schema[c].dataType.simpleString()}" for c in keep]
    return df.select(*keep, seq).mapInArrow(run, ", ".join([*schema, "place int", f"raw {_kind(k)}", f"kmer {_kind(k)}"]))


def canonical(reads: DataFrame, k: int) -> DataFrame:
    """(exp_id, kmer): canonical k-mers of reads (exp_id, seq), a row an occurrence."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, rows, _, _, low in _windows(batches, k):
            yield pa.record_batch([batch.column(0).take(pa.array(rows)), low], ["exp_id", "kmer"])

    return reads.where(F.col("exp_id").isNotNull()).select("exp_id", "seq").mapInArrow(run, f"exp_id string, kmer {_kind(k)}")


def counted(reads: DataFrame, k: int, sieve: bytes | None = None) -> DataFrame:
    """(exp_id, kmer, n): canonical k-mers of reads (exp_id, seq), counted within pieces; the rest is an aggregate.

    sieve, of kmer_sieve(), for k <= 31: k-mers that it shows to be none of its table's never leave Python.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = _opened(sieve)
        for batch, rows, _, _, low in _windows(batches, k):
            if kept is not None:
                near = np.flatnonzero(kept[_linear_of(np.asarray(low), COEFFICIENTS[0]) % SIEVE])
                rows, low = rows[near], pa.array(np.asarray(low)[near])
                if not len(near):
                    continue
            exp = batch.column(0).dictionary_encode()
            x = np.asarray(exp.indices)[rows].astype(np.int64)
            if k > LONG_K:
                t = pa.table({"x": x, "kmer": low}).group_by(["x", "kmer"]).aggregate([([], "count_all")])
                yield pa.record_batch([exp.dictionary.take(c) if i == 0 else c for i, c in enumerate(t.combine_chunks().to_batches()[0].select(["x", "kmer", "count_all"]).columns)], ["exp_id", "kmer", "n"])
                continue
            code = np.asarray(low)
            order = np.argsort(code, kind="stable") if len(exp.dictionary) == 1 else np.lexsort((code, x)) if len(exp.dictionary) >> 63 - 2 * k else np.argsort(x << 2 * k | code)
            code, x = code[order], x[order]
            new = np.flatnonzero(np.concatenate([[True], (code[1:] != code[:-1]) | (x[1:] != x[:-1])]))
            yield pa.record_batch([exp.dictionary.take(pa.array(x[new])), pa.array(code[new]), pa.array(np.diff(np.append(new, len(code))))], ["exp_id", "kmer", "n"])

    return reads.where(F.col("exp_id").isNotNull()).select("exp_id", "seq").mapInArrow(run, f"exp_id string, kmer {_kind(k)}, n long")


#: The prime of the universal hashes, and their coefficients: two hashes of 31 bits make one of 62. Fixed values.
PRIME = (1 << 31) - 1
COEFFICIENTS = (
    (1403580810, 810728361, 1640531527, 299792458),
    (1181783497, 1566083941, 668265263, 374761393),
    (2054323661, 1099087573, 1812433253, 69069),
    (1664525, 1103515245, 1597334677, 1013904223),
)
_LOW = (1 << 21) - 1


def _linear(code: Column, c: tuple[int, int, int, int]) -> Column:
    parts = F.shiftright(code, 42), F.shiftright(code, 21).bitwiseAND(F.lit(_LOW)), code.bitwiseAND(F.lit(_LOW))
    return sum((p * F.lit(x).cast("long") for p, x in zip(parts, c)), F.lit(c[3]).cast("long")) % PRIME


def hashes(kmer: Column, spec: HashSpec) -> tuple[Column, Column]:
    """Two hashes of a k-mer, not negative: linear ones of the code's parts modulo a prime, or xxhash64."""
    if spec.family == "xxhash64":
        return F.pmod(F.xxhash64(kmer), F.lit(1 << 60)), F.pmod(F.xxhash64(kmer, F.lit(1)), F.lit(1 << 60))
    return tuple(_linear(kmer, COEFFICIENTS[i]) * F.lit(1 << 31) + _linear(kmer, COEFFICIENTS[i + 1]) for i in (0, 2))


def positions(kmer: Column, spec: HashSpec) -> Column:
    """Array of the nh filter positions of a canonical k-mer, by double hashing; duplicates stay."""
    h0, h1 = hashes(kmer, spec)
    m = F.lit(spec.m)
    return F.array(*(F.pmod(h0 % m + i * (h1 % m), m) if i else h0 % m for i in range(spec.nh)))


#: Bits of a sieve: what a table of keys, however large, is known by in Python.
SIEVE = 1 << 23


def _linear_of(code: np.ndarray, c: tuple[int, int, int, int]) -> np.ndarray:
    """_linear of an array."""
    return ((code >> 42) * c[0] + (code >> 21 & _LOW) * c[1] + (code & _LOW) * c[2] + c[3]) % PRIME


def positions_of(code: np.ndarray, spec: HashSpec) -> Iterator[np.ndarray]:
    """positions() of an array of canonical k-mers by the universal hashes: one hash after another."""
    within = (lambda x: x & spec.m - 1) if spec.m & spec.m - 1 == 0 else (lambda x: x % spec.m)
    h0, h1 = (within(_linear_of(code, COEFFICIENTS[i]) * (1 << 31) + _linear_of(code, COEFFICIENTS[i + 1])) if i < 2 * spec.nh else None for i in (0, 2))
    for i in range(spec.nh):
        yield within(h0 + i * h1) if i else h0


def _sieve(places: DataFrame) -> bytes:
    """The bits at places (at), at most SIEVE of them: a megabyte, however many rows there are."""
    words = places.groupBy(F.shiftright("at", 6).alias("w")).agg(F.expr("bit_or(shiftleft(1L, cast(at % 64 as int)))").alias("bits"))
    out = np.zeros(SIEVE // 64, "<i8")
    for w, bits in words.collect():
        out[w] = bits
    return out.tobytes()


def kmer_sieve(kmers: DataFrame) -> bytes:
    """A sieve that lets all k-mers of a table (kmer) through, k <= 31, and few others while the table has fewer rows than
    bits; what passes is still to be joined with the table."""
    return _sieve(kmers.select((_linear(F.col("kmer"), COEFFICIENTS[0]) % SIEVE).alias("at")))


def position_sieve(bits: DataFrame) -> bytes:
    """The same of positions (pos)."""
    return _sieve(bits.select((F.col("pos") % SIEVE).alias("at")))


def _opened(sieve: bytes | None) -> np.ndarray | None:
    return None if sieve is None else np.unpackbits(np.frombuffer(sieve, np.uint8), bitorder="little").astype(bool)


def placed(batches: Iterator[pa.RecordBatch], spec: HashSpec, sieve: bytes | None = None) -> Iterator[tuple[pa.Array, np.ndarray, np.ndarray]]:
    """(experiments, row of each position, positions) of batches (exp_id, seq), a piece and a hash at a time."""
    kept = _opened(sieve)
    for batch, rows, _, _, low in _windows(batches, spec.k):
        for pos in positions_of(np.asarray(low), spec):
            near = None if kept is None else np.flatnonzero(kept[pos % SIEVE])
            yield (batch.column(0), rows, pos) if near is None else (batch.column(0), rows[near], pos[near])


def near_positions(reads: DataFrame, spec: HashSpec, sieve: bytes) -> DataFrame:
    """(exp_id, pos): positions of reads (exp_id, seq) that a sieve of position_sieve() lets through, by the universal
    hashes; a row an occurrence."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for exp, rows, pos in placed(batches, spec, sieve):
            if len(pos):
                yield pa.record_batch([exp.take(pa.array(rows)), pa.array(pos)], ["exp_id", "pos"])

    return reads.where(F.col("exp_id").isNotNull()).select("exp_id", "seq").mapInArrow(run, "exp_id string, pos long")
