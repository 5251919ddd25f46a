"""Alignment files as a Spark data source: block-compressed files are split at block borders.

    spark.dataSource.register(BamSource)
    spark.read.format("bam").load("/reads/*.bam")

A file is a chain of gzip members that carry their own size, and records run on over their borders. A task takes the
records that begin in the members of its byte range. Where the first of them begins follows from the content: the first
place from which some records in a row are sound. A task that reaches the end of its range knows where the next record
really begins; it takes the next task's way to find it, too, and fails where the two differ, so no record is lost or read
twice in silence.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SCHEMA = "exp_id string, read_id string, seq string"
#: Compressed bytes of a partition, records in a row that must be sound, rows of a batch.
SPLIT_BYTES, SOUND, ROWS = 32 << 20, 4, 4096
#: The members' first bytes, the letters of packed sequences, the flag of a read that is stored reversed.
MAGIC, LETTERS, REVERSED = b"\x1f\x8b\x08\x04", b"=ACMGRSVTWYHKDBN", 0x10
_PAIRS = [bytes([LETTERS[i >> 4], LETTERS[i & 15]]) for i in range(256)]
_COMPLEMENT = bytes.maketrans(b"ACGTMRYKVHDB", b"TGCAKYRMBDHV")


class Members:
    """The members of one file from a compressed offset on, as one stream of bytes."""

    def __init__(self, file, size: int, offset: int):
        self.file, self.size, self.next = file, size, offset
        self.data, self.base, self.starts = bytearray(), 0, []  # starts: (place in the stream, compressed offset)

    @staticmethod
    def length(head: bytes) -> int | None:
        """Compressed bytes of the member with this head; None if it is none."""
        if len(head) < 18 or head[:4] != MAGIC:
            return None
        extra, at = head[12 : 12 + struct.unpack_from("<H", head, 10)[0]], 0
        while at + 4 <= len(extra):
            n = struct.unpack_from("<H", extra, at + 2)[0]
            if extra[at : at + 2] == b"BC" and n == 2:
                return struct.unpack_from("<H", extra, at + 4)[0] + 1
            at += 4 + n
        return None

    def more(self) -> bool:
        """Add the next member to the stream; False at the end of the file."""
        if self.next >= self.size:
            return False
        raw = self.file.read_at(min(1 << 16, self.size - self.next), self.next)
        n = self.length(raw)
        if n is None or n > len(raw):
            raise ValueError(f"no block at {self.next}")
        self.starts.append((self.base + len(self.data), self.next))
        self.data += zlib.decompress(raw[:n], 31)
        self.next += n
        return True

    def need(self, at: int, n: int) -> bool:
        """Are there n bytes from place `at` of the stream on?"""
        while self.base + len(self.data) < at + n:
            if not self.more():
                return False
        return True

    def take(self, at: int, n: int) -> memoryview:
        return memoryview(self.data)[at - self.base : at - self.base + n]

    def forget(self, at: int) -> None:
        """Drop what lies before place `at`."""
        if at - self.base > 1 << 22:
            del self.data[: at - self.base]
            self.base = at

    def offset(self, at: int) -> int:
        """Compressed offset of the member that holds place `at`."""
        return next(o for s, o in reversed(self.starts) if s <= at)


def first_member(file, size: int, start: int) -> int:
    """Offset of the first member at or after a byte of the file: one whose successor, or the end, follows it."""
    at = start
    while at < size:
        raw = file.read_at(min(1 << 17, size - at), at)
        k = raw.find(MAGIC)
        while k >= 0:
            n = Members.length(raw[k : k + 64])
            after = at + k + (n or 0)
            if n and (after == size or (after < size and Members.length(file.read_at(min(64, size - after), after)))):
                return at + k
            k = raw.find(MAGIC, k + 1)
        at += max(1, len(raw) - 3)
    return size


def sound(m: Members, at: int, count: int = SOUND) -> bool:
    """Do `count` records in a row, or all up to the end of the file, look like records from this place on?"""
    for _ in range(count):
        if not m.need(at, 1):
            return True
        if not m.need(at, 36):
            return False
        size, ref, pos, name, _, _, cigar, _, letters, ref2, pos2, _ = struct.unpack("<iiiBBHHHiiii", m.take(at, 36))
        if not (32 <= size <= 1 << 28 and -1 <= ref < 1 << 24 and pos >= -1 and -1 <= ref2 < 1 << 24 and pos2 >= -1 and name >= 1 and letters >= 0):
            return False
        if 32 + name + 4 * cigar + (letters + 1) // 2 + letters > size or not m.need(at, 36 + name):
            return False
        text = bytes(m.take(at + 36, name))
        if text[-1] != 0 or any(c < 33 or c > 126 for c in text[:-1]) or not m.need(at, 4 + size):
            return False
        at += 4 + size
    return True


def first_record(file, size: int, start: int) -> tuple[Members, int] | None:
    """(members, place of the first record that begins in a member at or after a byte of the file)."""
    offset = first_member(file, size, start)
    m = Members(file, size, offset)
    if offset == 0:
        m.need(0, 12)
        at = 12 + struct.unpack("<i", m.take(4, 4))[0]
        m.need(at - 4, 4)
        for _ in range(struct.unpack("<i", m.take(at - 4, 4))[0]):
            m.need(at, 4)
            at += 8 + struct.unpack("<i", m.take(at, 4))[0]
        return m, at
    at = 0
    while m.need(at, 1):
        if sound(m, at):
            return m, at
        at += 1
    return None


def records(file, size: int, start: int, end: int) -> Iterator[tuple[str, str]]:
    """(name, sequence as it was read) of the records that begin in the members of a byte range."""
    found = first_record(file, size, start)
    if not found:
        return
    m, at = found
    while m.need(at, 4) and m.offset(at) < end:
        n = struct.unpack("<i", m.take(at, 4))[0]
        if not m.need(at, 4 + n):
            raise ValueError("the last record is cut off")
        body = bytes(m.take(at + 4, n))
        name, cigar, flag, letters = body[8], *struct.unpack_from("<HH", body, 12), struct.unpack_from("<i", body, 16)[0]
        packed = body[32 + name + 4 * cigar :][: (letters + 1) // 2]
        seq = b"".join(map(_PAIRS.__getitem__, packed))[:letters]
        yield body[32 : 31 + name].decode(), (seq.translate(_COMPLEMENT)[::-1] if flag & REVERSED else seq).decode()
        at += 4 + n
        m.forget(at)
    if m.need(at, 1):
        other = first_record(file, size, end)
        # the same place of the same member
        own = m.offset(at), at - next(s for s, _ in reversed(m.starts) if s <= at)
        if not other or (other[0].offset(other[1]), other[1] - next(s for s, _ in reversed(other[0].starts) if s <= other[1])) != own:
            raise ValueError(f"the records of {start} to {end} and those after them do not meet")


class Split(InputPartition):
    def __init__(self, path: str, start: int, end: int):
        super().__init__((path, start, end))


class BamReader(DataSourceReader):
    def __init__(self, path: str, split: int):
        self.path, self.split = path, split

    def partitions(self) -> list[Split]:
        """Byte ranges of the files of a folder, or of one file, or of those that a * in the last part names."""
        import fnmatch

        files, path = pafs.FileSystem.from_uri(self.path) if "://" in self.path else (pafs.LocalFileSystem(), self.path)
        folder, _, name = path.rpartition("/")
        found = [files.get_file_info(path)] if "*" not in name else [f for f in files.get_file_info(pafs.FileSelector(folder)) if fnmatch.fnmatch(f.base_name, name)]
        if found[0:1] and found[0].type == pafs.FileType.Directory:
            found = files.get_file_info(pafs.FileSelector(path))
        return [Split(f.path, a, a + self.split) for f in sorted(found, key=lambda f: f.path) if f.is_file for a in range(0, f.size, self.split)]

    def read(self, partition: Split) -> Iterator[pa.RecordBatch]:
        path, start, end = partition.value
        files = pafs.FileSystem.from_uri(self.path)[0] if "://" in self.path else pafs.LocalFileSystem()
        exp = path.rpartition("/")[2].removesuffix(".bam")
        held: list[tuple[str, str]] = []
        with files.open_input_file(path) as file:
            for row in records(file, files.get_file_info(path).size, start, end):
                held.append(row)
                if len(held) == ROWS:
                    yield self._batch(exp, held)
                    held = []
        if held:
            yield self._batch(exp, held)

    @staticmethod
    def _batch(exp: str, rows: list[tuple[str, str]]) -> pa.RecordBatch:
        names, seqs = zip(*rows)
        return pa.record_batch([pa.array([exp] * len(rows)), pa.array(names), pa.array(seqs)], ["exp_id", "read_id", "seq"])


class BamSource(DataSource):
    """Format "bam": (exp_id, read_id, seq) as the other readers give them. Option splitBytes: compressed bytes of a task."""

    @classmethod
    def name(cls) -> str:
        return "bam"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> BamReader:
        return BamReader(self.options["path"], int(self.options.get("splitBytes", SPLIT_BYTES)))


def read_bam(spark, path: str, split: int = SPLIT_BYTES):
    """(exp_id, read_id, seq) of alignment files: a file is an experiment, a record a read, in the direction it was read."""
    spark.dataSource.register(BamSource)
    return spark.read.format("bam").option("splitBytes", split).load(path)
