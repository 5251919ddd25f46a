"""Alignment files in many tasks against their FASTA form; splits that cut members, records over member borders."""

import random
import struct
import zlib

import pytest

from kmerloom.operators import filters
from kmerloom.sources import bam, formats


def member(data):
    raw = zlib.compressobj(6, zlib.DEFLATED, -15)
    body = raw.compress(data) + raw.flush()
    head = bam.MAGIC + b"\0" * 5 + b"\xff" + struct.pack("<H", 6) + b"BC" + struct.pack("<HH", 2, 18 + len(body) + 8 - 1)
    return head + body + struct.pack("<II", zlib.crc32(data), len(data))


def record(name, seq, flag=0, cigar=()):
    if flag & bam.REVERSED:
        seq = seq[::-1].translate(str.maketrans("ACGT", "TGCA"))
    code = [bam.LETTERS.index(c.encode()) for c in seq] + [0] * (len(seq) % 2)
    packed = bytes(a << 4 | b for a, b in zip(code[::2], code[1::2]))
    body = struct.pack("<iiBBHHHiiii", random.choice([-1, 0, 1]), random.randint(-1, 10**6), len(name) + 1, 60, 4680, len(cigar), flag, len(seq), -1, -1, 0)
    body += name.encode() + b"\0" + b"".join(struct.pack("<I", c) for c in cigar) + packed + bytes(random.randint(0, 40) for _ in seq) + b"NMC\1"
    return struct.pack("<i", len(body)) + body


def written(path, reads, block):
    """A file whose members hold `block` bytes each, whatever records they cut."""
    text = b"@HD\tVN:1.6\n@SQ\tSN:c1\tLN:1000000\n"
    head = b"BAM\1" + struct.pack("<i", len(text)) + text + struct.pack("<i", 2) + b"".join(struct.pack("<i", 3) + n + b"\0" + struct.pack("<i", 10**6) for n in (b"c1", b"c2"))
    data = head + b"".join(record(n, s, f, c) for n, s, f, c in reads)
    path.write_bytes(b"".join(member(data[i : i + block]) for i in range(0, len(data), block)) + member(b""))


def some_reads(seed, n, most=200):
    random.seed(seed)
    return [(f"r{i}/x", "".join(random.choice("ACGTN" if i % 9 == 0 else "ACGT") for _ in range(random.randint(0, most))), random.choice([0, 4, 16, 16 | 256]), [random.randint(0, 10**6) for _ in range(i % 3)]) for i in range(n)]


@pytest.mark.parametrize("block,split", [(700, 500), (700, 3000), (60_000, 20_000), (97, 1000), (3000, 1 << 30)])
def test_splits_give_every_record_once(spark, tmp_path, block, split):
    reads = {f"e{i}": some_reads(i, 300) for i in range(2)}
    for n, r in reads.items():
        written(tmp_path / f"{n}.bam", r, block)
    df = bam.read_bam(spark, f"{tmp_path}/*.bam", split)
    got = sorted((r.exp_id, r.read_id, r.seq) for r in df.collect())
    assert got == sorted((n, name, s) for n, rs in reads.items() for name, s, _, _ in rs)
    if split < 10_000:
        assert df.rdd.getNumPartitions() > 8


def test_counts_of_the_fasta_form(spark, tmp_path):
    reads = some_reads(5, 200)
    written(tmp_path / "e.bam", reads, 1500)
    (tmp_path / "e.fa").write_text("".join(f">{n}\n{s}\n" for n, s, _, _ in reads))
    a, b = (filters.kmer_counts(df, 15) for df in (bam.read_bam(spark, f"file://{tmp_path}/e.bam", 4000), formats.read_fasta(spark, str(tmp_path / "e.fa"))))
    assert sorted(a.collect()) == sorted(b.collect()) and a.count() > 1000


def test_long_records_and_no_records(spark, tmp_path):
    random.seed(2)
    long = "".join(random.choice("ACGT") for _ in range(90_000))
    written(tmp_path / "long.bam", [("a", "ACGT", 0, []), ("b", long, 16, [1]), ("c", "", 0, [])], 5000)
    assert sorted((r.read_id, r.seq) for r in bam.read_bam(spark, str(tmp_path / "long.bam"), 2000).collect()) == [("a", "ACGT"), ("b", long), ("c", "")]
    written(tmp_path / "none.bam", [], 5000)
    assert bam.read_bam(spark, str(tmp_path / "none.bam"), 50).count() == 0


def test_damage_is_an_error(spark, tmp_path):
    written(tmp_path / "d.bam", some_reads(3, 100), 700)
    raw = bytearray((tmp_path / "d.bam").read_bytes())
    (tmp_path / "d.bam").write_bytes(raw[: len(raw) // 2])
    with pytest.raises(Exception):
        bam.read_bam(spark, str(tmp_path / "d.bam")).collect()
