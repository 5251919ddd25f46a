"""Operators 11, 12 and 13 against plain versions written here, over the awkward rows of the other operators' tests."""

import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from kmerloom.llm import alignment, importance, packing
from kmerloom.llm.encoders import ByteEncoder
from test_llm_operators import ROWS

TARGET = ["the quick brown fox", None, "", "one two words one", "日本語 Two WORDS", ROWS[0][1]]


def table_of(spark, rows, n=3):
    return spark.createDataFrame([(i, t, 1, 2, "x", "y") for i, t in rows], "doc_id long, text string, row long, pos int, word string, ids string").repartition(n)


PAIRS = [(r[0], r[1]) for r in ROWS]


# ---------------------------------------------------------------- 11


def plain_grams(text, orders):
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate({c: c + 32 for c in range(65, 91)}))
    return w, [" ".join(w[i : i + n]) for n in range(1, orders + 1) for i in range(len(w) - n + 1)]


def plain_resampled(docs, target, orders=1, buckets=10000, percent=10, least=20):
    cells = lambda g: [zlib.crc32(x.encode()) % buckets for x in g]
    s, t = collections.Counter(), collections.Counter()
    for _, x in docs:
        s.update(cells(plain_grams(x, orders)[1]))
    for x in target:
        t.update(cells(plain_grams(x, orders)[1]))
    S, T = sum(s.values()), sum(t.values())
    gain = {b: math.floor(1000 * math.log((t[b] + 1) * (S + buckets) / ((s[b] + 1) * (T + buckets)))) for b in s}
    out = []
    for i, x in docs:
        w, g = plain_grams(x, orders)
        weight = sum(gain[b] for b in cells(g)) // len(g) if g else 0
        h = int(hashlib.sha256(f"2024:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        out.append([i, len(w), len(g), weight, score, None])
    able = sorted((r for r in out if r[1] >= least), key=lambda r: (-r[4], r[0] is None, r[0] or 0))
    for n, r in enumerate(able[: percent * len(able) // 100], 1):
        r[5] = n
    return collections.Counter(map(tuple, out))


@pytest.mark.parametrize("orders,percent,parts", [(1, 10, 3), (2, 50, 1), (3, 100, 7)])
def test_op11(spark, orders, percent, parts):
    goal = spark.createDataFrame([(t, 5) for t in TARGET], "text string, doc_id int")
    got = importance.resampled(table_of(spark, PAIRS, parts), goal, orders=orders, percent=percent)
    assert collections.Counter(map(tuple, got.select("doc_id", "n_words", "n_features", "weight", "score", "rank").collect())) == plain_resampled(PAIRS, TARGET, orders, percent=percent)


def test_op11_stretches(spark):
    """Grams over the borders of stretches are counted once; shorter texts than an order have those that fit."""
    texts = ["a", "a b", "a b c", " ".join(f"w{i % 7}" for i in range(50)), "", None]
    rows = spark.createDataFrame(list(enumerate(texts)), "row long, text string")
    for stretch in (4, 5, 1000):
        got = importance.grams(importance.position_table(rows), 3, stretch).collect()
        want = [(i, g) for i, t in enumerate(texts) for g in plain_grams(t, 3)[1]]
        assert collections.Counter((r.row, r.gram) for r in got if r.gram is not None) == collections.Counter(want)
        assert sorted(r.row for r in got if r.gram is None) == [4, 5]


def test_op11_copies_of_one_id_rank_apart(spark):
    """A third of all rows are copies of one row: they are dealt over partitions and take the ranks that follow."""
    text = " ".join(f"w{i}" for i in range(30))
    docs = [(7, text)] * 200 + [(100 + i, f"{text} x{i}") for i in range(400)]
    got = importance.resampled(table_of(spark, docs), spark.createDataFrame([(text,)], "text string"), percent=50).collect()
    ranks = sorted(r["rank"] for r in got if r["rank"])
    assert ranks == list(range(1, 301))
    assert collections.Counter((r.doc_id, r.weight, r.score, r["rank"]) for r in got) == collections.Counter((i, w, s, k) for i, _, _, w, s, k in plain_resampled(docs, [text], percent=50).elements())


def test_op11_gumbel_draw_prefers_the_target(spark):
    random.seed(3)
    near, far = [f"n{i}" for i in range(40)], [f"f{i}" for i in range(400)]
    docs = [(i, " ".join(random.choice(near if i % 10 == 0 else far) for _ in range(40))) for i in range(600)]
    got = importance.resampled(table_of(spark, docs), spark.createDataFrame([(" ".join(near),)] * 5, "text string")).where("rank is not null").collect()
    assert len(got) == 60 and sum(r.doc_id % 10 == 0 for r in got) > 15


# ---------------------------------------------------------------- 12


def plain_ids(text):
    tk = plain_ids.__dict__.setdefault("tk", Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")))
    return tk.encode(text or "", add_special_tokens=False).ids + [0]


def best_fit_decreasing(lengths, capacity):
    """Number of sequences, piece by piece."""
    rooms = []
    for n in sorted(lengths, reverse=True):
        fits = [r for r in rooms if r >= n]
        room = min(fits) if fits else capacity
        if fits:
            rooms.remove(room)
        rooms.append(room - n)
    return len(rooms)


def checked_packing(rows, docs, capacity):
    by_doc, by_seq = collections.defaultdict(list), collections.defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
        by_seq[r.sequence_id].append(r)
    for i, texts in docs.items():
        want = collections.Counter()
        for t in texts:
            ids = plain_ids(t)
            head = len(ids) - (-(-len(ids) // capacity) - 1) * capacity
            for p, a in enumerate([0, *range(head, len(ids), capacity)]):
                part = ids[a : head if p == 0 else a + capacity]
                want[p, a, len(part), zlib.crc32(np.array(part, "<u4").tobytes())] += 1
        assert collections.Counter((r.piece, r.start, r.length, r.ids_crc32) for r in by_doc.pop(i)) == want
    assert not by_doc
    for s in by_seq.values():
        at = 0
        for r in sorted(s, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= capacity
    assert len(by_seq) == best_fit_decreasing([r.length for r in rows], capacity)


@pytest.mark.parametrize("capacity,parts", [(2048, 3), (64, 5), (7, 1), (1, 2)])
def test_op12(spark, capacity, parts):
    pairs = PAIRS if capacity > 7 else [(i, (t or "")[:200] if t else t) for i, t in PAIRS[:40]]
    docs = collections.defaultdict(list)
    for i, t in [*pairs, (9001, "a<|endoftext|>b"), (9002, " " * 11000 + "x")]:
        docs[i].append(t)
    rows = packing.packed_documents(table_of(spark, [(i, t) for i, ts in docs.items() for t in ts], parts), capacity=capacity).collect()
    checked_packing(rows, docs, capacity)


def test_op12_plan_is_best_fit_decreasing():
    random.seed(8)
    for _ in range(300):
        capacity = random.randint(1, 60)
        lengths = [random.randint(1, capacity) for _ in range(random.randint(0, 80))]
        if lengths and random.random() < 0.5:
            lengths += [lengths[0]] * 200
        runs, used = packing.plan(collections.Counter(lengths), capacity)
        assert used == best_fit_decreasing(lengths, capacity)
        held, at = collections.defaultdict(list), 0
        place = sorted(lengths, reverse=True)
        for g, n in enumerate(place):
            start, each, first, offset, length = runs[np.searchsorted(runs[:, 0], g, side="right") - 1].tolist()
            assert length == n
            held[first + (g - start) // each].append((offset + (g - start) % each * n, n))
        for s in held.values():
            at = 0
            for o, n in sorted(s):
                assert o == at
                at += n
            assert at <= capacity
        assert sorted(held) == list(range(used))


def test_op12_plan_does_not_grow_with_the_corpus():
    random.seed(9)
    shape = collections.Counter({n: random.randint(1, 50) for n in range(1, 2049)})
    small, _ = packing.plan(shape)
    large, _ = packing.plan(collections.Counter({n: c * 10**6 + 3 for n, c in shape.items()}))
    assert len(large) < 8 * 2048 and len(small) < 8 * 2048


def test_op12_sequences_hold_the_ids(spark):
    docs = table_of(spark, PAIRS)
    placed = packing.packed_documents(docs, capacity=256, ids=True)
    joined = {r.sequence_id: np.frombuffer(bytes(r.ids), "<u4").tolist() for r in packing.sequences(placed).collect()}
    every = collections.Counter()
    for r in placed.collect():
        own = np.frombuffer(bytes(r.ids), "<u4").tolist()
        assert joined[r.sequence_id][r.offset : r.offset + r.length] == own
        every.update(own)
    assert sum(map(len, joined.values())) == sum(every.values()) == sum(len(plain_ids(t)) for _, t in PAIRS)


def test_byte_encoder_agrees_with_the_library():
    random.seed(10)
    slow = {plain: Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")) for plain in (False, True)}
    slow[True].encode_special_tokens = True
    fast = {plain: ByteEncoder(plain=plain) for plain in (False, True)}
    alphabet = [*"aab'sStTdrevl  \n\t\r129.,!", "<|endoftext|>", "é", " ", "　", "日", "́", "👍🏽", "\x85", "\x1c", "▁", "\x00", " '", "it's"]
    texts = ["".join(random.choices(alphabet, k=random.randint(0, 40))) for _ in range(4000)] + [" " * 30000, "\n" * 20000 + "x", "a" * 30000, *(t for _, t in PAIRS if t)]
    for plain in (False, True):
        for t in texts:
            assert fast[plain](t).tolist() == slow[plain].encode(t, add_special_tokens=False).ids
    assert b"".join(fast[True].token_bytes()[i] for i in fast[True]("naïve 日本 x")) == "naïve 日本 x".encode()


# ---------------------------------------------------------------- 13


def plain_alignment(rows):
    tk = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    tk.encode_special_tokens = True
    sp = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    # the printable stand-ins of bytes in a byte-level vocabulary
    shown = [b for b in range(256) if chr(b).isprintable() and chr(b) != " " and b != 0xAD and not 0x7F <= b <= 0xA0]
    letter = {chr(b): b for b in shown} | {chr(256 + n): b for n, b in enumerate(b for b in range(256) if b not in shown)}
    found, pairs = [], collections.Counter()
    for i, t in rows:
        a, b = (tk.encode(" " + t, add_special_tokens=False).ids, sp.encode(t)) if t else ([], [])
        a_raw = [bytes(letter[c] for c in tk.id_to_token(x)) for x in a]
        b_raw = [bytes([int(p[3:5], 16)]) if sp.is_byte(x) else p.replace("▁", " ").encode() for x in b for p in [sp.id_to_piece(x)]]
        if not t or not b"".join(a_raw) == b"".join(b_raw) == b" " + t.encode():
            found.append((i, None))
            continue
        span = lambda raw: [(sum(map(len, raw[:n])), sum(map(len, raw[: n + 1]))) for n in range(len(raw))] if len(raw) < 200 else list(zip(np.cumsum([0, *map(len, raw)])[:-1].tolist(), np.cumsum([*map(len, raw)]).tolist()))
        sa, sb = span(a_raw), span(b_raw)
        links = []
        low = 0
        for x, (p, q) in enumerate(sa):
            while sb[low][1] <= p:
                low += 1
            y = low
            while y < len(sb) and sb[y][0] < q:
                links.append((a[x], b[y]))
                y += 1
        pairs.update(links)
        groups, x, y = [], 0, 0
        for e in sorted({q for _, q in sa} & {q for _, q in sb}):
            ga, gb = [], []
            while x < len(sa) and sa[x][1] <= e:
                ga.append(a[x])
                x += 1
            while y < len(sb) and sb[y][1] <= e:
                gb.append(b[y])
                y += 1
            groups.append(f"{','.join(map(str, ga))}|{','.join(map(str, gb))}")
        found.append((i, (len(a), len(b), links, groups)))
    most = collections.defaultdict(int)
    for (_, b), n in pairs.items():
        most[b] = max(most[b], n)
    out = []
    for i, f in found:
        if f is None:
            out.append((i, 0, 0, 0, 0, 0, 0, ""))
            continue
        n_a, n_b, links, groups = f
        out.append((i, n_a, n_b, len(groups), len(links), sum(pairs[p] == most[p[1]] for p in links), sum(pairs[p] for p in links), hashlib.sha256(";".join(groups).encode()).hexdigest()))
    return collections.Counter(out)


ODD = ["a▁b", " ", "  two", "tab\tnew\nline ", "<|endoftext|> here", "\x00null", "é" * 50, "日本語のテキスト", "👍🏽 ok", "ｆｕｌｌ ﬁ", "don't can't", "<0x41>", "́x", "x" * 3000, "<s> </s> <unk>", "\r\n"]


@pytest.mark.parametrize("links,parts", [(8 << 20, 3), (200, 4), (1, 1)])
def test_op13(spark, links, parts):
    rows = [*PAIRS, *((5000 + i, t) for i, t in enumerate(ODD))]
    got = alignment.aligned(table_of(spark, rows, parts), links=links).select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256").collect()
    assert collections.Counter(map(tuple, got)) == plain_alignment(rows)


def test_op13_links_by_definition():
    """align() on random cuts of one byte range: every pair of overlapping tokens once, groups where both end."""
    random.seed(5)
    sizes = np.arange(10)
    for _ in range(300):
        n = random.randint(1, 30)
        sides = []
        for _ in range(2):
            ids, left = [], n
            while left:
                ids.append(random.randint(1, min(9, left)))
                left -= ids[-1]
            sides.append(np.array(ids))
        ga, gb, la, lb, _ = alignment.align(*sides, sizes, sizes)
        ends = [np.cumsum(s) for s in sides]
        starts = [e - s for e, s in zip(ends, sides)]
        want = [(i, j) for i in range(len(sides[0])) for j in range(len(sides[1])) if starts[0][i] < ends[1][j] and starts[1][j] < ends[0][i]]
        assert list(zip(la.tolist(), lb.tolist())) == want
        both = sorted(set(ends[0].tolist()) & set(ends[1].tolist()))
        assert [ga.tolist(), gb.tolist()] == [[sum(b < e for b in both) for e in side.tolist()] for side in ends]
