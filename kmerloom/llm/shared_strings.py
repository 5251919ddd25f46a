"""Operator 4: removal of byte strings that a document with a smaller id also holds, by bucket-pointer refinement.

Sorting every suffix of the corpus would ship each byte many times. Only suffixes at anchors travel:

1. Every 50-byte string contains an anchor, its smallest 20-byte gram by hash (leftmost of equals). The grams are the
   initial buckets. The strings that share an anchor occurrence form one stretch of text, which is shipped as the
   gram's hash, the stretch's hash and its place. Stretches met before within a task are settled there.
2. In each bucket, stretches equal to one of a smaller document are covered whole. Different stretches of one gram are
   refined by their buckets at later offsets: the 15 bytes after the gram, and the 15 before it, have bucket ids of 16
   bits, which travel with the stretch. Only where a pair (gram, later bucket) recurs in another document is that half of
   the stretch asked for; its bytes travel keyed by the 35-byte gram, and bucket ids of 8-byte grams are doubled by
   ranking pairs of bucket ids at later offsets, each round reusing the ids that the last one updated, until 50 bytes
   decide. Equal final ids are equal strings.
3. Covered ranges are gathered by document and cut out of its bytes.

What tasks send to each other are frames: the rows of one pair of tasks packed into one row.

Strings are judged on the input. Where whole stretches are equal, identity is that of 48 bits of the gram's and 48 bits
of the stretch's hash, compared apart; elsewhere bytes are compared. Rows of one id are told apart by a hash of their
text. A null text is empty; a null id neither loses bytes nor makes others lose any. Repeated rows and rows of one id
never cover each other and give one row each. Texts are taken whole, in UTF-8, whatever their length below 1 GiB (longer
ones raise an error); texts under 50 bytes are untouched. Empty tables give no rows; extra columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kmerloom.llm.common import BASE_A, BASE_B, Workspace, mixed, n_partitions, powers, prefix_sums, sliced, span_hash, table, utf8

LENGTH, GRAM = 50, 20
#: Anchors that a task gathers before it settles and ships them.
FLUSH = 2_000_000
_HALF = (LENGTH - GRAM) // 2


def stretches(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, ...]:
    """(text index, first string start, anchor, last string start, gram hash, stretch hash, hash of the bytes after the
    gram, of those before it); places are absolute."""
    n = len(data)
    none = (np.zeros(0, np.int64),) * 4 + (np.zeros(0, np.uint64),) * 4
    if n >= 1 << 30:
        raise ValueError("a text of 1 GiB or more")
    if n < LENGTH:
        return none
    doc = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    sums = prefix_sums(data, BASE_A)
    m = n - GRAM + 1
    gram = mixed((sums[GRAM:] - sums[:m]) * powers(BASE_A, n)[1][:m])
    # 34 bits of the hash over 30 bits of the place: the smallest is the leftmost of the smallest grams
    low = (gram >> np.uint64(30) << np.uint64(30)) | np.arange(m, dtype=np.uint64)
    width, w = 1, LENGTH - GRAM + 1
    while width < w:
        step = min(width, w - width)
        low = np.minimum(low[: len(low) - step], low[step:])
        width += step
    at = np.flatnonzero(doc[: n - LENGTH + 1] == doc[LENGTH - 1 :])
    if not len(at):
        return none
    anchor = (low[at] & np.uint64((1 << 30) - 1)).astype(np.int64)
    new = np.flatnonzero(np.concatenate([[True], (anchor[1:] != anchor[:-1]) | (at[1:] != at[:-1] + 1)]))
    first, last, anchor = at[new], at[np.append(new[1:], len(at)) - 1], anchor[new]
    whole = span_hash(prefix_sums(data, BASE_B), first, last + LENGTH, BASE_B) + (anchor - first).astype(np.uint64)
    after = span_hash(sums, anchor + GRAM, np.minimum(anchor + GRAM + _HALF, n), BASE_A)
    before = span_hash(sums, np.maximum(anchor - _HALF, 0), anchor, BASE_A)
    return doc[first], first, anchor, last, gram[anchor], mixed(whole), after, before


def _groups(*keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A sorting order of the keys and the starts of their groups in that order; a group agrees in every key."""
    order = np.lexsort(keys)
    if not len(order):
        return order, np.zeros(0, np.int64)
    new = np.ones(len(order), bool)
    new[1:] = np.logical_or.reduce([k[order][1:] != k[order][:-1] for k in keys])
    return order, np.flatnonzero(new)


def _least(keys: np.ndarray | tuple[np.ndarray, ...], values: np.ndarray, largest: bool = False) -> np.ndarray:
    """For each row the smallest (or largest) value in its group."""
    order, at = _groups(*(keys if isinstance(keys, tuple) else (keys,)))
    out = np.empty_like(values)
    if len(at):
        pick = (np.maximum if largest else np.minimum).reduceat(values[order], at)
        out[order] = np.repeat(pick, np.diff(np.append(at, len(order))))
    return out


_ROW = "bucket int, kind int, body binary"
#: kind of a frame: ranges to remove, stretches of a bucket, halves asked for
RANGES, STRETCHES, ASKS = 0, 1, 2
_SHIP = np.dtype([("gram", "<u8"), ("whole", "<u8"), ("after", "<u2"), ("before", "<u2"), ("doc", "<i8"), ("tag", "<i4"), ("first", "<i4"), ("off", "u1"), ("span", "u1")])
_RANGE = np.dtype([("doc", "<i8"), ("tag", "<i4"), ("start", "<i4"), ("end", "<i4")])
_ASK = np.dtype([("doc", "<i8"), ("tag", "<i4"), ("first", "<i4"), ("off", "u1"), ("span", "u1"), ("halves", "u1")])


#: columns that are packed row by row; the others have forms of their own
_LOCAL = ("after", "before", "first", "off", "span")


def _planes(v: np.ndarray) -> bytes:
    """The bytes of numbers by significance: the high ones are alike and compress away in the shuffle."""
    return np.ascontiguousarray(np.ascontiguousarray(v).view(np.uint8).reshape(len(v), -1).T).tobytes()


def _unplanes(raw: bytes, at: int, n: int, kind: np.dtype) -> tuple[np.ndarray, int]:
    size = kind.itemsize
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8, n * size, at).reshape(size, n).T).reshape(-1).view(kind), at + n * size


def _packed(x: np.ndarray) -> bytes:
    """Column by column, hashes cut to 48 bits; documents are told once for each run of rows."""
    cut = lambda v: np.ascontiguousarray(v).view(np.uint8).reshape(-1, 8)[:, 2:].tobytes()
    new = np.ones(len(x), bool)
    new[1:] = (x["doc"][1:] != x["doc"][:-1]) | (x["tag"][1:] != x["tag"][:-1])
    runs = x[new]
    head = np.array([len(x), len(runs)], "<u4").tobytes()
    return b"".join([head, cut(x["gram"]), cut(x["whole"]), np.packbits(new).tobytes(), *(_planes(runs[c]) for c in ("doc", "tag")), *(_planes(x[c]) for c in _LOCAL)])


def _unpacked(raw: bytes) -> np.ndarray:
    (n, k), at = np.frombuffer(raw, "<u4", 2).tolist(), 8
    out = np.zeros(n, _SHIP)
    for c in ("gram", "whole"):
        v = np.zeros((n, 8), np.uint8)
        v[:, 2:] = np.frombuffer(raw, np.uint8, 6 * n, at).reshape(-1, 6)
        out[c], at = v.reshape(-1).view("<u8"), at + 6 * n
    run = np.cumsum(np.unpackbits(np.frombuffer(raw, np.uint8, -(-n // 8), at), count=n)) - 1
    at += -(-n // 8)
    for c in ("doc", "tag"):
        v, at = _unplanes(raw, at, k, _SHIP[c])
        out[c] = v[run]
    for c in _LOCAL:
        out[c], at = _unplanes(raw, at, n, _SHIP[c])
    return out


def _batch(rows: list[tuple[int, int, bytes]]) -> pa.RecordBatch:
    cols = list(zip(*rows)) if rows else [()] * 3
    return pa.record_batch([pa.array(c, t) for c, t in zip(cols, (pa.int32(), pa.int32(), pa.binary()))], ["bucket", "kind", "body"])


def _frames(x: np.ndarray, bucket: np.ndarray, kind: int, pack) -> Iterator[pa.RecordBatch]:
    """Rows x as one frame a bucket."""
    order, at = _groups(bucket.astype(np.int32))
    for lo, hi in zip(at.tolist(), np.append(at[1:], len(x)).tolist()):
        yield _batch([(int(bucket[order[lo]]), kind, pack(x[order[lo:hi]]))])


def _by_doc(x: np.ndarray, kind: int, buckets: int) -> Iterator[pa.RecordBatch]:
    """Rows with doc and tag as frames by document."""
    yield from _frames(x, mixed(x["doc"].astype(np.uint64)) % np.uint64(buckets), kind, lambda part: part.tobytes())


def joined(x: np.ndarray) -> np.ndarray:
    """Ranges of many documents as maximal runs of each, in order of document and place."""
    if not len(x):
        return x
    x = x[np.lexsort((x["start"], x["tag"], x["doc"]))]
    new = np.ones(len(x), bool)
    new[1:] = (x["doc"][1:] != x["doc"][:-1]) | (x["tag"][1:] != x["tag"][:-1])
    # ends so far inside a document: each document's numbers lie above those of the one before
    base = (np.cumsum(new) - 1) << 32
    ends = np.maximum.accumulate(base + x["end"])
    new[1:] |= base[1:] + x["start"][1:] > ends[:-1]
    at = np.flatnonzero(new)
    out = x[at]
    out["end"] = (ends - base)[np.append(at[1:], len(x)) - 1]
    return out


def _ranges(doc, tag, start, end) -> np.ndarray:
    out = np.empty(len(doc), _RANGE)
    out["doc"], out["tag"], out["start"], out["end"] = doc, tag, start, end
    return joined(out)


def _whole(x: np.ndarray) -> np.ndarray:
    """The ranges of whole stretches."""
    return _ranges(x["doc"], x["tag"], x["first"], x["first"].astype(np.int64) + x["span"] + LENGTH)


def _send(buckets: int):
    def settle(parts: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        x = np.concatenate(parts)
        known = x["doc"] > _least((x["gram"], x["whole"]), x["doc"])
        yield from _by_doc(_whole(x[known]), RANGES, buckets)
        x = x[~known]
        yield from _frames(x, (x["gram"] >> np.uint64(20)) % np.uint64(buckets), STRETCHES, _packed)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cut = lambda h: h >> np.uint64(16) << np.uint64(16)
        parts, held = [], 0
        for batch in sliced(batches, "text"):
            data, offsets = utf8(batch.column(2))
            i, first, anchor, last, gram, whole, after, before = stretches(data, offsets)
            x = np.empty(len(i), _SHIP)
            x["gram"], x["whole"], x["doc"], x["tag"] = cut(gram), cut(whole), np.asarray(batch.column(0))[i], np.asarray(batch.column(1))[i]
            x["after"], x["before"] = after >> np.uint64(48), before >> np.uint64(48)
            x["first"], x["off"], x["span"] = first - offsets[i], anchor - first, last - first
            parts.append(x)
            held += len(x)
            if held >= FLUSH:
                yield from settle(parts)
                parts, held = [], 0
        if parts:
            yield from settle(parts)

    return run


def halves(first: np.ndarray, anchor: np.ndarray, last: np.ndarray) -> tuple[tuple[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]:
    """First and last start of the strings with the bytes after the gram, and of the others, which have those before it."""
    return (np.maximum(first, anchor - _HALF), last), (first, np.minimum(last, anchor - _HALF - 1))


def _meet(buckets: int):
    """All stretches of some buckets: ranges that are settled by equal stretches, and asks where halves may agree."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, ranges = [np.zeros(0, _SHIP)], [np.zeros(0, _RANGE)]
        for b in batches:
            for kind, body in zip(b.column(1).to_pylist(), b.column(2).to_pylist()):
                if kind == RANGES:
                    ranges.append(np.frombuffer(body, _RANGE))
                else:
                    parts.append(_unpacked(body))
        x = np.concatenate(parts)
        del parts
        x = x[_least(x["gram"], x["doc"]) != _least(x["gram"], x["doc"], True)]
        known = x["doc"] > _least((x["gram"], x["whole"]), x["doc"])
        yield from _by_doc(joined(np.concatenate([*ranges, _whole(x[known])])), RANGES, buckets)
        # other stretches of the same gram: of a smaller document they may cover, of a larger one be covered
        x = x[~known]
        first = x["first"].astype(np.int64)
        ask = np.zeros(len(x), _ASK)
        for c in ("doc", "tag", "first", "off", "span"):
            ask[c] = x[c]
        for bit, (name, (lo, hi)) in enumerate(zip(("after", "before"), halves(first, first + x["off"], first + x["span"]))):
            on = np.flatnonzero(lo <= hi)
            key, doc = (x["gram"][on], x[name][on]), x["doc"][on]
            ask["halves"][on[_least(key, doc) != _least(key, doc, True)]] |= 1 << bit
        yield from _by_doc(ask[ask["halves"] > 0], ASKS, buckets)

    return run


def _gathered(kind: np.dtype):
    """Frames of whole documents to rows (doc, tag, body), one a document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        x = np.concatenate([np.zeros(0, kind), *(np.frombuffer(r, kind) for b in batches for r in b.column(2).to_pylist())])
        x = joined(x) if kind == _RANGE else x[np.lexsort((x["first"], x["tag"], x["doc"]))]
        new = np.ones(len(x), bool)
        new[1:] = (x["doc"][1:] != x["doc"][:-1]) | (x["tag"][1:] != x["tag"][:-1])
        at = np.append(np.flatnonzero(new), len(x))
        for i in range(0, len(at) - 1, 4096):
            a = at[i : i + 4097]
            yield pa.record_batch([pa.array(x["doc"][a[:-1]]), pa.array(x["tag"][a[:-1]]), pa.array([x[p:q].tobytes() for p, q in zip(a.tolist(), a[1:].tolist())], pa.binary())], ["doc", "tag", "body"])

    return run


def _answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts of the asked halves, each keyed by the longer gram that its strings share."""
    for batch in sliced(batches, "text", 1 << 20):
        keys, docs, tags, starts, texts = [], [], [], [], []
        for doc, tag, text, asks in zip(*(batch.column(i).to_pylist() for i in range(4))):
            raw = text.encode()
            data = np.frombuffer(raw, np.uint8)
            a = np.unique(np.frombuffer(asks, _ASK))
            first = a["first"].astype(np.int64)
            anchor, sums = first + a["off"], prefix_sums(data, BASE_A)
            for bit, (lo, hi) in enumerate(halves(first, anchor, first + a["span"])):
                on = np.flatnonzero(a["halves"] >> bit & 1)
                if not len(on):
                    continue
                lo, hi, p = lo[on], hi[on], anchor[on]
                begin, end = (p - _HALF, p + GRAM) if bit else (p, p + GRAM + _HALF)
                keys.append(span_hash(sums, begin, end, BASE_A) ^ np.uint64(bit))
                docs += [doc] * len(on)
                tags += [tag] * len(on)
                starts += lo.tolist()
                texts += [raw[i:j] for i, j in zip(lo.tolist(), (hi + LENGTH).tolist())]
        k = np.concatenate(keys) if keys else np.zeros(0, np.uint64)
        yield pa.record_batch([pa.array(k.view(np.int64)), pa.array(docs, pa.int64()), pa.array(tags, pa.int32()), pa.array(starts, pa.int32()), pa.array(texts, pa.binary())], ["key", "doc", "tag", "start", "body"])


def refine(data: np.ndarray, at: np.ndarray, length: int = LENGTH) -> np.ndarray:
    """Bucket ids of the `length` bytes from each place in `at` (which must fit): equal ids are equal strings.

    Initial buckets hold equal 8-byte grams. Each round ranks the pairs (own bucket, bucket at the later offset), which
    doubles the depth; the updated ids are what the next round points at.
    """
    padded = np.concatenate([data, np.zeros(length, np.uint8)]).astype(np.uint64)
    n, depth = len(data), 8
    value = np.zeros(n, np.uint64)
    for i in range(8):
        value |= padded[i : n + i] << np.uint64(8 * i)
    ids = np.unique(value, return_inverse=True)[1].astype(np.uint64)
    while depth < length:
        step = min(depth, length - depth)
        final = depth + step >= length
        places = at if final else np.arange(n)
        later = np.concatenate([ids, np.zeros(step, np.uint64)])
        ids = np.unique(ids[places] << np.uint64(32) | later[places + step], return_inverse=True)[1].astype(np.uint64)
        depth += step
    return ids


#: Halves that are refined together; the halves of one key always are.
PIECE = 50_000


def _compare(buckets: int):
    """Rows come sorted by key: whole keys are taken in pieces, so that a task holds one piece or its largest key."""

    def settled(t: pa.Table) -> np.ndarray:
        key, doc = np.asarray(t["key"]).view(np.uint64), np.asarray(t["doc"])
        rows = np.flatnonzero(_least(key, doc) != _least(key, doc, True))
        if not len(rows):
            return np.zeros(0, _RANGE)
        body = t["body"].take(pa.array(rows)).to_pylist()
        sizes = np.array([len(x) for x in body])
        base = np.concatenate([[0], np.cumsum(sizes)[:-1]])
        n = sizes - LENGTH + 1
        row = np.repeat(np.arange(len(rows)), n)
        within = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        ids = refine(np.frombuffer(b"".join(body), np.uint8), base[row] + within)
        d = doc[rows][row]
        cover = np.flatnonzero(d > _least(ids, d))
        start = np.asarray(t["start"])[rows][row[cover]].astype(np.int64) + within[cover]
        return _ranges(d[cover], np.asarray(t["tag"])[rows][row[cover]], start, start + LENGTH)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, count, out = [], 0, [np.zeros(0, _RANGE)]
        for b in batches:
            if not len(b):
                continue
            held.append(b)
            count += len(b)
            if count >= PIECE:
                t = pa.Table.from_batches(held).combine_chunks()
                k = np.asarray(t["key"])
                end = int(np.flatnonzero(k == k[-1])[0])
                if end:
                    out.append(settled(t.slice(0, end)))
                    held, count = t.slice(end).combine_chunks().to_batches(), len(t) - end
        if held:
            out.append(settled(pa.Table.from_batches(held).combine_chunks()))
        yield from _by_doc(joined(np.concatenate(out)), RANGES, buckets)

    return run


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for text, body in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
            raw = (text or "").encode()
            r = np.frombuffer(body or b"", _RANGE)
            s, e = r["start"].astype(np.int64), r["end"].astype(np.int64)
            kept, at = hashlib.sha256(), 0
            for a, b in zip(s.tolist(), e.tolist()):
                kept.update(raw[at:a])
                at = b
            kept.update(raw[at:])
            out.append((len(raw), int((e - s).sum()), len(s), kept.hexdigest()))
        cols = list(zip(*out)) if out else [()] * 4
        yield pa.record_batch([batch.column(0), *(pa.array(c, pa.int64()) for c in cols[:3]), pa.array(cols[3], pa.string())], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])


def shared_ranges(docs: DataFrame, space: Workspace) -> DataFrame:
    """docs has (doc, tag, text); returns (doc, tag, body): the maximal byte ranges to remove, packed as _RANGE."""
    n = n_partitions(docs.sparkSession)
    known = docs.where("doc IS NOT NULL AND length(text) >= 13")  # 50 bytes take 13 code points at least
    dealt = lambda frames: frames.repartitionById(n, F.col("bucket"))
    met = space.stored(dealt(known.mapInArrow(_send(n), _ROW)).mapInArrow(_meet(n), _ROW))
    gathered = lambda frames, kind: dealt(frames).mapInArrow(_gathered(kind), "doc long, tag int, body binary")
    asks = gathered(met.where(F.col("kind") == ASKS), _ASK)
    texts = known.join(asks.hint("shuffle_hash"), ["doc", "tag"]).select("doc", "tag", "text", "body")
    asked = texts.mapInArrow(_answer, "key long, doc long, tag int, start int, body binary")
    refined = asked.repartition(n, "key").sortWithinPartitions("key").mapInArrow(_compare(n), _ROW)
    return gathered(met.where(F.col("kind") == RANGES).unionByName(space.stored(refined)), _RANGE)


def without_shared(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: doc_id, n_bytes, n_removed, n_spans and kept_sha256."""
    own = docs.select(F.col(key).cast("long").alias("doc"), F.hash(F.coalesce(text, F.lit(""))).alias("tag"), F.col(text).alias("text"))
    with Workspace(docs.sparkSession) as space:
        ranges = shared_ranges(own, space)
        both = own.join(ranges.hint("shuffle_hash"), ["doc", "tag"], "left").select("doc", "text", "body")
        return space.result(both.mapInArrow(_cut, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"))


def op4_shared_strings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return without_shared(table(spark, sf_dir, "documents"))


#: DuckDB: every 50-byte string as hex with its least document, and runs of the covered places.
OP4_SQL = """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
w AS (SELECT doc_id, i, substr(h, 2 * i + 1, 100) AS s FROM (SELECT doc_id, h, unnest(range(0, length(h) // 2 - 49)) AS i FROM d)),
m AS (SELECT s, min(doc_id) AS least FROM w GROUP BY 1),
f AS (SELECT doc_id, i, lag(i) OVER (PARTITION BY doc_id ORDER BY i) AS before FROM w JOIN m USING (s) WHERE least < doc_id),
g AS (SELECT doc_id, i, sum(CASE WHEN i <= before + 50 THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM f),
r AS (SELECT doc_id, min(i) AS a, max(i) + 50 AS b FROM g GROUP BY doc_id, run),
t AS (SELECT doc_id, sum(b - a) AS removed, count(*) AS spans FROM r GROUP BY 1),
k AS (SELECT doc_id, lag(b, 1, 0) OVER (PARTITION BY doc_id ORDER BY a) AS st, a AS en FROM r UNION ALL SELECT doc_id, max(b), 1000000000 FROM r GROUP BY 1),
kept AS (SELECT doc_id, string_agg(substr(h, 2 * st + 1, 2 * (en - st)), '' ORDER BY st) AS rest FROM k JOIN d USING (doc_id) GROUP BY 1)
SELECT doc_id, (length(h) // 2)::BIGINT AS n_bytes, coalesce(removed, 0)::BIGINT AS n_removed, coalesce(spans, 0)::BIGINT AS n_spans, sha256(unhex(coalesce(rest, h))) AS kept_sha256
FROM d LEFT JOIN t USING (doc_id) LEFT JOIN kept USING (doc_id)
"""
