"""Operator 3: language identification by bit-sliced Bloom filters over character n-grams.

Slice l of the filter holds the frequent n-grams of language l; slices share positions, so a position is one word of
bits and a look-up ANDs the words at an n-gram's positions: the result is the mask of all languages that hold it.
Per-language counts of those masks over a text, corrected for each slice's false-positive rate, decide.

The model is fitted on about `per_language` documents a language, picked by a hash of the key; every row is
predicted. Null texts and texts without a letter are `und` with score 0; a text with letters but no n-gram gets the
most frequent language. Very long texts are read whole, in slices of rows. Ties go to the first language in code-point
order. Repeated rows repeat; extra columns are not read; empty tables give no rows; with nothing to learn from, all is `und`.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from kmerloom.llm.common import bucket, checkpointed, mixed, sliced, table

N, HASHES = 3, 3
PER_LANGUAGE, PER_SLICE, BITS_PER_GRAM = 1500, 4000, 24

_LETTERS: list[np.ndarray] = []


def _letter_table() -> np.ndarray:
    if not _LETTERS:
        _LETTERS.append(np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000))
    return _LETTERS[0]


def grams(texts: list[str | None], n: int = N) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(n-gram hashes, their text's index, has a letter): windows of lower-cased letters with one border mark allowed at either end."""
    flat = "".join("\x00" + (t or "").replace("\x00", " ") for t in texts).lower() + "\x00"
    code = np.frombuffer(flat.encode("utf-32-le", "surrogatepass"), np.uint32)
    letter = _letter_table()[code]
    doc = np.cumsum(code == 0)[: len(code)] - 1
    has = np.bincount(doc[letter], minlength=len(texts))[: len(texts)] > 0
    c = np.where(letter, code, 0).astype(np.uint64)
    m = len(c) - n + 1
    if m <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), has
    ok = np.ones(m, bool)
    for i in range(1, n - 1):
        ok &= letter[i : m + i]
    h = np.zeros(m, np.uint64)
    for i in range(n):
        h = (h << np.uint64(21)) ^ (h >> np.uint64(43)) ^ c[i : m + i]
    at = np.flatnonzero(ok)
    return mixed(h[at]), doc[at + n // 2], has


def _slots(h: np.ndarray, m: int) -> list[np.ndarray]:
    step = (h >> np.uint64(32)) | np.uint64(1)
    return [((h + np.uint64(i) * step) & np.uint64(m - 1)).astype(np.int64) for i in range(HASHES)]


@dataclass
class MaskFilter:
    langs: list[str]
    words: np.ndarray  # (positions, ceil(languages / 64)) of bits
    false_rate: np.ndarray
    default: int

    def masks(self, h: np.ndarray) -> np.ndarray:
        """For each n-gram hash, the words of bits of all languages that hold it."""
        slots = _slots(h, len(self.words))
        out = self.words[slots[0]]
        for s in slots[1:]:
            out = out & self.words[s]
        return out

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        n = len(texts)
        if not self.langs:
            return ["und"] * n, np.zeros(n)
        h, doc, has = grams(texts)
        found = self.masks(h)
        total = np.bincount(doc, minlength=n)[:n].astype(float)
        hits = np.empty((n, len(self.langs)))
        for i in range(len(self.langs)):
            on = (found[:, i // 64] >> np.uint64(i % 64)) & np.uint64(1)
            hits[:, i] = np.bincount(doc, weights=on, minlength=n)[:n]
        true = np.maximum(0, (hits - total[:, None] * self.false_rate) / (1 - self.false_rate))
        best = np.where(true.max(1) > 0, true.argmax(1), self.default)
        sums = true.sum(1)
        score = np.where(sums > 0, true[np.arange(n), best] / np.maximum(sums, 1e-9), 0.0)
        return [self.langs[b] if ok else "und" for b, ok in zip(best, has)], np.where(has, score, 0.0)


def build(counts: dict[str, Counter], docs_by_lang: dict[str, int], per_slice: int = PER_SLICE, totals: dict[str, int] | None = None) -> MaskFilter:
    """counts: language -> n-gram hash -> occurrences. Each slice takes the most frequent n-grams of its language. totals:
    the occurrences of a language where counts leaves out n-grams that are in no language's slice."""
    totals = totals or {lang: sum(c.values()) for lang, c in counts.items()}
    langs = sorted(counts)
    kept = {}
    for lang in langs:
        top = sorted(counts[lang].items(), key=lambda x: (-x[1], x[0]))[:per_slice]
        total = totals[lang] or 1
        # an n-gram that other languages use several times as often says little for this one
        other = [(c, totals[x] or 1) for x, c in counts.items() if x != lang]
        kept[lang] = [g for g, k in top if k > 1 and all(k / total * 4 > c[g] / t for c, t in other)]
    m = 1 << max(10, (BITS_PER_GRAM * max([1, *map(len, kept.values())])).bit_length())
    words = np.zeros((m, max(1, -(-len(langs) // 64))), np.uint64)
    fill = np.zeros(len(langs))
    for i, lang in enumerate(langs):
        on = np.unique(np.concatenate(_slots(np.array(kept[lang], np.uint64), m)))
        words[on, i // 64] |= np.uint64(1 << (i % 64))
        fill[i] = (len(on) / m) ** HASHES
    default = max(range(len(langs)), key=lambda i: docs_by_lang[langs[i]]) if langs else 0
    return MaskFilter(langs, words, fill, default)


def train(docs: DataFrame, where: Column, key: str = "doc_id", text: str = "text", lang: str = "lang", per_language: int = PER_LANGUAGE) -> MaskFilter:
    """Counts of n-grams by language over the picked documents. The driver gets the most frequent ones of each language only."""
    own = docs.where(F.col(lang).isNotNull() & F.col(text).isNotNull() & where)
    # one row a language
    sizes = {r[0]: r[1] for r in own.groupBy(lang).count().collect()}
    if not sizes:
        return build({}, {})
    rate = F.create_map(*(x for k, n in sizes.items() for x in (F.lit(k), F.lit(min(1.0, per_language / n)))))
    picked = own.where(F.pmod(F.xxhash64(F.lit("sample"), key), F.lit(1_000_000)) < F.element_at(rate, F.col(lang)) * 1_000_000)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches, text):
            names, texts = np.array(b.column(0).to_pylist(), object), b.column(1).to_pylist()
            h, doc, _ = grams(texts)
            for name in sorted(set(names)):
                g, k = np.unique(h[(names == name)[doc]], return_counts=True)
                yield pa.record_batch([pa.array([name] * len(g), pa.string()), pa.array(g.view(np.int64)), pa.array(k, pa.int64())], ["lang", "gram", "n"])

    found = picked.select(lang, text).mapInArrow(count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n")).where("n > 1")
    found = checkpointed(found)
    totals = {k: 0 for k in sizes} | {r[0]: r[1] for r in found.groupBy("lang").agg(F.sum("n")).collect()}  # a row a language
    # what a slice needs: the most frequent n-grams of each language, per_slice at most, and their counts in the others
    order = W.partitionBy("lang").orderBy(F.col("n").desc(), F.col("gram").bitwiseXOR(F.lit(-(1 << 63))))
    top = found.withColumn("r", F.row_number().over(order)).where(F.col("r") <= PER_SLICE).select("gram").distinct()
    counts: dict[str, Counter] = {k: Counter() for k in sizes}
    for b in found.join(top, "gram", "left_semi").select("lang", "gram", "n").toArrow().to_batches():
        g = np.asarray(b.column(1)).view(np.uint64)
        for name, x, k in zip(b.column(0).to_pylist(), g.tolist(), b.column(2).to_pylist()):
            counts[name][x] = k
    return build(counts, sizes, PER_SLICE, totals)


def predicted(docs: DataFrame, model: MaskFilter, key: str = "doc_id", text: str = "text") -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches, text):
            lang, score = model.predict(b.column(1).to_pylist())
            yield pa.record_batch([b.column(0), pa.array(lang, pa.string()), pa.array(score, pa.float64())], [key, "lang_pred", "score"])

    return docs.select(key, text).mapInArrow(run, f"{key} {docs.schema[key].dataType.simpleString()}, lang_pred string, score double")


def op3_language_masks(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held = F.coalesce(bucket(F.col("doc_id"), 5) == 0, F.lit(False))
    model = train(docs, ~held)
    return predicted(docs, model).select("doc_id", held.alias("held_out"), "lang_pred", "score")


#: A fitted model; tests hold it against held-out languages.
OP3_SQL = None
