"""Operator 1: quality classifier by Bradley-Terry pairwise ranking.

Preference pairs (a document labelled 1 over one labelled 0) give the logistic loss of the difference of their
features; the weights that minimise it score any text. The cut is a quantile of the training scores, and scores are
mapped so that the cut lies at 0.7.

Only texts are inputs. The fit takes at most `max_labelled` labelled rows (the smallest by a hash of the key) and
`max_pairs` pairs; scoring covers every row. Null and empty texts have the features of an empty text. Repeated rows
repeat, ties in score stay ties. Without labels of both kinds every score is 0.7. Empty tables give no rows; extra
columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kmerloom.llm.common import BASE_A, bucket, mixed, prefix_sums, sliced, span_hash, table, utf8, word_spans

MAX_LABELLED, MAX_PAIRS, CUT = 20_000, 200_000, 0.7

FEATURES = (
    "log_words", "word_length", "upper", "digits", "symbols", "bangs", "bars", "other_marks", "lines",
    "one_sign_words", "same_as_last", "distinct_words", "repeated_triples", "marked_words", "upper_words", "sentence_ends",
)


def _flags(chars: str) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(chars.encode())] = True
    return out


_UPPER, _DIGIT, _LETTER = _flags("ABCDEFGHIJKLMNOPQRSTUVWXYZ"), _flags("0123456789"), _flags("abcdefghijklmnopqrstuvwxyz")
_LETTER = _LETTER | _UPPER
_LETTER[128:] = True
_SYMBOL, _BANG, _BAR = _flags("#*$%&<>@^~+=_\\{}[]"), _flags("!"), _flags("|")
_OTHER, _LINE, _STOP = _flags("\"'();:/?-"), _flags("\n"), _flags(".?!")


def _per_doc(values: np.ndarray, doc: np.ndarray, n: int) -> np.ndarray:
    return np.bincount(doc, weights=values, minlength=n)


def features(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """One row of FEATURES per text of the flat buffer."""
    n = len(offsets) - 1
    sizes = np.maximum(np.diff(offsets), 1)

    def share(flags: np.ndarray) -> np.ndarray:
        at = np.concatenate([[0], np.cumsum(flags[data])])
        return (at[offsets[1:]] - at[offsets[:-1]]) / sizes

    start, end, doc = word_spans(data, offsets)
    words = np.bincount(doc, minlength=n).astype(float)
    some = np.maximum(words, 1)
    h = span_hash(prefix_sums(data, BASE_A), start, end, BASE_A)
    last, first = data[end - 1], data[start]
    same = np.zeros(len(h))
    same[1:] = (h[1:] == h[:-1]) & (doc[1:] == doc[:-1])
    keyed = mixed(h ^ mixed(doc.astype(np.uint64)))
    distinct = np.bincount(doc[np.unique(keyed, return_index=True)[1]], minlength=n)
    triples = np.maximum(words - 2, 1)
    inner = doc[2:] == doc[:-2] if len(h) > 2 else np.zeros(0, bool)
    if inner.any():
        t = mixed(keyed[:-2] + mixed(keyed[1:-1] + mixed(keyed[2:])))[inner]
        kinds = np.bincount(doc[:-2][inner][np.unique(t, return_index=True)[1]], minlength=n)
    else:
        kinds = np.zeros(n)  # as for any text without a triple, whatever texts stand beside it
    upper = _UPPER[first] & (_UPPER[last] | (~_LETTER[last] & _UPPER[data[np.maximum(start, end - 3)]])) & (end - start > 1)
    return np.column_stack(
        [
            np.log1p(words),
            np.log1p(_per_doc((end - start).astype(float), doc, n) / some),
            share(_UPPER), share(_DIGIT), share(_SYMBOL), share(_BANG), share(_BAR), share(_OTHER), share(_LINE),
            _per_doc(((end - start == 1) & ~_LETTER[first]).astype(float), doc, n) / some,
            _per_doc(same, doc, n) / some,
            distinct / some,
            np.maximum(0, 1 - kinds / triples),
            _per_doc((_SYMBOL[last] | _BANG[last] | _BAR[last]).astype(float), doc, n) / some,
            _per_doc(upper.astype(float), doc, n) / some,
            _per_doc(_STOP[last].astype(float), doc, n) / some,
        ]
    )


@dataclass
class Ranking:
    """score = sigmoid((weights . z(features) - cut) / spread + logit(0.7))."""

    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    cut: float
    spread: float

    def raw(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.mean) / self.scale, -6, 6) @ self.weights

    def score(self, x: np.ndarray) -> np.ndarray:
        at = (self.raw(x) - self.cut) / self.spread + np.log(CUT / (1 - CUT))
        return 1 / (1 + np.exp(-np.clip(at, -40, 40)))


def fit(x: np.ndarray, y: np.ndarray, max_pairs: int = MAX_PAIRS, l2: float = 1e-3, seed: int = 5) -> Ranking:
    """Newton steps on the mean logistic loss of feature differences, then the score quantile that splits best."""
    d = len(FEATURES)
    good, bad = x[y == 1], x[y == 0]
    if not len(good) or not len(bad):
        return Ranking(np.zeros(d), np.ones(d), np.zeros(d), 0.0, 1.0)
    mean, scale = x.mean(0), x.std(0) + 1e-6
    z = lambda v: np.clip((v - mean) / scale, -6, 6)
    rng = np.random.default_rng(seed)
    n = min(max_pairs, len(good) * len(bad))
    diff = z(good)[rng.integers(len(good), size=n)] - z(bad)[rng.integers(len(bad), size=n)]
    w = np.zeros(d)
    for _ in range(25):
        p = 1 / (1 + np.exp(-np.clip(diff @ w, -40, 40)))
        gradient = diff.T @ (p - 1) / n + l2 * w
        hessian = (diff * (p * (1 - p))[:, None]).T @ diff / n + l2 * np.eye(d)
        step = np.linalg.solve(hessian, gradient)
        w -= step / max(1.0, np.abs(step).max() / 2)
        if np.abs(step).max() < 1e-6:
            break
    model = Ranking(mean, scale, w, 0.0, 1.0)
    s = model.raw(x)
    order = np.argsort(s, kind="stable")
    s, up = s[order], y[order]
    # right answers when everything from the k-th quantile on is called 1; the middle of the best stretch
    right = np.concatenate([[0], np.cumsum(up == 0)]) + np.concatenate([np.cumsum((up == 1)[::-1])[::-1], [0]])
    best = np.flatnonzero(right == right.max())
    k = int(best[len(best) // 2])
    model.cut = float(s[0] - 1e-6 if k == 0 else s[-1] + 1e-6 if k == len(s) else (s[k - 1] + s[k]) / 2)
    model.spread = float(max(s.std(), 1e-6)) / 2
    return model


def measured(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(key, features) for each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches, text):
            x = features(*utf8(b.column(1)))
            yield pa.record_batch([b.column(0), pa.array(list(x), pa.list_(pa.float64()))], [key, "features"])

    return docs.select(key, text).mapInArrow(run, f"{key} {docs.schema[key].dataType.simpleString()}, features array<double>")


def train(docs: DataFrame, labels: DataFrame, where: Column, key: str = "doc_id", text: str = "text", label: str = "quality", max_labelled: int = MAX_LABELLED) -> Ranking:
    """Fit on labelled rows that `where` admits: those of the max_labelled ids that hash least, and of their different
    texts the max_labelled that hash least. Labels of a key that disagree are averaged away."""
    own = labels.where(F.col(label).isNotNull() & F.col(key).isNotNull() & where).groupBy(key).agg(F.avg(label).alias("_y")).where("_y in (0, 1)")
    # at most max_labelled rows, so fit to broadcast
    own = own.orderBy(F.xxhash64(key), key).limit(max_labelled)
    digest = F.sha1(F.coalesce(F.col(text), F.lit("")).cast("binary"))
    picked = docs.select(key, text).join(F.broadcast(own), key).select(F.struct(key, "_y", digest.alias("_h")).alias("_k"), text)
    rows = measured(picked, "_k", text).dropDuplicates(["_k"]).orderBy("_k._h", "_k").limit(max_labelled).collect()
    rows.sort(key=lambda r: (str(r[0][0]), r[1]))
    return fit(np.array([r[1] for r in rows]).reshape(-1, len(FEATURES)), np.array([r[0][1] for r in rows]))


def scored(docs: DataFrame, model: Ranking, text: str = "text", out: str = "score") -> DataFrame:
    """Every row of docs, all columns kept, plus the score under the name `out`, which docs must not have."""
    if out in docs.columns:
        raise ValueError(f"docs has a column {out} already")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches, text):
            s = model.score(features(*utf8(b.column(b.schema.get_field_index(text)))))
            yield pa.record_batch([*b.columns, pa.array(s, pa.float64())], [*b.schema.names, out])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    return docs.mapInArrow(run, f"{fields}, `{out}` double")


def train_fold(key: str = "doc_id") -> Column:
    return bucket(F.col(key), 4) != 2


def op1_quality_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = train(docs, table(spark, sf_dir, "labels"), train_fold())
    return scored(docs, model).select("doc_id", F.coalesce(~train_fold(), F.lit(False)).alias("held_out"), "score", (F.col("score") >= CUT).cast("int").alias("predicted"))


#: A fitted model; tests hold it against held-out labels.
OP1_SQL = None
