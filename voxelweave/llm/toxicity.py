"""Operator 4: toxicity by non-negative positive-unlabelled learning.

Confirmed toxic documents are the positives, documents without regard to any label the unlabelled ones. A
document is the set of its lower-case words and of the words' character 4- and 5-grams, ends marked. Features
that positives hold clearly more often than the class-prior-corrected rest are kept, of those that three positives or
more hold the `keep` (3000) that tell most; a logistic model over them
minimises the non-negative risk

    prior * E_P[l(g)] + max(0, E_U[l(-g)] - prior * E_P[l(-g)])

by Adam in numpy. The logistic loss l is capped, so that a prior a little off can't outweigh all else; where the
second term falls below zero, its gradient is turned round. The prior is the share of
toxic rows among the rows that labels may be learned from. A model is fitted on at most `positives` and
`unlabelled` documents (the ids lowest by hash; of rows with one id the text lowest by hash), never on held-out
rows; every document is scored over its whole text, and nothing but the text enters a score.

Defined results: null and empty texts have no features and score by the bias alone; labels that are null or lack
a document count as none; with no positive example every document scores 0; repeated rows are scored alike;
extra columns are not read (or kept by `filter_toxic`, whatever their names); an empty table gives no rows.
"""

from __future__ import annotations

import re
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from voxelweave.llm.common import batches, held, held_out, quoted, table, texts_of, trim

WORD = re.compile(r"[^\W\d_]+")
#: Chosen by cross-validation within the rows that labels may be learned from (selection.py).
SURE = 12.0  # likelihood ratio statistic of a kept feature: chance passes it about once in two thousand
CAP = 14.0  # losses grow no further beyond this log-odds
STEPS = 600
LONGEST = 40  # longer words are not kept in the memo of features


def word_features(word: str) -> list[int]:
    """32-bit hashes of a word and of its 4- and 5-grams, ends marked."""
    crc = zlib.crc32
    marked = f"<{word}>"
    return [crc(word.encode("utf-8", "surrogatepass")), *(crc(marked[k : k + n].encode("utf-8", "surrogatepass"), n) for n in (4, 5) for k in range(len(marked) - n + 1))]


def nn_risk(gp: np.ndarray, gu: np.ndarray, prior: float, cap: float) -> tuple[float, np.ndarray, np.ndarray]:
    """The non-negative risk of log-odds of positives and unlabelled rows, and the step's direction at each of them.

    The direction is the gradient while the second term is positive; below zero it is that of minus the second term.
    """
    soft = lambda g: np.logaddexp(0, g)
    second = soft(np.minimum(gu, cap)).mean() - prior * soft(np.minimum(gp, cap)).mean()
    value = prior * soft(-gp).mean() + max(0.0, second)
    sp, su = (1 / (1 + np.exp(-np.clip(g, -40, 40))) for g in (gp, gu))
    sign, first = (-1.0, 0.0) if second < 0 else (1.0, 1.0)
    dp = (-prior * first * (1 - sp) - sign * prior * sp * (gp < cap)) / len(gp)
    return float(value), dp, sign * su * (gu < cap) / len(gu)


@dataclass(frozen=True)
class PULogistic:
    """weights of the kept features (sorted hashes) and the bias."""

    features: np.ndarray
    weights: np.ndarray
    bias: float

    @staticmethod
    def fit(positive: list[np.ndarray], unlabelled: list[np.ndarray], prior: float, keep: int = 3000, steps: int = STEPS, rate: float = 0.05, decay: float = 1e-3, sure: float = SURE, cap: float = CAP) -> PULogistic:
        """Rows are sorted distinct feature hashes of documents."""
        none = PULogistic(np.empty(0, np.uint32), np.empty(0), -50.0)
        if not positive or not unlabelled or prior <= 0:
            return none
        prior = min(prior, 0.99)
        features, scale = _tell_apart(positive, unlabelled, prior, keep, sure)
        if not len(features):
            return none

        def matrix(rows: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
            pairs = [(k, np.searchsorted(features, r[np.isin(r, features, assume_unique=True)])) for k, r in enumerate(rows)]
            return np.concatenate([np.full(len(c), k) for k, c in pairs]).astype(np.int64), np.concatenate([c for _, c in pairs]).astype(np.int64)

        (rp, cp), (ru, cu) = matrix(positive), matrix(unlabelled)
        held = np.bincount(rp, minlength=len(positive)).mean()  # features a positive holds: starts g at a moderate size
        w, b = np.full(len(features), 3 / max(held, 1) / scale.mean()), -2.0
        m, v, mb, vb = np.zeros(len(w)), np.zeros(len(w)), 0.0, 0.0
        for step in range(1, steps + 1):
            _, dp, du = nn_risk(np.bincount(rp, (w * scale)[cp], len(positive)) + b, np.bincount(ru, (w * scale)[cu], len(unlabelled)) + b, prior, cap)
            grad = (np.bincount(cp, dp[rp], len(w)) + np.bincount(cu, du[ru], len(w))) * scale + decay * w
            gb = dp.sum() + du.sum()
            m, v, mb, vb = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2, 0.9 * mb + 0.1 * gb, 0.999 * vb + 0.001 * gb**2
            fix1, fix2 = 1 - 0.9**step, 1 - 0.999**step
            w = w - rate * (m / fix1) / (np.sqrt(v / fix2) + 1e-8)
            b = b - rate * (mb / fix1) / (np.sqrt(vb / fix2) + 1e-8)
        return PULogistic(features, w * scale, float(b))


def _tell_apart(positive: list[np.ndarray], unlabelled: list[np.ndarray], prior: float, keep: int, sure: float) -> tuple[np.ndarray, np.ndarray]:
    """At most `keep` features that positives hold clearly more often than the other rows, and the log of how much more."""
    in_p, n_p = np.unique(np.concatenate(positive), return_counts=True)
    in_p, n_p = in_p[n_p >= 3], n_p[n_p >= 3]
    if not len(in_p):
        return in_p, np.empty(0)
    u = np.zeros(len(in_p))
    for row in unlabelled:
        at = np.minimum(np.searchsorted(in_p, row), len(in_p) - 1)
        u[at[in_p[at] == row]] += 1
    u /= len(unlabelled)
    p = n_p / len(positive)
    rest = np.maximum((u - prior * p) / (1 - prior), 0)  # how often the others hold it
    pseudo = 0.5 / len(positive)
    ratio = np.log((p + pseudo) / (rest + pseudo))
    smooth_p, smooth_r = (np.clip(x, pseudo, 1 - pseudo) for x in (p, rest))
    gain = 2 * len(positive) * (smooth_p * np.log(smooth_p / smooth_r) + (1 - smooth_p) * np.log((1 - smooth_p) / (1 - smooth_r)))
    good = np.flatnonzero((ratio > 1.5) & (gain > sure))
    good = good[np.argsort(-(p * ratio)[good], kind="stable")[:keep]]
    good = good[np.argsort(in_p[good])]
    return in_p[good], ratio[good]


class Scorer:
    """Scores texts; a word's kept features are looked up once, in a memo of bounded size."""

    def __init__(self, model: PULogistic, memo: int = 500_000):
        self.place = {int(f): k for k, f in enumerate(model.features)}
        self.model, self.memo, self.known = model, memo, {}

    def _hits(self, word: str) -> tuple[int, ...]:
        place = self.place
        return tuple(place[f] for f in word_features(word) if f in place)

    def scores(self, texts: list[str]) -> np.ndarray:
        known, weights, out = self.known, self.model.weights, np.empty(len(texts))
        if len(known) > self.memo:
            known.clear()
        for k, text in enumerate(texts):
            hits: set[int] = set()
            for word in set(WORD.findall(text.lower())):
                h = known.get(word)
                if h is None:
                    h = self._hits(word)
                    if len(word) <= LONGEST:
                        known[word] = h
                if h:
                    hits.update(h)
            g = self.model.bias + (float(weights[sorted(hits)].sum()) if hits else 0.0)
            out[k] = 1 / (1 + np.exp(-min(max(g, -40.0), 40.0)))
        return out


def _scorer(shared) -> Scorer:
    key, model = shared.value
    return held(("toxicity", key), lambda: Scorer(model))


_SAMPLE = T.StructType([T.StructField("positive", T.BooleanType()), T.StructField("features", T.BinaryType())])
_RESULT = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("held_out", T.BooleanType()), T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())])


def _extract(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    known: dict[str, np.ndarray] = {}
    for batch in batches(source, 256):
        out = []
        for text in texts_of(batch.column(1)):
            rows = []
            for word in set(WORD.findall(text.lower())):
                features = known.get(word)
                if features is None:
                    features = np.array(word_features(word), np.uint32)
                    if len(word) <= LONGEST:
                        known[word] = features
                rows.append(features)
            out.append(np.unique(np.concatenate(rows)).tobytes() if rows else b"")
        if len(known) > 200_000:
            known.clear()
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], names=_SAMPLE.names)


def fit_toxicity(docs: DataFrame, labels: DataFrame, positives: int = 2000, unlabelled: int = 6000, doc_id: str = "doc_id", text: str = "text", toxic: str = "toxic") -> PULogistic:
    """The model, from rows of docs and labels that are not held out; at most so many documents of each kind come to the driver."""
    free = labels.where(~held_out()).select(F.col("doc_id").cast("long").alias("id"), F.col(toxic).cast("int").alias("toxic"))
    counted = free.where(F.col("toxic").isNotNull()).agg(F.avg("toxic").alias("prior")).first()
    prior = counted["prior"] or 0.0
    rows = docs.where(~held_out(doc_id)).select(F.col(doc_id).cast("long").alias("id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    order = F.xxhash64("id")
    confirmed = free.where("toxic = 1").select("id").distinct().orderBy(order).limit(positives)
    picked = rows.select("id").distinct().orderBy(order).limit(unlabelled)
    chosen = confirmed.withColumn("p", F.lit(1)).join(picked.withColumn("u", F.lit(1)), "id", "full")
    sample = rows.join(F.broadcast(chosen), "id")  # at most positives + unlabelled ids
    sample = sample.groupBy("id", "p", "u").agg(F.min_by("text", F.xxhash64("text")).alias("text"))  # and as many rows, however often an id is there
    sample = sample.select(F.explode(F.array_compact(F.array(F.when(F.col("p") == 1, F.lit(True)), F.when(F.col("u") == 1, F.lit(False))))).alias("positive"), "text")
    found = sample.mapInArrow(_extract, _SAMPLE).toArrow()
    kind = found.column("positive").to_pylist()
    features = [np.frombuffer(v.as_buffer(), np.uint32) for v in found.column("features")]  # views, no copies
    order = sorted(range(len(features)), key=lambda k: (len(features[k]), zlib.crc32(features[k])))  # rows come in any order
    model = PULogistic.fit([features[k] for k in order if kind[k]], [features[k] for k in order if not kind[k]], float(prior))
    del found, features
    trim()
    return model


def _share(docs: DataFrame, model: PULogistic):
    return docs.sparkSession.sparkContext.broadcast((uuid.uuid4().hex, model))  # at most 3000 weights


def _score(source: Iterator[pa.RecordBatch], shared) -> Iterator[pa.RecordBatch]:
    for batch in batches(source):
        score = _scorer(shared).scores(texts_of(batch.column(2)))
        yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(score), pa.array((score >= 0.5).astype(np.int32))], names=_RESULT.names)


def score_toxicity(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", **fit: int) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row of docs."""
    shared = _share(docs, fit_toxicity(docs, labels, doc_id=doc_id, text=text, **fit))
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), held_out(doc_id).alias("held_out"), F.col(text).cast("string").alias("text"))
    return rows.mapInArrow(partial(_score, shared=shared), _RESULT)


def _filter(source: Iterator[pa.RecordBatch], shared, text: int) -> Iterator[pa.RecordBatch]:
    for batch in batches(source):
        yield batch.filter(pa.array(_scorer(shared).scores(texts_of(batch.column(text))) < 0.5))


def filter_toxic(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", **fit: int) -> DataFrame:
    """The rows of docs that are not predicted toxic, with all their columns."""
    shared = _share(docs, fit_toxicity(docs, labels, doc_id=doc_id, text=text, **fit))
    return docs.mapInArrow(partial(_filter, shared=shared, text=docs.columns.index(text)), docs.schema)


def op4_toxicity(spark, sf_dir: str) -> DataFrame:
    """All documents, scored by a model learned from the labels that are not held out."""
    return score_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
