"""Operator 1: document quality by hierarchical empirical Bayes.

A document classifier (logistic regression over binned text statistics, fitted on at most `sample` labelled
documents) gives each document a probability p of good quality. Sites borrow strength from above: with n
documents and sum of probabilities s, a host's posterior mean is (s + k m) / (n + k) around the global mean m,
and a path's is (s + k' h) / (n + k') around its host's h. The strengths k and k' come from all documents by the
method of moments (the less hosts differ beyond chance, the more a sparse one is shrunk). A document's own
evidence is left out of its site's sums, and the score is

    logit(score) = logit(path posterior) + logit(p) - logit(m).

Sums over hosts and paths are partial aggregates, so a host with a third of all rows is one more row; the join
back is on (host, path), broadcast only while Spark's threshold holds and else a skew-splitting sort-merge join.

Defined results: null and empty texts have all-zero statistics; null hosts and paths are a site of their own;
labels that are null or have no document are ignored, and with one class only every p is that class's smoothed
share; repeated rows count each (but once for the fit, with the text lowest by hash); equal scores are judged alike;
texts of any length are taken whole; an empty table gives no rows; extra columns are not read.
"""

from __future__ import annotations

import operator
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from voxelweave.llm.common import batches, held_out, table, texts_of, trim
from voxelweave.llm.quality_rules import repeated_words

FEATURES = ("words", "word_length", "distinct", "commonest", "stutter", "windows", "copied_lines", "upper", "digits", "marks", "symbols", "line_length")
_SYMBOLS = np.array([c in b"#*$%&|<>@^~_{}[]\\=+" for c in range(256)])
_MARKS = np.array([c in b".,;:!?\"'()-" for c in range(256)])


def statistics(text: str) -> list[float]:
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()
    n = len(words)
    if not n:
        return [0.0] * len(FEATURES)
    counts = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    size = len(raw)
    lines = [x for x in raw.split(b"\n") if x.strip()]
    letters = counts[65:91].sum() + counts[97:123].sum()
    tally = Counter(words)
    return [
        float(np.log1p(n)), sum(map(len, words)) / n, len(tally) / n, max(tally.values()) / n, sum(map(operator.eq, words, words[1:])) / n, repeated_words(words) / n,
        1 - len(set(lines)) / len(lines), counts[65:91].sum() / max(letters, 1), counts[48:58].sum() / size, counts[_MARKS].sum() / size, counts[_SYMBOLS].sum() / size, float(np.log1p(n / len(lines))),
    ]


@dataclass(frozen=True)
class BinnedLogistic:
    """edges[feature] cut its values into bins; weights[feature] has one weight a bin."""

    edges: tuple[np.ndarray, ...]
    weights: tuple[np.ndarray, ...]
    bias: float

    @staticmethod
    def fit(x: np.ndarray, y: np.ndarray, bins: int = 12, ridge: float = 1.0, rounds: int = 25) -> BinnedLogistic:
        """Newton's method with a ridge; x has a row of statistics a document, y is 0 or 1."""
        if not len(y) or y.min() == y.max():
            share = (y.sum() + 0.5) / (len(y) + 1)
            return BinnedLogistic((), (), float(np.log(share / (1 - share))))
        edges = tuple(np.unique(np.quantile(f, np.linspace(0, 1, bins + 1)[1:-1])) for f in x.T)
        columns = [np.searchsorted(e, f, "right") for e, f in zip(edges, x.T, strict=True)]
        starts = np.cumsum([1, *(len(e) + 1 for e in edges)])
        z = np.zeros((len(y), starts[-1]))
        z[:, 0] = 1
        for c, s in zip(columns, starts, strict=False):
            z[np.arange(len(y)), s + c] = 1
        w = np.zeros(z.shape[1])
        penalty = np.full(len(w), ridge)
        penalty[0] = 1e-3
        for _ in range(rounds):
            p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
            step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + np.diag(penalty), z.T @ (y - p) - penalty * w)
            w = w + step
            if np.abs(step).max() < 1e-6:
                break
        return BinnedLogistic(edges, tuple(w[a:b] for a, b in zip(starts[:-1], starts[1:], strict=True)), float(w[0]))

    def probability(self, x: np.ndarray) -> np.ndarray:
        g = np.full(len(x), self.bias)
        for k, (e, w) in enumerate(zip(self.edges, self.weights, strict=True)):
            g += w[np.searchsorted(e, x[:, k], "right")]
        return 1 / (1 + np.exp(-np.clip(g, -30, 30)))


_STATISTICS = T.StructType([T.StructField("label", T.IntegerType()), T.StructField("x", T.ArrayType(T.DoubleType(), False))])
_PROBABLE = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("host", T.StringType()), T.StructField("path", T.StringType()), T.StructField("held_out", T.BooleanType()), T.StructField("p", T.DoubleType())])


def _measure(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches(source):
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([statistics(t) for t in texts_of(batch.column(1))], pa.list_(pa.float64()))], names=_STATISTICS.names)


def _classify(source: Iterator[pa.RecordBatch], shared) -> Iterator[pa.RecordBatch]:
    for batch in batches(source):
        x = np.array([statistics(t) for t in texts_of(batch.column(4))]).reshape(-1, len(FEATURES))
        yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(shared.value.probability(x))], names=_PROBABLE.names)


def fit_classifier(docs: DataFrame, labels: DataFrame, sample: int = 20_000, doc_id: str = "doc_id", text: str = "text", quality: str = "quality") -> BinnedLogistic:
    """From at most `sample` labelled rows that are not held out, the lowest by hash of id."""
    known = labels.where(~held_out()).where(F.col(quality).isNotNull()).select(F.col("doc_id").cast("long").alias("id"), (F.col(quality).cast("int") > 0).cast("int").alias("label"))
    chosen = known.groupBy("id").agg(F.max("label").alias("label")).orderBy(F.xxhash64("id")).limit(sample)
    rows = docs.select(F.col(doc_id).cast("long").alias("id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text")).join(F.broadcast(chosen), "id")  # at most `sample` ids
    rows = rows.groupBy("id", "label").agg(F.min_by("text", F.xxhash64("text")).alias("text")).select("label", "text")  # and rows, however often an id is there
    found = rows.mapInArrow(_measure, _STATISTICS).toArrow()
    x = np.array(found.column("x").to_pylist()).reshape(-1, len(FEATURES))
    y = np.array(found.column("label").to_pylist(), float)
    order = np.lexsort((*x.T, y))  # rows come in any order
    model = BinnedLogistic.fit(x[order], y[order])
    del found, x, y
    trim()
    return model


def _strength(sites: DataFrame, mean: float) -> float:
    """Method of moments for Beta-distributed site means: how many documents the level above is worth."""
    m = sites.where("n > 1").agg(F.count("*").alias("k"), F.sum("n").alias("n"), F.sum(F.col("n") * F.pow(F.col("s") / F.col("n") - mean, 2)).alias("between"), F.sum(F.col("q") - F.col("s") * F.col("s") / F.col("n")).alias("within")).first()
    if not m["k"] or m["k"] < 2 or m["n"] <= m["k"]:
        return 20.0
    within = max(m["within"], 0.0) / (m["n"] - m["k"])
    tau = max((m["between"] - (m["k"] - 1) * within) / m["n"], 1e-9)  # variance between sites beyond chance
    return float(np.clip(within / tau, 1.0, 10_000.0))


def site_quality(docs: DataFrame, labels: DataFrame, host: str, path: str, doc_id: str = "doc_id", text: str = "text", threshold: float = 0.5, sample: int = 20_000) -> DataFrame:
    """(doc_id, host, path, p, host_posterior, path_posterior, score, held_out, kept) for each row of docs; host and path are SQL expressions over docs."""
    from voxelweave.session import materialize

    shared = docs.sparkSession.sparkContext.broadcast(fit_classifier(docs, labels, sample, doc_id, text))  # 12 short tables
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.expr(host).cast("string").alias("host"), F.expr(path).cast("string").alias("path"), held_out(doc_id).alias("held_out"), F.col(text).cast("string").alias("text"))
    scored = materialize(rows.mapInArrow(partial(_classify, shared=shared), _PROBABLE), "probable")
    paths = scored.groupBy("host", "path").agg(F.sum("p").alias("s"), F.sum(F.col("p") * F.col("p")).alias("q"), F.count("*").alias("n"))
    paths = materialize(paths, "paths")
    hosts = paths.groupBy("host").agg(F.sum("s").alias("s"), F.sum("q").alias("q"), F.sum("n").alias("n"))
    everything = hosts.agg(F.sum("s").alias("s"), F.sum("n").alias("n")).first()
    mean = float(np.clip(everything["s"] / everything["n"], 1e-4, 1 - 1e-4)) if everything["n"] else 0.5
    kh, kp = _strength(hosts, mean), _strength(paths, mean)
    up = hosts.select(F.col("host").alias("h"), F.col("s").alias("hs"), F.col("n").alias("hn"))
    sites = paths.join(up, F.col("host").eqNullSafe(F.col("h"))).select(F.col("host").alias("h"), F.col("path").alias("l"), "s", "n", "hs", "hn")
    joined = scored.join(sites, F.col("host").eqNullSafe(F.col("h")) & F.col("path").eqNullSafe(F.col("l")))
    logit = lambda c: F.log(c / (1 - c))
    inside = lambda c: F.greatest(F.lit(1e-6), F.least(F.lit(1 - 1e-6), c))
    host_posterior = (F.col("hs") - F.col("p") + kh * mean) / (F.col("hn") - 1 + kh)
    path_posterior = (F.col("s") - F.col("p") + kp * host_posterior) / (F.col("n") - 1 + kp)
    g = logit(inside(path_posterior)) + logit(inside(F.col("p"))) - logit(F.lit(mean))
    out = joined.select("doc_id", "host", "path", "p", host_posterior.alias("host_posterior"), path_posterior.alias("path_posterior"), (1 / (1 + F.exp(-g))).alias("score"), "held_out")
    return out.withColumn("kept", F.col("score") >= threshold)


def op1_site_quality(spark, sf_dir: str) -> DataFrame:
    """All documents, with their source as host and its languages as paths."""
    return site_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), "source", "concat_ws('/', source, lang)")
