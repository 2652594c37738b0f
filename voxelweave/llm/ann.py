"""Operator 2: approximate nearest neighbours by a hierarchical k-means tree.

The tree's upper part is fitted by spherical k-means on a bounded sample (`sample` vectors, the lowest by hash),
level after level, and is shared with every task. Every vector is indexed: it goes down to a leaf, and equal vectors
become one entry with their k + 1 smallest ids, each with its number of rows, which is all that a result of k, ties
to smaller ids, can name. Leaves with more than `crowded` entries get a lower part of their own, fitted in Spark on
a bounded sample of each such leaf (`sample` again), so the number of cells grows with the table: to about
(sample / 64)^2 at most. Lower parts are a table, joined by leaf, never shared whole.

A query walks the tree best bin first: a priority queue holds open branches by the cosine of query and centre,
and the leaf on top is visited next; within a crowded leaf it walks the lower part in the same way. How far to go is
calibrated on `trial` rows that are not queries: their exact neighbours among all rows are found by brute force (in
blocks), the places of the neighbours' leaves in each row's own best-bin-first order are looked up, and visits widen
until `recall` of the neighbours are reached (with lower parts, the root of it at either level). Visits are joined
with the index by cell in blocks of bounded size, so neither a crowded cell nor one that many queries visit becomes
one task. Scores are cosines in double precision of the original vectors. Candidates of all visits merge by a
partial top-k for each query.

Defined results: vectors that are null, zero or hold null or non-finite components take no part, as do those
whose length is not the commonest one (the shorter of equally common ones); a null id takes no part; a query has no
row for itself; equal scores go to the smaller id; fewer candidates than k give fewer rows; rows with equal ids,
repeated or not, are candidates of their own, except for a query of that id; of a query id's several vectors the
one whose bytes are smallest asks; an empty table gives no rows; extra columns are not read.
"""

from __future__ import annotations

import heapq
import pickle
from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from voxelweave.llm.common import table
from voxelweave.session import Scratch


@dataclass(frozen=True)
class Tree:
    """centres[node]; children[node] is the range of its children, empty at leaves. Node 0 is the root."""

    centres: np.ndarray
    first: np.ndarray
    last: np.ndarray

    @staticmethod
    def fit(vectors: np.ndarray, branch: int = 8, leaf: int = 64, depth: int = 4, rounds: int = 12, seed: int = 7) -> Tree:
        """Nodes split while they hold more than `leaf` sample vectors and are less than `depth` deep."""
        rng = np.random.default_rng(seed)
        unit = _units(vectors)
        centres, first, last = [unit.mean(0) if len(unit) else np.zeros(vectors.shape[1])], [0], [0]
        queue = [(0, np.arange(len(unit)), 0)]
        while queue:
            node, rows, level = queue.pop(0)
            if len(rows) <= leaf or level >= depth:
                continue
            own = unit[rows]
            seeds = own[rng.permutation(len(own))[:branch]]
            for _ in range(rounds):
                near = np.argmax(own @ seeds.T, 1)
                sums = np.zeros_like(seeds)
                np.add.at(sums, near, own)
                size = np.linalg.norm(sums, axis=1, keepdims=True)
                seeds = np.where(size > 1e-12, sums / np.maximum(size, 1e-12), seeds)
            near = np.argmax(own @ seeds.T, 1)
            used = np.unique(near)
            if len(used) < 2:
                continue
            first[node] = len(centres)
            for c in used:
                queue.append((len(centres), rows[near == c], level + 1))
                centres.append(seeds[c])
                first.append(0)
                last.append(0)
            last[node] = len(centres)
        return Tree(np.array(centres), np.array(first), np.array(last))

    def leaf_of(self, unit: np.ndarray) -> np.ndarray:
        at = np.zeros(len(unit), np.int64)
        while True:
            inner = self.last[at] > 0
            if not inner.any():
                return at
            for node in np.unique(at[inner]):
                rows = np.flatnonzero(at == node)
                a, b = self.first[node], self.last[node]
                at[rows] = a + np.argmax(unit[rows] @ self.centres[a:b].T, 1)

    def visits(self, query: np.ndarray, most: int) -> list[int]:
        """The first leaves in best-bin-first order: the open branch nearest to the query goes on."""
        near = self.centres @ query
        heap, out = [(-near[0], 0)], []
        while heap and len(out) < most:
            _, node = heapq.heappop(heap)
            a, b = self.first[node], self.last[node]
            if b == 0:
                out.append(int(node))
            for child in range(a, b):
                heapq.heappush(heap, (-near[child], child))
        return out

    @property
    def leaves(self) -> int:
        return int((self.last == 0).sum())


def _clean(vectors: list, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """The usable vectors in double precision, and which rows they are."""
    rows = [k for k, v in enumerate(vectors) if v is not None and len(v) == dim and None not in v]
    x = np.array([vectors[k] for k in rows], np.float64).reshape(-1, dim)
    good = np.isfinite(x).all(1) & (np.abs(x).max(1, initial=0) > 0)
    return x[good], np.array(rows, np.int64)[good]


def _scaled(vectors: np.ndarray) -> np.ndarray:
    """Vectors by a power of two, so that squares of their largest component neither overflow nor vanish; cosines keep every bit."""
    return np.ldexp(vectors, -np.frexp(np.abs(vectors).max(-1, keepdims=True))[1])


def cosine(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Row by row, in the same order of operations for every pair, whatever else is compared with it."""
    a, b = _scaled(a), _scaled(b)
    return (a * b).sum(-1) / (np.sqrt((a * a).sum(-1)) * np.sqrt((b * b).sum(-1)))


_INDEXED = T.StructType([T.StructField("leaf", T.LongType()), T.StructField("vector", T.BinaryType()), T.StructField("vec_id", T.LongType())])
_VISIT = T.StructType([T.StructField("leaf", T.LongType()), T.StructField("query_id", T.LongType()), T.StructField("vector", T.BinaryType())])
_HIT = T.StructType([T.StructField("query_id", T.LongType()), T.StructField("vec_id", T.LongType()), T.StructField("score", T.DoubleType())])
_FOUND = T.StructType([*_HIT.fields, T.StructField("leaf", T.LongType()), T.StructField("cell", T.LongType())])


def _units(vectors: np.ndarray) -> np.ndarray:
    vectors = _scaled(vectors)
    return vectors / np.linalg.norm(vectors, axis=1, keepdims=True)


def _read(column, dim: int) -> np.ndarray:
    return np.frombuffer(b"".join(column)).reshape(-1, dim)


def _index(source: Iterator[pa.RecordBatch], shared, dim: int) -> Iterator[pa.RecordBatch]:
    tree = shared.value
    for batch in source:
        x, rows = _clean(batch.column(1).to_pylist(), dim)
        yield pa.RecordBatch.from_arrays([pa.array(tree.leaf_of(_units(x))), pa.array([v.tobytes() for v in x], pa.binary()), batch.column(0).take(pa.array(rows))], names=_INDEXED.names)


def _visit(source: Iterator[pa.RecordBatch], shared, most: int) -> Iterator[pa.RecordBatch]:
    tree = shared.value
    for batch in source:
        leaf, which = [], []
        raw = batch.column(1).to_pylist()
        for k, b in enumerate(raw):
            q = np.frombuffer(b)
            got = tree.visits(q / np.linalg.norm(q), most)
            leaf += got
            which += [k] * len(got)
        yield pa.RecordBatch.from_arrays([pa.array(leaf, pa.int64()), batch.column(0).take(pa.array(which, pa.int64())), pa.array([raw[k] for k in which], pa.binary())], names=_VISIT.names)


# --- lower parts of crowded leaves -------------------------------------------------------------------------


def _fit_lower(dim: int):
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("vector")
        tree = Tree.fit(_read(rows["vector"], dim), leaf=64)
        return pd.DataFrame({"leaf": [rows["leaf"].iloc[0]], "tree": [pickle.dumps(tree)]})

    return run


def _down(dim: int):
    """The cell of each entry of a block of a crowded leaf."""

    def run(block: tuple, rows: pd.DataFrame, lower: pd.DataFrame) -> pd.DataFrame:
        if len(rows) and len(lower):
            rows = rows.assign(cell=pickle.loads(lower["tree"].iloc[0]).leaf_of(_units(_read(rows["vector"], dim))))
        return rows[["leaf", "cell", "vector", "ids"]]

    return run


def _open_cells(share: float, dim: int):
    """The first cells in best-bin-first order of each query of a block that visits a crowded leaf."""

    def run(block: tuple, rows: pd.DataFrame, lower: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(rows) and len(lower):
            tree = pickle.loads(lower["tree"].iloc[0])
            most = int(np.ceil(share * tree.leaves))
            for q, unit, raw in zip(rows["query_id"], _units(_read(rows["vector"], dim)), rows["vector"], strict=True):
                out += [(block[0], c, q, raw) for c in tree.visits(unit, most)]
        return pd.DataFrame(out, columns=["leaf", "cell", "query_id", "vector"]).astype({"leaf": "int64", "cell": "int64", "query_id": "int64"})

    return run


def _place_in_leaf(dim: int):
    """How far through its leaf's cells, in best-bin-first order, each neighbour's cell comes."""

    def run(block: tuple, rows: pd.DataFrame, lower: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(rows) and len(lower):
            tree = pickle.loads(lower["tree"].iloc[0])
            for unit, cell in zip(_units(_read(rows["vector"], dim)), rows["cell"], strict=True):
                out.append((tree.visits(unit, tree.leaves).index(cell) + 1) / tree.leaves)
        return pd.DataFrame({"share": np.array(out, float)})

    return run


def _in_blocks(rows: DataFrame, lower: DataFrame, by: str, size: int) -> tuple[DataFrame, DataFrame]:
    """rows of crowded leaves dealt into blocks of about `size`, and each leaf's lower part copied to its blocks."""
    blocks = rows.groupBy("leaf").agg(F.ceil(F.count("*") / size).cast("int").alias("blocks"))
    dealt = rows.join(blocks, "leaf").withColumn("block", F.pmod(F.xxhash64(by), F.col("blocks")).cast("int")).drop("blocks")
    copies = lower.join(blocks, "leaf").withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).drop("blocks")
    return dealt, copies


# --- search ------------------------------------------------------------------------------------------------


def _top(query_ids: np.ndarray, queries: np.ndarray, ids: list[list[tuple[int, int]]], vectors: np.ndarray, k: int) -> pd.DataFrame:
    """The k best (id, score) of each query among entries with several ids each, and several rows an id."""
    out = []
    unit = _units(vectors)
    for at in range(0, len(queries), 256):
        block = queries[at : at + 256]
        rough = _units(block) @ unit.T
        keep = min(k + 1, rough.shape[1])
        bar = np.partition(rough, -keep, axis=1)[:, -keep] - 1e-9  # rounding aside, whatever can be among the best
        for n, q in enumerate(block):
            near = np.flatnonzero(rough[n] >= bar[n])
            score = cosine(np.broadcast_to(q, (len(near), len(q))), vectors[near])
            rows = sorted((-s, i) for s, e in zip(score, near, strict=True) for i, times in ids[e] if i != query_ids[at + n] for _ in range(min(times, k)))[:k]
            out += [(query_ids[at + n], i, -s) for s, i in rows]
    return pd.DataFrame(out, columns=["query_id", "vec_id", "score"]).astype({"query_id": "int64", "vec_id": "int64", "score": "float64"})


def _search(k: int, dim: int):
    def run(block: tuple, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return pd.DataFrame({"query_id": np.array([], "int64"), "vec_id": np.array([], "int64"), "score": np.array([], "float64")})
        return _top(left["query_id"].to_numpy(), _read(left["vector"], dim), [[(e["id"], e["n"]) for e in x] for x in right["ids"]], _read(right["vector"], dim), k)

    return run


def _exact(source: Iterator[pa.RecordBatch], trial, k: int, dim: int) -> Iterator[pa.RecordBatch]:
    """The trial rows against this task's entries: the k best of each, with their leaves and cells."""
    ids, queries = trial.value
    best: list[list[tuple]] = [[] for _ in ids]
    for batch in source:
        if not batch.num_rows:
            continue
        leaf, cell, own = batch.column(0).to_numpy(), batch.column(1).to_numpy(), batch.column(3).to_pylist()
        score = queries @ _units(_read(batch.column(2).to_pylist(), dim)).T
        for n, q in enumerate(ids):
            near = np.argsort(-score[n])[: k + 1]
            best[n] = sorted(best[n] + [(-score[n, e], i["id"], leaf[e], cell[e]) for e in near for i in own[e] if i["id"] != q for _ in range(min(i["n"], k))])[:k]
    rows = [(q, i, -s, e, c) for q, b in zip(ids, best, strict=True) for s, i, e, c in b]
    if rows:
        yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(zip(*rows, strict=True), (pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.int64()), strict=True)], names=_FOUND.names)


def _entries(indexed: DataFrame, k: int) -> DataFrame:
    """(leaf, cell, vector, ids): one row a distinct vector; ids holds the k + 1 smallest ids and the rows of each."""
    keyed = indexed.withColumn("key", F.md5("vector"))
    window = Window.partitionBy("key").orderBy("vec_id")  # limited to k + 1 in every task before the shuffle
    few = keyed.groupBy("key", "vec_id").agg(F.count("*").alias("n")).withColumn("nth", F.row_number().over(window)).where(F.col("nth") <= k + 1)
    ids = few.groupBy("key").agg(F.sort_array(F.collect_list(F.struct(F.col("vec_id").alias("id"), F.col("n")))).alias("ids"))
    vectors = keyed.groupBy("key").agg(F.first("leaf").alias("leaf"), F.first("vector").alias("vector"))
    return vectors.join(ids, "key").select("leaf", F.lit(0).cast("long").alias("cell"), "vector", "ids")


def search(
    vectors: DataFrame, every: int, k: int = 5, recall: float = 0.97, sample: int = 20_000, trial: int = 300, block: int = 4000, crowded: int = 2000, vec_id: str = "vec_id", embedding: str = "embedding", seed: int = 7, told: dict | None = None
) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest found of every row whose id is divisible by `every`.

    told, if given, gets the numbers of leaves and of leaves visited, and the share of cells visited within crowded leaves.
    """
    spark = vectors.sparkSession
    context, scratch = spark.sparkContext, Scratch(spark, "ann")
    rows = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(embedding).alias("v")).where("vec_id is not null and v is not null")
    common = rows.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").first()
    dim = int(common["n"]) if common and common["n"] > 0 else 1
    order = F.xxhash64("vec_id", F.lit(seed))
    picked, _ = _clean([r["v"] for r in rows.where(F.size("v") == dim).orderBy(order, "vec_id").select("v").limit(sample).collect()], dim)  # at most `sample` vectors
    tree = Tree.fit(picked, leaf=max(8, min(64, len(picked) // 16)))
    shared = context.broadcast(tree)  # its nodes are bounded by the sample
    indexed = rows.mapInArrow(partial(_index, shared=shared, dim=dim), _INDEXED)
    entries = scratch.keep(_entries(indexed, k), "entries")

    full = entries.groupBy("leaf").agg(F.count("*").alias("n")).where(F.col("n") > crowded)
    lower = None
    if not full.isEmpty():
        some = entries.join(full, "leaf").where(F.pmod(F.xxhash64("vector"), F.lit(1 << 30)) * F.col("n") < F.lit(sample * (1 << 30)))  # about `sample` of each leaf
        lower = scratch.keep(some.select("leaf", "vector").groupBy("leaf").applyInPandas(_fit_lower(dim), "leaf long, tree binary"), "lower")
        dealt, copies = _in_blocks(entries.join(full.select("leaf"), "leaf"), lower, "vector", block)
        celled = dealt.groupBy("leaf", "block").cogroup(copies.groupBy("leaf", "block")).applyInPandas(_down(dim), entries.schema)
        entries = scratch.keep(entries.join(full.select("leaf"), "leaf", "left_anti").unionByName(celled), "celled")

    asks = F.col("vec_id") % every == 0
    queries = scratch.keep(indexed.where(asks).groupBy("vec_id").agg(F.min("vector").alias("vector")).toDF("query_id", "vector"), "queries")
    trials = indexed.where(~asks).groupBy("vec_id").agg(F.min("vector").alias("vector")).orderBy(order, "vec_id").limit(trial).collect()  # at most `trial` rows
    most, share = tree.leaves, 1.0
    if trials:
        ids, x = [r["vec_id"] for r in trials], np.array([np.frombuffer(r["vector"]) for r in trials])
        asked = context.broadcast((ids, _units(x)))
        found = entries.mapInArrow(partial(_exact, trial=asked, k=k, dim=dim), _FOUND)
        merged = found.groupBy("query_id").agg(F.slice(F.sort_array(F.collect_list(F.struct("score", "leaf", "cell")), False), 1, k).alias("best")).collect()  # k a task for each trial row
        reach = np.sqrt(recall) if lower is not None else recall
        quantile = lambda v: np.sort(v)[int(np.ceil(reach * len(v))) - 1]
        place, near = [], []
        for r in merged:
            row = ids.index(r["query_id"])
            at = {leaf: n for n, leaf in enumerate(tree.visits(_units(x[row : row + 1])[0], tree.leaves))}
            place += [at[b["leaf"]] + 1 for b in r["best"]]
            near += [(int(b["leaf"]), int(b["cell"]), x[row].tobytes()) for b in r["best"]]
        if place:
            most = int(quantile(place))
        if lower is not None and near:
            asked_cells = spark.createDataFrame(near, "leaf long, cell long, vector binary")  # k a trial row
            shares = [r["share"] for r in asked_cells.groupBy("leaf").cogroup(lower.groupBy("leaf")).applyInPandas(_place_in_leaf(dim), "share double").collect()]
            share = float(quantile(shares)) if shares else 1.0
    if told is not None:
        told |= {"leaves": tree.leaves, "visited": most, "share": share}

    visits = queries.mapInArrow(partial(_visit, shared=shared, most=most), _VISIT)
    if lower is None:
        visits = visits.withColumn("cell", F.lit(0).cast("long"))
    else:
        visits = scratch.keep(visits, "leaves")
        dealt, copies = _in_blocks(visits.join(full.select("leaf"), "leaf"), lower, "query_id", block)
        opened = dealt.groupBy("leaf", "block").cogroup(copies.groupBy("leaf", "block")).applyInPandas(_open_cells(share, dim), "leaf long, cell long, query_id long, vector binary")
        visits = visits.join(full.select("leaf"), "leaf", "left_anti").withColumn("cell", F.lit(0).cast("long")).unionByName(opened)
    visits = scratch.keep(visits, "visits")
    # blocks of entries within a cell, blocks of queries within a cell: every pair of blocks is one bounded group
    sizes = entries.groupBy("leaf", "cell").agg(F.ceil(F.count("*") / block).cast("int").alias("e"))
    asked_sizes = visits.groupBy("leaf", "cell").agg(F.ceil(F.count("*") / block).cast("int").alias("q"))
    shape = sizes.join(asked_sizes, ["leaf", "cell"])
    blocks = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    keys = ["leaf", "cell", "eb", "qb"]
    right = entries.join(shape, ["leaf", "cell"]).withColumn("eb", F.pmod(F.xxhash64("vector"), F.col("e")).cast("int")).withColumn("qb", blocks("q")).select(*keys, "vector", "ids")
    left = visits.join(shape, ["leaf", "cell"]).withColumn("qb", F.pmod(F.xxhash64("query_id"), F.col("q")).cast("int")).withColumn("eb", blocks("e")).select(*keys, "query_id", "vector")
    hits = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(_search(k, dim), _HIT)
    best = scratch.keep(hits.groupBy("query_id").agg(F.slice(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("far"), "vec_id"))), 1, k).alias("best")), "best")
    scratch.drop("entries", "celled", "lower", "queries", "leaves", "visits")
    return best.select("query_id", F.posexplode("best").alias("at", "b")).select("query_id", (F.col("at") + 1).cast("int").alias("rank"), F.col("b.vec_id").alias("vec_id"), (-F.col("b.far")).alias("score"))


def op2_ann(spark, sf_dir: str) -> DataFrame:
    """The 5 nearest of every embedding whose vec_id is divisible by 50."""
    return search(table(spark, sf_dir, "embeddings"), 50)
