"""Operator 11: a Merkle manifest of a dataset, with an inclusion proof for every row.

Every row is a leaf: the SHA-256 of its columns, each `-` if null, else its UTF-8 byte count, `:` and its value. Rows of
one tree (a source) ascend by id; every 16 consecutive nodes become one until one is left, the tree's subroot; subroots
in order of their trees (null first, then bytewise) become the root in the same way.

Method: aligned blocks of 16 ** HEIGHT nodes of a tree are traversed recursively in postorder, each in memory of one
bounded block: the visit of a subtree returns its digest, and while the recursion unwinds every leaf below gets the
siblings of that step appended. Block roots are the nodes of the next distributed traversal, up to one node a tree; the
subroots are then one tree of their own. Paths come back down in the same way: what a block root is given as its path is
appended to each leaf's path in the block. So no tree, however large a share of the rows it has, meets in one task.

Places come from prefix sums of counts of range partitions, one row a (partition, tree). Digests are made in the JVM,
and only digests are shuffled, never texts.

Defined results: null columns are hashed as `-`, empty texts as `0:`; rows with equal ids are ordered by their digest,
and repeated rows are leaves of their own; a tree of one row has its leaf as subroot, and a sole tree's subroot is the
root; null ids come first and are never tampered with; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import partial
from itertools import groupby

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from voxelweave.llm.common import quoted, table
from voxelweave.session import Scratch

FAN = 16  # nodes that become one
HEIGHT = 2  # levels of a block: 256 nodes
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")

_STEP = "array<struct<l:string,r:string>>"
_STEPS = pa.list_(pa.struct([("l", pa.string()), ("r", pa.string())]))
_NODE = "tree string, pos long, n long, digest string"
_PATH = f"tree string, pos long, path {_STEP}, subroot string, root string"


def digest(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


# --- leaves ------------------------------------------------------------------------------------------------


def leaf(columns: dict[str, Column]) -> Column:
    """The digest of a row's columns, in the order given."""

    def field(c: Column) -> Column:
        s = c.cast("string")
        return F.when(c.isNull(), "-").otherwise(F.concat(F.octet_length(s).cast("string"), F.lit(":"), s))

    return F.sha2(F.concat(*map(field, columns.values())).cast("binary"), 256)


def leaves(docs: DataFrame, tamper: Column | None = None, fields: tuple[str, ...] = FIELDS, tree: str = "source", order: str = "doc_id", text: str = "text") -> DataFrame:
    """(tree, id, leaf, tampered): tampered is the digest with the text's A-Z lower-cased where `tamper` holds, else null."""
    columns = {f: quoted(f) for f in fields}
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    changed = columns | {text: F.translate(quoted(text), upper, upper.lower())}
    named = F.coalesce(F.concat(F.lit("="), quoted(tree).cast("string")), F.lit(""))  # null sorts first
    return docs.select(named.alias("tree"), quoted(order).cast("long").alias("id"), leaf(columns).alias("leaf"), F.when(F.lit(False) if tamper is None else tamper, leaf(changed)).alias("tampered"))


# --- places ------------------------------------------------------------------------------------------------


def _count(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted rows with their partition and their place among the partition's rows of the same tree."""
    part, tree, at = TaskContext.get().partitionId(), None, 0
    for batch in source:
        places = []
        for t in batch.column(0).to_pylist():
            tree, at = (t, 0) if t != tree else (tree, at + 1)
            places.append(at)
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([part] * len(places), pa.int32()), pa.array(places, pa.int64())], names=[*batch.schema.names, "part", "place"])


def placed(nodes: DataFrame, order: list[str], scratch: Scratch, name: str) -> DataFrame:
    """nodes, whose first column is `tree`, with `pos` (from 0 in the tree) and `n` (nodes of the tree)."""
    width = int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    columns, keys = nodes.columns, ["tree", *order, "tie"]  # the tie is any order of equal rows, so that ranges split them
    ordered = nodes.withColumn("tie", F.monotonically_increasing_id()).repartitionByRange(width, *keys).sortWithinPartitions(*keys).drop("tie")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in nodes.schema)
    rows = scratch.keep(ordered.mapInArrow(_count, f"{schema}, part int, place long"), name)
    counts, tree = rows.groupBy("tree", "part").agg(F.count("*").alias("c")), Window.partitionBy("tree")
    before = F.coalesce(F.sum("c").over(tree.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    bases = scratch.keep(counts.select("tree", "part", before.alias("base"), F.sum("c").over(tree).alias("n")), f"{name}-bases")
    return rows.join(bases, ["tree", "part"]).select(*columns, (F.col("base") + F.col("place")).alias("pos"), "n")


# --- traversal of a block ----------------------------------------------------------------------------------


def visit(nodes: list[str], lo: int, hi: int, height: int, paths: list[list[tuple[str, str]]] | None) -> str:
    """The digest of the subtree of `height` over nodes lo to hi; paths, one a node, get its siblings on the way back."""
    if not height:
        return nodes[lo]
    width = FAN ** (height - 1)
    starts = range(lo, hi, width)
    children = [visit(nodes, a, min(a + width, hi), height - 1, paths) for a in starts]
    if paths is not None:
        for k, a in enumerate(starts):
            step = "".join(children[:k]), "".join(children[k + 1 :])
            for node in range(a, min(a + width, hi)):
                paths[node].append(step)
    return digest("".join(children))


def height_of(n: int) -> int:
    """Levels of a block of a tree of n nodes: HEIGHT, or as many as a small tree has."""
    height = 0
    while height < HEIGHT and FAN**height < n:
        height += 1
    return height


def _blocks(source: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple, list[tuple]]]:
    """Rows of each (tree, block), which follow each other: at most a block and its path at a time."""
    rows = (row for batch in source for row in zip(*(c.to_pylist() for c in batch.columns), strict=True))
    for key, own in groupby(rows, key=lambda r: r[:2]):
        yield key, list(own)


def _batched(rows: Iterator[tuple], names: list[str], kinds: list[pa.DataType], most: int = 512) -> Iterator[pa.RecordBatch]:
    held: list[tuple] = []
    for row in rows:
        held.append(row)
        if len(held) == most:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*held, strict=True), kinds, strict=True)], names=names)
            held = []
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*held, strict=True), kinds, strict=True)], names=names)


def _by_block(rows: DataFrame) -> DataFrame:
    width = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(width, "tree", "block").sortWithinPartitions("tree", "block", "pos")


def _block() -> Column:
    return F.floor(F.col("pos") / FAN**HEIGHT).cast("long").alias("block")


def _rise(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(tree, block, pos, n, digest) to one node a block."""

    def up() -> Iterator[tuple]:
        for (tree, block), rows in _blocks(source):
            n, nodes = rows[0][3], [r[4] for r in rows]
            yield tree, block, -(-n // FAN**HEIGHT), visit(nodes, 0, len(nodes), height_of(n), None)

    return _batched(up(), ["tree", "pos", "n", "digest"], [pa.string(), pa.int64(), pa.int64(), pa.string()])


def _fall(source: Iterator[pa.RecordBatch], finish) -> Iterator[tuple]:
    """Blocks of (tree, block, pos, n, digest, id, tampered, path, subroot, root), the block's own path first, to what `finish` makes of each node."""
    for _, (head, *rows) in _blocks(source):
        nodes, n = [r[4] for r in rows], rows[0][3]
        paths: list[list[tuple[str, str]]] = [[] for _ in rows]
        visit(nodes, 0, len(nodes), height_of(n), paths)
        above = [(s["l"], s["r"]) for s in head[7]]
        for row, path in zip(rows, paths, strict=True):
            yield finish(row, path + above, head[8], head[9])


def _inner(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    finish = lambda row, path, subroot, root: (row[0], row[2], [{"l": a, "r": b} for a, b in path], subroot, root)
    return _batched(_fall(source, finish), ["tree", "pos", "path", "subroot", "root"], [pa.string(), pa.int64(), _STEPS, pa.string(), pa.string()])


def folded(start: str, path: list[tuple[str, str]]) -> str:
    """The root that a leaf's digest and its siblings lead to."""
    for left, right in path:
        start = digest(left + start + right)
    return start


def _proofs(source: Iterator[pa.RecordBatch], whole: bool) -> Iterator[pa.RecordBatch]:
    def finish(row: tuple, path: list[tuple[str, str]], subroot: str, root: str) -> tuple:
        at = folded(row[6] or row[4], path)
        shown = [{"l": a, "r": b} for a, b in path] if whole else digest("".join(a + b for a, b in path))
        return row[5], row[4], subroot, root, shown, at, at == root

    return _batched(_fall(source, finish), ["doc_id", "leaf", "subroot", "root", "proof", "folded_root", "verified"], [pa.int64(), pa.string(), pa.string(), pa.string(), _STEPS if whole else pa.string(), pa.string(), pa.bool_()])


# --- the whole tree ----------------------------------------------------------------------------------------


class Manifest:
    """Digests of a dataset's trees, level by level, as tables in the shared folder."""

    def __init__(self, rows: DataFrame):
        """rows: (tree, id, leaf, tampered), as leaves() has them."""
        self.spark, self.scratch = rows.sparkSession, Scratch(rows.sparkSession, "merkle")
        own = self.scratch.keep(rows, "leaves")  # texts are read and hashed once
        self.leaves = placed(own, ["id", "leaf"], self.scratch, "placed").withColumnRenamed("leaf", "digest")
        self.rounds, finished = self._rise("tree", self.leaves.select("tree", "pos", "n", "digest"))
        self.subroots = self.scratch.keep(finished, "subroots")  # (tree, digest, round)
        top = placed(self.subroots.select(F.lit("").alias("tree"), F.col("tree").alias("name"), "digest", "round"), ["name"], self.scratch, "top")
        self.top = self.scratch.keep(top, "top-placed")
        self.top_rounds, self.root = self._rise("root", self.top.select("tree", "pos", "n", "digest"))

    def _rise(self, name: str, nodes: DataFrame) -> tuple[list[DataFrame], DataFrame]:
        """Each round's nodes, and (tree, digest, round) of those that are all of their tree."""
        rounds, finished = [nodes], None
        while True:
            k, now = len(rounds) - 1, rounds[-1]
            own = now.where("n = 1").select("tree", "digest", F.lit(k).alias("round"))
            finished = own if finished is None else finished.unionByName(own)
            more = now.where("n > 1")
            if more.isEmpty():
                return rounds, finished
            rounds.append(self.scratch.keep(_by_block(more.select("tree", _block(), "pos", "n", "digest")).mapInArrow(_rise, _NODE), f"{name}-{k + 1}"))

    def _blocks_with_paths(self, nodes: DataFrame, paths: DataFrame) -> DataFrame:
        """Nodes of each block behind the path of its root; paths: (tree, block, path, subroot, root)."""
        none = {"id": "long", "tampered": "string", "path": _STEP, "subroot": "string", "root": "string"}
        own = nodes.select("tree", _block(), "pos", "n", "digest", *(F.col(c) if c in nodes.columns else F.lit(None).cast(t).alias(c) for c, t in none.items()))
        empty = {"n": "long", "digest": "string", "id": "long", "tampered": "string"}
        heads = paths.select("tree", "block", F.lit(-1).cast("long").alias("pos"), *(F.lit(None).cast(t).alias(c) for c, t in empty.items()), "path", "subroot", "root")
        return _by_block(own.unionByName(heads))

    def _fall(self, name: str, rounds: list[DataFrame], ends: DataFrame) -> DataFrame | None:
        """Paths of the blocks of the first round; ends: (tree, round, path, subroot, root) of trees by the round that left one node."""
        start = lambda k: ends.where(F.col("round") == k).select("tree", F.lit(0).cast("long").alias("block"), "path", "subroot", "root")
        paths = start(len(rounds) - 1)
        for k in range(len(rounds) - 1, 0, -1):
            below = self.scratch.keep(self._blocks_with_paths(rounds[k], paths).mapInArrow(_inner, _PATH), f"{name}-paths-{k}")
            paths = below.withColumnRenamed("pos", "block").unionByName(start(k - 1))
        return paths

    def proofs(self, whole: bool = False) -> DataFrame:
        """A row a leaf: doc_id, leaf, subroot, root, proof (its digest; `whole`: siblings left and right of each level), folded_root, verified."""
        none = F.array().cast(_STEP)
        root = self.root.select("tree", "round", none.alias("path"), F.lit(None).cast("string").alias("subroot"), F.col("digest").alias("root"))
        over = self._fall("root", self.top_rounds, root)
        top = self.scratch.keep(self._blocks_with_paths(self.top.select("tree", "pos", "n", "digest"), over).mapInArrow(_inner, _PATH), "top-paths")
        ends = self.top.join(top.select("pos", "path", "root"), "pos").select(F.col("name").alias("tree"), "round", "path", F.col("digest").alias("subroot"), "root")
        paths = self._fall("tree", self.rounds, self.scratch.keep(ends, "ends"))
        schema = f"doc_id long, leaf string, subroot string, root string, proof {_STEP if whole else 'string'}, folded_root string, verified boolean"
        return self._blocks_with_paths(self.leaves, paths).mapInArrow(partial(_proofs, whole=whole), schema)


def op11_merkle(spark, sf_dir: str) -> DataFrame:
    """Every document's proof, untampered, and the root that its (in places tampered) leaf leads to."""
    docs = table(spark, sf_dir, "documents")
    tamper = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(False))
    return Manifest(leaves(docs, tamper)).proofs().withColumnRenamed("proof", "proof_sha256")


def crc_sql(bytes_list: str) -> str:
    """crc32 of a list of byte values, by the table of 256 in the one row of `crc`, which must be in FROM."""
    return f"xor(4294967295, list_reduce(list_prepend(4294967295, {bytes_list}), lambda c, b: xor(c >> 8, crc.t[1 + (xor(c, b) & 255)])))"


#: A one-row CTE with the table of the checksum's polynomial.
CRC_TABLE = "crc AS MATERIALIZED (SELECT list(list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY i) AS t FROM range(256) r(i))"


def oracle(levels: int = 6, tops: int = 4) -> str:
    """The same in DuckDB for sources of up to 16 ** levels rows and up to 16 ** tops sources."""
    part = lambda c: f"CASE WHEN {c} IS NULL THEN '-' ELSE octet_length(encode(CAST({c} AS VARCHAR))) || ':' || {c} END"
    head = " || ".join(part(c) for c in ("doc_id", "source", "lang", "n_chars"))
    low = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    crc = crc_sql("list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda x: CAST(ord(x) AS BIGINT))")
    ctes = [
        CRC_TABLE,
        f"d AS (SELECT doc_id, coalesce('=' || source, '') AS tree, sha256({head} || {part('text')}) AS leaf, sha256({head} || {part(low)}) AS low, coalesce({crc} % 5 = 0, false) AS tampered FROM documents, crc)",
        "t0 AS (SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY tree) AS n, leaf AS h, CASE WHEN tampered THEN low ELSE leaf END AS cur, '' AS proof FROM d)",
    ]
    side = lambda a: f"coalesce(string_agg(h, '') OVER (PARTITION BY tree, pos // 16 ORDER BY pos ROWS BETWEEN {a}), '')"

    def climb(k: int, of: str) -> None:
        ctes.append(f"n{k} AS (SELECT tree, pos, n, {side('UNBOUNDED PRECEDING AND 1 PRECEDING')} AS l, {side('1 FOLLOWING AND UNBOUNDED FOLLOWING')} AS r, h FROM (SELECT DISTINCT tree, pos, n, h FROM {of}))")
        up = "CASE WHEN n.n > 1 THEN sha256(n.l || {0} || n.r) ELSE {0} END"
        keep = "t.doc_id, t.leaf, t.subroot" if k >= levels else "t.doc_id, t.leaf"
        ctes.append(f"t{k + 1} AS (SELECT {keep}, t.tree, t.pos // 16 AS pos, (t.n + 15) // 16 AS n, {up.format('n.h')} AS h, {up.format('t.cur')} AS cur, t.proof || CASE WHEN n.n > 1 THEN n.l || n.r ELSE '' END AS proof FROM {of} t JOIN n{k} n ON t.tree = n.tree AND t.pos = n.pos)")

    for k in range(levels):
        climb(k, f"t{k}")
    ctes.append(f"u AS (SELECT doc_id, leaf, h AS subroot, '' AS tree, dense_rank() OVER (ORDER BY tree) - 1 AS pos, (SELECT count(DISTINCT tree) FROM d) AS n, h, cur, proof FROM t{levels})")
    for k in range(levels, levels + tops):
        climb(k, "u" if k == levels else f"t{k}")
    return f"WITH {', '.join(ctes)} SELECT doc_id, leaf, subroot, h AS root, sha256(proof) AS proof_sha256, cur AS folded_root, cur = h AS verified FROM t{levels + tops}"
