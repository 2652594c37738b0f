"""Operator 10: near-duplicates by DartMinHash signatures, banded joining and exact verification.

A text's elements are its distinct windows of five words (of all its words, if fewer), each with its number of
occurrences as weight (or, with weighted=False, with weight 1). Texts are linked if their weighted Jaccard
similarity, the sum of the lesser weights over that of the greater ones, is at least 0.8, and classes are the
connected components of these links.

1. Equal texts are one node from the start: copies cost one partial aggregate.
2. A node's dart signature gives 25 bands of 5 coordinates; nodes that share a band meet in its bucket.
3. Each bucket's most widely met node (that whose buckets are largest, so the centre of a group of variants)
   is compared with all others of the bucket: one candidate pair a member. The similarity of candidates whose
   signatures allow it is computed exactly on the full sets, and components of the links are taken.
4. Buckets that still hold several components are looked at again. Members outside the bucket's largest component
   meet all members in blocks of bounded size (BLOCK members and BYTES of text a side, or one longer text), so a
   bucket of n members, m of them outside, is copied m n / BLOCK times at most, and just once while m is below BLOCK (where
   texts are long, BYTES of text stand for BLOCK members). Of a block, pairs of different components that share no
   earlier bucket are compared exactly, likeliest first, and components that link are merged at once, so that no
   pair within a component is compared and no pair is emitted but a link. This holds for buckets of any size.

A pair of similarity 0.8 shares a bucket with a probability of over 0.9999, and one of 0.85 over 0.999999. Candidates
whose signatures agree on too few coordinates (LIKELY) aren't compared: a pair of similarity 0.8 is lost so once in
about 115 000. There is no other cap. Tables written on the way are deleted as soon as later ones hold what they said.

Defined results: null and empty texts are one class of copies; shorter texts than five words have one element; a
text of any length is taken whole; rows with equal ids or texts are rows of their own in the result; an empty table
gives none; extra columns are not read (or kept by `keep_one`, whatever their names; of rows equal in id and text it
keeps one, the first by a hash of its columns). class_id is the smallest doc_id of the class; where an id names
several texts, class_key (the first text's hash) tells classes apart.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from voxelweave.llm.common import batches, quoted, table
from voxelweave.llm.darts import mix, signature
from voxelweave.llm.graph import components
from voxelweave.session import Scratch

K, BANDS, ROWS = 128, 25, 5
WORDS, SIMILAR = 5, 0.8
LIKELY = 0.64  # a pair of similarity 0.8 agrees on fewer of 128 coordinates once in about 115 000 pairs
BLOCK, BYTES = 1000, 32_000_000  # members of one side of a block and bytes of their texts, about

_SIGNED = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("key", T.BinaryType()), T.StructField("signature", T.BinaryType()), T.StructField("bands", T.ArrayType(T.LongType(), False)), T.StructField("bytes", T.LongType())])


def shingles(raw: bytes, weighted: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct hashes of a text's five-word windows and their weights."""
    words = raw.split()
    if not words:
        return np.zeros(0, np.uint64), np.zeros(0)
    hashes = np.array([xxhash.xxh64_intdigest(w) for w in words], np.uint64)
    size = min(WORDS, len(words))
    n = len(words) - size + 1
    key = np.full(n, size, np.uint64)
    with np.errstate(over="ignore"):
        for k in range(size):
            key = mix(key + hashes[k : k + n])
    distinct, counts = np.unique(key, return_counts=True)
    return distinct, counts.astype(float) if weighted else np.ones(len(distinct))


def similarity(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Weighted Jaccard similarity of two weighted sets with sorted elements."""
    _, i, j = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    common = np.minimum(a[1][i], b[1][j]).sum()
    return float(common / max(a[1].sum() + b[1].sum() - common, 1e-9))


def _rows(short: np.ndarray) -> np.ndarray:
    """Signatures (one a row) as bands of coordinates."""
    return short[:, : BANDS * ROWS].reshape(len(short), BANDS, ROWS)


def _bands(short: np.ndarray) -> np.ndarray:
    key = np.arange(BANDS, dtype=np.uint64)
    with np.errstate(over="ignore"):
        for k in range(ROWS):
            key = mix(key + _rows(short[None])[0, :, k].astype(np.uint64))
    return key.view(np.int64)


def _sign(weighted: bool):
    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[bytes, tuple[bytes, np.ndarray]] = {}
        for batch in batches(source):
            out = []
            for key, raw in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                if key not in known:
                    if len(known) > 2000:
                        known.clear()
                    short = (signature(*shingles(raw, weighted), k=K) & np.uint64(0xFFFF)).astype(np.uint16)
                    known[key] = short.tobytes(), _bands(short) if len(short) else np.zeros(0, np.int64)
                out.append(known[key])
            sizes = np.cumsum([0, *(len(b) for _, b in out)]).astype(np.int32)
            flat = np.concatenate([b for _, b in out]) if out else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([s for s, _ in out], pa.binary()), pa.ListArray.from_arrays(sizes, pa.array(flat)), pa.compute.binary_length(batch.column(2)).cast(pa.int64())], names=_SIGNED.names)

    return run


def _keyed(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """(doc_id, key, raw): the key is the MD5 hash of the whole text."""
    raw = F.coalesce(F.col(text).cast("string").cast("binary"), F.lit(b""))
    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.unhex(F.md5(raw)).alias("key"), raw.alias("raw"))


_SETS = T.StructType([T.StructField("node", T.LongType()), T.StructField("elements", T.BinaryType()), T.StructField("weights", T.BinaryType())])


def _sets(weighted: bool):
    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches(source):
            got = [shingles(raw, weighted) for raw in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([e.tobytes() for e, _ in got], pa.binary()), pa.array([b"" if (w == 1).all() else w.astype(np.float32).tobytes() for _, w in got], pa.binary())], names=_SETS.names)

    return run


def _unpack(elements: bytes, weights: bytes) -> tuple[np.ndarray, np.ndarray]:
    e = np.frombuffer(elements, np.uint64)
    return e, np.frombuffer(weights, np.float32).astype(float) if weights else np.ones(len(e))


_LINK = T.StructType([T.StructField("a", T.LongType()), T.StructField("b", T.LongType())])


def _likely(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of (a, b, signature of a, signature of b) the pairs whose signatures agree often enough."""
    for batch in source:
        if batch.num_rows:
            x, y = (np.frombuffer(b"".join(batch.column(k).to_pylist()), np.uint16).reshape(-1, K) for k in (2, 3))
            good = pa.array((x == y).mean(1) >= LIKELY)
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(good), batch.column(1).filter(good)], names=_LINK.names)


def _similar(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of (a, b, sets of a, sets of b) the pairs that are similar enough."""
    for batch in batches(source):
        ae, aw, be, bw = (batch.column(k).to_pylist() for k in (2, 3, 4, 5))
        good = pa.array([similarity(_unpack(*x[:2]), _unpack(*x[2:])) >= SIMILAR for x in zip(ae, aw, be, bw, strict=True)], pa.bool_())
        yield pa.RecordBatch.from_arrays([batch.column(0).filter(good), batch.column(1).filter(good)], names=_LINK.names)


_MEMBER = T.StructType(
    [T.StructField("bucket", T.LongType()), T.StructField("i", T.IntegerType()), T.StructField("j", T.IntegerType()), T.StructField("asks", T.BooleanType()), T.StructField("outside", T.BooleanType()), T.StructField("band", T.IntegerType())]
    + [T.StructField("node", T.LongType()), T.StructField("component", T.LongType()), T.StructField("signature", T.BinaryType())]
)


class _Block:
    """Members of a bucket: some ask, and all are asked."""

    def __init__(self, asks: np.ndarray, outside: np.ndarray, band: int, node: np.ndarray, component: np.ndarray, signature: list[bytes]):
        self.asking, self.asked = np.flatnonzero(asks), np.flatnonzero(~asks)
        self.outside, self.band, self.node, self.root = outside, band, node, component.copy()
        self.signed = np.frombuffer(b"".join(signature), np.uint16).reshape(-1, K)

    def partners(self, x: int) -> np.ndarray:
        """Who may link to x, likeliest first: of another component, alike by signature, and in no earlier bucket with it."""
        at = self.asked[self.root[self.asked] != self.root[x]]
        at = at[~self.outside[at] | (self.node[at] > self.node[x])]  # two outside the largest component meet from one side
        agree = (self.signed[at] == self.signed[x]).mean(1)
        near = np.flatnonzero(agree >= LIKELY)
        near = near[np.argsort(-agree[near], kind="stable")]
        shared = (_rows(self.signed[at[near]]) == _rows(self.signed[x : x + 1])).all(2)
        return at[near[shared.argmax(1) == self.band]] if len(near) else at[:0]


def _open_members(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of members sorted by block those that may link; at most a block and a batch are held."""
    kept: pa.RecordBatch | None = None

    def look(rows: pa.RecordBatch) -> pa.RecordBatch:
        c = [rows.column(k).to_numpy(zero_copy_only=False) for k in range(8)]
        signature = rows.column(8).to_pylist()
        edges = np.flatnonzero(np.any([np.diff(x) != 0 for x in c[:3]], axis=0)) + 1
        good = np.zeros(rows.num_rows, bool)
        for x, y in zip([0, *edges], [*edges, rows.num_rows], strict=True):
            block = _Block(c[3][x:y], c[4][x:y], c[5][x], c[6][x:y], c[7][x:y], signature[x:y])
            for member in block.asking:
                near = block.partners(member)
                good[x + near] = True
                good[x + member] |= len(near) > 0
        return rows.filter(pa.array(good))

    for batch in source:
        for part in batches([batch], 4096):
            rows = part if kept is None else pa.concat_batches([kept, part])
            last = [rows.column(k)[rows.num_rows - 1].as_py() for k in range(3)]
            same = np.all([rows.column(k).to_numpy() == last[k] for k in range(3)], axis=0)
            cut = int(np.argmax(same))  # the last block may go on in the next batch
            if cut:
                yield look(rows.slice(0, cut))
            kept = rows.slice(cut)
    if kept is not None:
        yield look(kept)


def _links_in_block(rows: pd.DataFrame) -> pd.DataFrame:
    """Links between different components of a block's members; each link merges two components at once."""
    block = _Block(rows["asks"].to_numpy(), rows["outside"].to_numpy(), rows["band"].iloc[0], rows["node"].to_numpy(), rows["component"].to_numpy(), list(rows["signature"]))
    sets = [_unpack(e, w) for e, w in zip(rows["elements"], rows["weights"], strict=True)]
    out = []
    for x in block.asking:
        for y in block.partners(x):
            if block.root[x] != block.root[y] and similarity(sets[x], sets[y]) >= SIMILAR:
                out.append((block.node[x], block.node[y]))
                block.root[block.root == block.root[y]] = block.root[x]
    return pd.DataFrame(out, columns=["a", "b"], dtype="int64")


def _blocks(labelled: DataFrame, signed: DataFrame, scratch: Scratch) -> DataFrame:
    """The members (bucket, band, node, component) of buckets with several components, in blocks (bucket, i, j)."""
    sizes = labelled.groupBy("bucket", "component").agg(F.count("*").alias("n"), F.sum("bytes").alias("b"))
    shape = sizes.groupBy("bucket").agg(F.max(F.struct("n", "component", "b")).alias("main"), F.sum("n").alias("all"), F.sum("b").alias("whole"), F.count("*").alias("parts")).where("parts > 1")
    chunks = lambda n, b: F.ceil(F.greatest(n / BLOCK, b / BYTES)).cast("int")
    outside = chunks(F.col("all") - F.col("main.n"), F.col("whole") - F.col("main.b"))
    shape = shape.select("bucket", F.col("main.component").alias("main"), chunks(F.col("all"), F.col("whole")).alias("js"), outside.alias("is"))
    shape = scratch.keep(shape, "shape")
    rows = labelled.join(shape, "bucket").withColumn("outside", F.col("component") != F.col("main")).join(signed, "node")
    place = lambda salt, n: F.pmod(F.xxhash64("node", F.lit(salt)), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    asking = rows.where("outside").withColumn("i", place(0, "is")).withColumn("j", every("js")).withColumn("asks", F.lit(True))
    asked = rows.withColumn("j", place(1, "js")).withColumn("i", every("is")).withColumn("asks", F.lit(False))
    return asking.unionByName(asked).select(*_MEMBER.names)


def _classes(docs: DataFrame, doc_id: str, text: str, weighted: bool) -> tuple[DataFrame, DataFrame]:
    """All rows as (doc_id, key), and the nodes as (key, doc_id, class_id, class_key, kept)."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "near")
    keyed = _keyed(docs, doc_id, text)
    signed = scratch.keep(keyed.mapInArrow(_sign(weighted), _SIGNED), "signed")
    distinct = signed.groupBy("key").agg(F.min("doc_id").alias("doc_id"), F.first("signature").alias("signature"), F.first("bands").alias("bands"), F.first("bytes").alias("bytes"))
    nodes = scratch.keep(distinct.withColumn("node", F.monotonically_increasing_id()), "nodes")

    met = nodes.select("node", "bytes", F.posexplode("bands").alias("band", "bucket"))
    # written before they are joined: a join of two plain shuffles is one whose hot buckets Spark splits
    shared = scratch.keep(met.groupBy("bucket").agg(F.count("*").alias("size")).where("size > 1"), "shared")
    members = scratch.keep(met.join(shared, "bucket"), "members")
    widely = members.groupBy("node").agg(F.sum("size").alias("widely"))
    centres = members.join(widely, "node").groupBy("bucket").agg(F.max(F.struct("widely", "node")).alias("c")).select("bucket", F.col("c.node").alias("centre"))
    centres = scratch.keep(centres, "centres")
    pairs = members.join(centres, "bucket").where("node <> centre").select(F.least("node", "centre").alias("a"), F.greatest("node", "centre").alias("b")).distinct()

    sign = nodes.select("node", "signature")
    signs = pairs.join(sign.toDF("a", "sa"), "a").join(sign.toDF("b", "sb"), "b").select("a", "b", "sa", "sb")
    likely = scratch.keep(signs.mapInArrow(_likely, _LINK), "likely")
    needed = members.select("node").distinct().join(nodes.select("node", F.col("key").alias("own")), "node")
    once = keyed.groupBy("key").agg(F.first("raw").alias("raw"))  # copies meet before the shuffle: one row a text and task
    texts = once.join(needed, once["key"] == needed["own"]).select("node", "raw")
    sets = scratch.keep(texts.mapInArrow(_sets(weighted), _SETS), "sets")
    both = likely.join(sets.toDF("a", "ae", "aw"), "a").join(sets.toDF("b", "be", "bw"), "b").select("a", "b", "ae", "aw", "be", "bw")
    first = scratch.keep(both.mapInArrow(_similar, _LINK).distinct(), "first")
    scratch.drop("likely", "shared", "centres")

    named = components(first)
    labelled = scratch.keep(members.drop("size").join(named, "node", "left").withColumn("component", F.coalesce("component", "node")), "labelled")
    scratch.drop("members")
    width = int(spark.conf.get("spark.sql.shuffle.partitions"))
    blocks = _blocks(labelled, sign, scratch).repartition(width, "bucket", "i", "j").sortWithinPartitions("bucket", "i", "j")
    may = scratch.keep(blocks.mapInArrow(_open_members, _MEMBER), "may")
    second = scratch.keep(may.join(sets, "node").groupBy("bucket", "i", "j").applyInPandas(_links_in_block, _LINK).distinct(), "second")
    scratch.drop("labelled", "shape", "may", "sets")

    final = components(first.unionByName(second)).toDF("node", "component")
    owned = nodes.select("node", "key", "doc_id").join(final, "node", "left").withColumn("component", F.coalesce("component", "node"))
    heads = owned.groupBy("component").agg(F.min(F.struct("doc_id", "key")).alias("head"))
    result = owned.join(heads, "component").select("key", "doc_id", F.col("head.doc_id").alias("class_id"), F.col("head.key").alias("class_key"), (F.col("key") == F.col("head.key")).alias("kept"))
    classes = scratch.keep(result, "classes")
    scratch.drop("nodes", "first", "second")
    return signed.select("doc_id", "key"), classes


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", weighted: bool = True) -> DataFrame:
    """(doc_id, class_id, kept, class_key) for each row of docs; kept is true for rows that may stand for their class."""
    rows, classes = _classes(docs, doc_id, text, weighted)
    joined = rows.join(classes.withColumnRenamed("doc_id", "first"), "key")
    return joined.select("doc_id", "class_id", (F.col("kept") & F.col("doc_id").eqNullSafe(F.col("first"))).alias("kept"), F.hex("class_key").alias("class_key"))


def keep_one(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", weighted: bool = True) -> DataFrame:
    """One row of docs of each class, with all its columns: the first text's, of the smallest id."""
    _, classes = _classes(docs, doc_id, text, weighted)
    heads = classes.where("kept").select(F.col("key").alias("head"), F.col("doc_id").alias("first"))
    key = F.unhex(F.md5(F.coalesce(F.col(text).cast("string").cast("binary"), F.lit(b""))))
    plain = [quoted(f.name) for f in docs.schema if isinstance(f.dataType, T.AtomicType)]
    # names of this table are its own: the row of docs is one struct, so none of its columns can clash
    rows = docs.select(key.alias("key"), F.col(doc_id).cast("long").alias("id"), F.xxhash64(*plain).alias("order"), F.struct(*map(quoted, docs.columns)).alias("row"))
    one = rows.groupBy("key", "id").agg(F.min_by("row", "order").alias("row"))  # repeated rows meet before the shuffle
    return one.join(heads, (F.col("key") == F.col("head")) & F.col("id").eqNullSafe(F.col("first")), "left_semi").select("row.*")


def op10_near_dedup(spark, sf_dir: str) -> DataFrame:
    """All documents with the class of texts that are similar to 0.8 or more."""
    return near_duplicates(table(spark, sf_dir, "documents"))
