"""Operator 12: fingerprints of documents as homomorphic multiset hashes.

A paragraph (a line) is hashed as its sentences; the 256 bits of a sentence's SHA-256 are a vector of +1 and -1, and a
fingerprint is the sum of all of them in lanes modulo 2 ** 16, written as 1024 hex digits. Sums don't depend on the
order of paragraphs, so texts of the same paragraphs in any order are equal; a paragraph is inserted or deleted by
adding or subtracting its own vector (`changed`), and fingerprints of documents add up to that of a table (`total`).
Different multisets agree in all lanes with a probability of about 2 ** -256.

Lanes of two fingerprints also tell how alike they are: the mean square of a lane estimates the sum of squared
multiplicities, so likeness = 1 - |a - b|^2 / (|a|^2 + |b|^2), at least 0: 1 for equal multisets, and for sentences that
occur once the share that both have, up to about 0.06 of error by 256 lanes. A sentence that occurs 32 768 times and
more wraps a lane around: equality stays right, likeness doesn't.

The edited text needs the next document's beginning, so rows are sorted by range partitions, once; neighbours meet
within a task, and the first and last rows of tasks, two a task, in a join.

Defined results: a null text counts as empty, and an empty text is one empty paragraph; null ids come last in
descending order; rows of one id are ordered by the text's hash, and of equal rows any may be first, which changes
nothing; a sole row's next document is itself; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from voxelweave.llm.common import batches, quoted, table
from voxelweave.session import Scratch

LANES, MODULUS = 256, 1 << 16
PIECES = 1 << 15  # sentences whose vectors are held at once
#: A sentence with the blanks behind it, and the line's end if it is the last of its paragraph.
SENTENCE = "[^.!?\n]*[.!?]+[ \t]*\n?|[^.!?\n]*\n"

_split = re.compile(SENTENCE).findall


# --- vectors -----------------------------------------------------------------------------------------------


def vector(text: str) -> np.ndarray:
    """The lanes of a text, each from 0 to MODULUS - 1."""
    pieces, total = _split(text + "\n"), np.zeros(LANES, np.int64)
    for a in range(0, len(pieces), PIECES):
        part = pieces[a : a + PIECES]
        bits = np.frombuffer(b"".join(hashlib.sha256(p.encode()).digest() for p in part), np.uint8).reshape(-1, LANES // 8)
        total += 2 * np.unpackbits(bits, axis=1).sum(0, dtype=np.int64) - len(part)
    return total % MODULUS


def plus(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (a + b) % MODULUS


def minus(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (a - b) % MODULUS


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """From 0 (nothing in common) to 1 (equal)."""
    x, y, d = (np.where(v < MODULUS // 2, v, v - MODULUS) for v in (a, b, minus(a, b)))
    both = int(x @ x + y @ y)
    return max(0.0, 1.0 - float(d @ d) / both) if both else float(not d.any())


def written(v: np.ndarray) -> str:
    return v.astype(">u2").tobytes().hex()


def read(fingerprint: str) -> np.ndarray:
    return np.frombuffer(bytes.fromhex(fingerprint), ">u2").astype(np.int64)


# --- tables ------------------------------------------------------------------------------------------------


def fingerprints(docs: DataFrame, text: str = "text", out: str = "fingerprint") -> DataFrame:
    """docs with the fingerprint of each whole text, in a column that must be new; nothing is shuffled."""
    if out in docs.columns:
        raise ValueError(f"there is a column {out} already")

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches(source):
            prints = [written(vector(t or "")) for t in batch.column(batch.num_columns - 1).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(prints, pa.string())], names=names)

    names = [*docs.columns, out]
    schema = docs.withColumn(out, F.lit("")).schema
    return docs.withColumn(out, F.coalesce(quoted(text).cast("string"), F.lit(""))).mapInArrow(run, schema)


def changed(rows: DataFrame) -> DataFrame:
    """Rows (id, fingerprint, added, removed) to (id, fingerprint) after paragraphs were added and removed; their texts are not needed again."""

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches(source):
            out = []
            for old, more, less in zip(*(c.to_pylist() for c in batch.columns[1:]), strict=True):
                v = read(old)
                for change, paragraphs in ((plus, more), (minus, less)):
                    for p in paragraphs or []:
                        v = change(v, vector(p or ""))
                out.append(written(v))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.string())], names=["id", "fingerprint"])

    return rows.select("id", "fingerprint", "added", "removed").mapInArrow(run, rows.select("id", "fingerprint").schema)


def total(rows: DataFrame) -> DataFrame:
    """One row: the fingerprint of all rows' texts together, from their fingerprints; tasks add up before anything moves."""

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lanes = np.zeros(LANES, np.int64)
        for batch in source:
            for f in batch.column(0).to_pylist():
                lanes = plus(lanes, read(f))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(LANES, dtype=np.int32)), pa.array(lanes)], names=["lane", "v"])

    lanes = rows.select("fingerprint").where("fingerprint is not null").mapInArrow(run, "lane int, v long").groupBy("lane").agg((F.sum("v") % MODULUS).alias("v"))
    digits = F.lower(F.lpad(F.hex("v"), 4, "0"))
    return lanes.agg(F.concat_ws("", F.transform(F.array_sort(F.collect_list(F.struct("lane", digits.alias("d")))), lambda x: x["d"])).alias("fingerprint"))  # LANES rows


# --- edited texts ------------------------------------------------------------------------------------------

_ROW = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
_MADE = f"{_ROW}, edge string, part int, text string"
_NAMES = [f.split()[0] for f in _MADE.split(", ")]
_KINDS = [pa.int64(), pa.int64(), *[pa.string()] * 3, pa.float64(), pa.float64(), pa.string(), pa.int32(), pa.string()]


def edited(text: str, following: str) -> str:
    """The last half of a text replaced by as much of the next one's beginning."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def _judge(doc_id: int | None, text: str, own: np.ndarray, following: str, its: np.ndarray) -> tuple:
    new = edited(text, following)
    v = vector(new)
    return doc_id, len(text), hashlib.sha256(new.encode()).hexdigest(), written(own), written(v), likeness(own, v), likeness(own, its)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), _KINDS, strict=False)], names=_NAMES[: len(rows[0])])


def _neighbours(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted rows (doc_id, text): results of all but the last one, whose next document another task has, and both edges."""
    part, before = TaskContext.get().partitionId(), None
    none = (None,) * 6
    for batch in batches(source):
        rows = []
        for doc_id, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            v = vector(text)
            rows.append((None, *none, "head", part, text) if before is None else (*_judge(*before, text, v), None, part, None))
            before = doc_id, text, v
        yield _batch(rows)
    if before:
        yield _batch([(before[0], *none, "tail", part, before[1])])


def _edges(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches(source, 64):
        rows = [_judge(doc_id, text, vector(text), following, vector(following)) for doc_id, text, following in zip(*(c.to_pylist() for c in batch.columns), strict=True)]
        if rows:
            yield _batch(rows)


def against_next(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Each document's fingerprint, its edited text's, and how alike it is to that and to the next document (descending doc_id, after the last the first)."""
    scratch, width = Scratch(docs.sparkSession, "fingerprints"), int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(quoted(doc_id).cast("long").alias("doc_id"), F.coalesce(quoted(text).cast("string"), F.lit("")).alias("text"))
    keyed = rows.withColumn("h", F.xxhash64("text")).withColumn("tie", F.monotonically_increasing_id())
    order = [F.desc("doc_id"), F.asc("h"), F.asc("tie")]  # the tie is any order of equal rows, so that ranges split them
    ordered = keyed.repartitionByRange(width, *order).sortWithinPartitions(*order).select("doc_id", "text")
    ordered.mapInArrow(_neighbours, _MADE).write.option("compression", "zstd").parquet(f"{scratch.root}/made")  # digits of small numbers: half of what the usual codec leaves
    made = docs.sparkSession.read.schema(_MADE).parquet(f"{scratch.root}/made")
    heads = made.where("edge = 'head'").select("part", F.col("text").alias("following"))
    parts = made.where("edge = 'head'").select("part")  # one row a task
    least = parts.agg(F.min("part").alias("least"))
    follows = parts.withColumn("after", F.lead("part").over(Window.orderBy("part"))).join(F.broadcast(least)).select("part", F.coalesce("after", "least").alias("after"))
    tails = made.where("edge = 'tail'").select("doc_id", "text", "part").join(follows, "part")
    last = tails.join(heads.withColumnRenamed("part", "after"), "after").select("doc_id", "text", "following").mapInArrow(_edges, _ROW)
    return made.where("edge is null").select(*_NAMES[:7]).unionByName(last)


def op12_fingerprints(spark, sf_dir: str) -> DataFrame:
    """All documents and what they are with a half of the next one in them."""
    return against_next(table(spark, sf_dir, "documents"))


def _near(a: str, b: str) -> str:
    """likeness() of two lists of lanes."""
    squares = lambda v: f"list_sum(list_transform({v}, lambda p: p * p))"
    apart = f"list_sum(list_transform(list_zip({a}, {b}), lambda p: (p[1] - p[2]) * (p[1] - p[2])))"
    return f"greatest(0.0, 1.0 - CAST({apart} AS DOUBLE) / CAST({squares(a)} + {squares(b)} AS DOUBLE))"


ORACLE = f"""WITH d AS (SELECT doc_id, coalesce(text, '') AS t, length(coalesce(text, '')) AS n FROM documents),
x AS (SELECT *, row_number() OVER (ORDER BY doc_id DESC NULLS LAST) AS i, count(*) OVER () AS c FROM d),
e AS (SELECT a.i, a.doc_id, a.n, a.t, a.c, substr(a.t, 1, a.n - a.n // 2) || substr(b.t, 1, a.n // 2) AS u FROM x a JOIN x b ON b.i = a.i % a.c + 1),
s AS (SELECT i, 0 AS k, unnest(regexp_extract_all(t || chr(10), '{SENTENCE}')) AS p FROM e UNION ALL SELECT i, 1, unnest(regexp_extract_all(u || chr(10), '{SENTENCE}')) FROM e),
h AS (SELECT i, k, sha256(p) AS h, count(*) AS m FROM s GROUP BY ALL),
l AS (SELECT i, k, lane, sum(CASE WHEN (strpos('0123456789abcdef', substr(h, 1 + lane // 4, 1)) - 1) >> (3 - lane % 4) & 1 = 1 THEN m ELSE -m END) AS v FROM h, range({LANES}) r(lane) GROUP BY ALL),
f AS (SELECT i, k, list(CAST(v AS BIGINT) ORDER BY lane) AS v, string_agg(printf('%04x', (CAST(v AS BIGINT) + {MODULUS * MODULUS}) % {MODULUS}), '' ORDER BY lane) AS f FROM l GROUP BY ALL)
SELECT doc_id, n AS n_chars, sha256(u) AS edited_sha256, a.f AS fingerprint, b.f AS edited_fingerprint, {_near("a.v", "b.v")} AS near_edited, {_near("a.v", "z.v")} AS near_next
FROM e JOIN f a ON a.i = e.i AND a.k = 0 JOIN f b ON b.i = e.i AND b.k = 1 JOIN f z ON z.i = e.i % e.c + 1 AND z.k = 0"""
