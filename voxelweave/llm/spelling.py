"""Operator 13: spelling variants, words at one edit from each other, by a positional q-gram index.

Words are counted over all texts in tasks and summed; those long and frequent enough are the vocabulary. Two words at one
edit share most q-grams, at places that differ by one at most: an edit changes at most Q of them, so of a word's Q + 1
rarest q-grams one at least is among the other's Q + 1 rarest, and it stands at the same place from the start or
from the end. So each word is posted under these (side, q-gram, place) keys, and keys are dealt over tasks.

Within a key an inverted index of q-grams is built in order of length. By the overlap bound a pair shares at least
max(length) - 2 * Q + 1 q-grams, all but Q of the longer word's, so any Q + 1 of them hold a shared one: a word merges by
a heap the postings of its Q + 1 rarest, in words of its length or one less and at places one apart at most, and what
comes up is verified. Words of one length meet under places from the start alone; pairs of several keys are made distinct.

Keys of more than GROUP words are hot and dealt on: their words meet again by key and word less one code point, at most
as many as an alphabet has letters a place, where the same index is built. So no key is too large, and no pair is lost.
The rarity of q-grams is a table of at most 90 ** Q rows: words have the letters a-z and U+00C0 to U+00FF only.

Each word's form is its most frequent near word, if that is RATIO times as frequent; forms lead by pointer doubling to
a root. Frequencies rise with every form, so there are no circles.

Defined results: null and empty texts have no words; a null doc_id counts as an empty one; repeated rows count each; ties
go to the smaller word in code-point order; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import heapq
import re
import zlib
from collections import Counter, defaultdict
from collections.abc import Iterator
from functools import partial
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxelweave.llm.common import batches, quoted, table
from voxelweave.llm.merkle import CRC_TABLE, crc_sql
from voxelweave.session import Scratch

Q = 3
LEAST_LENGTH, LEAST_COUNT, RATIO = 6, 5, 5
FAULT = 199  # one run of a document in so many loses a code point
GROUP = 500  # words of a key that one index takes
HELD = 200_000  # words counted before they are handed on

_runs = re.compile("[A-Za-zÀ-ÿ]+").findall


# --- words -------------------------------------------------------------------------------------------------


def with_fault(doc_id: str, run: str, fault: int = FAULT) -> str:
    """A run as it counts: without a code point where the checksum of document and run says so."""
    h = zlib.crc32(f"{doc_id}:{run}".encode())
    at = h % len(run)
    return run if not fault or h % fault else run[:at] + run[at + 1 :]


def _count(source: Iterator[pa.RecordBatch], fault: int, least: int) -> Iterator[pa.RecordBatch]:
    """(doc_id, text) to (word, n), summed over as many documents as HELD words allow."""

    def handed() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(total.keys(), pa.string()), pa.array(total.values(), pa.int64())], names=["word", "n"])

    total: Counter[str] = Counter()
    for batch in batches(source):
        for doc_id, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            for run, n in Counter(_runs(text.encode().lower().decode())).items():  # of bytes only A-Z are lower-cased
                if len(run) >= least:
                    word = with_fault(doc_id, run, fault)
                    if len(word) >= least:
                        total[word] += n
            if len(total) >= HELD:
                yield handed()
                total.clear()
    if total:
        yield handed()


def vocabulary(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", fault: int = FAULT, least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT) -> DataFrame:
    """(word, n) of all words of at least so many code points and occurrences."""
    rows = docs.select(F.coalesce(quoted(doc_id).cast("string"), F.lit("")).alias("doc_id"), F.coalesce(quoted(text).cast("string"), F.lit("")).alias("text"))
    found = rows.mapInArrow(partial(_count, fault=fault, least=least_length), "word string, n long")
    return found.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least_count)


# --- one edit ----------------------------------------------------------------------------------------------


def one_edit(a: str, b: str) -> bool:
    """Whether exactly one inserted, deleted or replaced code point makes b of a."""
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1 or a == b:
        return False
    at = 0
    while at < len(a) and a[at] == b[at]:
        at += 1
    return a[at + (len(a) == len(b)) :] == b[at + 1 :]


def grams(word: str, q: int = Q) -> list[str]:
    return [word[k : k + q] for k in range(len(word) - q + 1)]


def near_pairs(words: list[str], replaced: bool = True) -> Iterator[tuple[int, int]]:
    """Places of words at one edit from each other: an index of positional q-grams, postings merged by a heap, a count filter, verification.

    Of the longer word's q-grams all but Q must come up (the overlap bound), so one at least of any Q + 1 of them must:
    the postings of the Q + 1 rarest are merged. Without `replaced` only words whose lengths differ are compared.
    """
    index: dict[tuple[str, int, int], list[int]] = defaultdict(list)  # q-gram, place, length: words in order
    order = sorted(range(len(words)), key=lambda i: len(words[i]))
    for nth, i in enumerate(order):
        word, postings = words[i], []
        length, own = len(word), grams(words[i])
        lengths = (length - 1, length) if replaced else (length - 1,)
        for k, g in enumerate(own):
            found = [p for n in lengths for at in (k - 1, k, k + 1) if (p := index.get((g, at, n)))]
            postings.append((sum(map(len, found)), k, found))
        postings.sort()
        merged = [p for _, _, found in postings[: Q + 1] for p in found]
        for other, _ in groupby(heapq.merge(*merged)):
            if one_edit(words[order[other]], word):
                yield order[other], i
        for k, g in enumerate(own):
            index[g, k, length].append(nth)


def _keys(source: Iterator[pa.RecordBatch], rarity) -> Iterator[pa.RecordBatch]:
    """(word, n) under each of its keys: the Q + 1 rarest q-grams, each at its place from the start and from the end."""
    known = rarity.value
    for batch in source:
        out = []
        for word, n in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            own = grams(word)
            rarest = sorted(range(len(own)), key=lambda k: (known[own[k]], own[k], k))[: Q + 1]
            out += [(key, word, n) for k in rarest for key in (f"<{own[k]}{k}", f">{own[k]}{len(own) - k}")]
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out, strict=True)], names=["key", "word", "n"])


def _shorter(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of hot keys under key and word, and key and word less one code point."""
    for batch in source:
        for a in range(0, batch.num_rows, 512):
            out = []
            for key, word, n in zip(*(c.to_pylist() for c in batch.slice(a, 512).columns), strict=True):
                out += [(f"{key} {v}", word, n) for v in sorted({word, *(word[:k] + word[k + 1 :] for k in range(len(word)))})]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out, strict=True)], names=["key", "word", "n"])


def _compare(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted rows (key, word, n) to both directions of each pair of a key: (word, other, other_n)."""
    rows = (row for batch in source for row in zip(*(c.to_pylist() for c in batch.columns), strict=True))
    out: list[tuple[str, str, int]] = []

    def handed() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), (pa.string(), pa.string(), pa.int64()), strict=True)], names=["word", "other", "other_n"])

    for key, own in groupby(rows, key=lambda r: r[0]):
        _, words, counts = zip(*own, strict=True)
        if len(words) > 1:
            for i, j in near_pairs(list(words), key[0] == "<"):
                out += [(words[i], words[j], counts[j]), (words[j], words[i], counts[i])]
        if len(out) >= 4096:
            yield handed()
            out = []
    if out:
        yield handed()


_ROW = "key string, word string, n long"


def near_words(words: DataFrame, scratch: Scratch, group: int = GROUP) -> DataFrame:
    """(word, other, other_n), each ordered pair of near words once. words: (word, n), each word once and of at least 2 * Q letters of the alphabet."""
    spark, width = words.sparkSession, int(words.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    each = words.select(F.explode(F.transform(F.sequence(F.lit(1), F.length("word") - (Q - 1)), lambda k: F.col("word").substr(k, F.lit(Q)))).alias("g"))
    rarity = each.groupBy("g").agg(F.count("*").alias("c")).toArrow()  # at most 90 ** Q rows, whatever the vocabulary
    shared = spark.sparkContext.broadcast(dict(zip(*(c.to_pylist() for c in rarity.columns), strict=True)))
    posted = scratch.keep(words.select("word", "n").repartition(width).mapInArrow(partial(_keys, rarity=shared), _ROW), "posted")
    hot = scratch.keep(posted.groupBy("key").agg(F.count("*").alias("words")).where(F.col("words") > group).select("key"), "hot")
    dealt_on = posted.join(hot, "key", "left_semi").mapInArrow(_shorter, _ROW)
    groups = posted.join(hot, "key", "left_anti").unionByName(dealt_on)
    return groups.repartition(width, "key").sortWithinPartitions("key").mapInArrow(_compare, "word string, other string, other_n long").distinct()


# --- forms and roots ---------------------------------------------------------------------------------------


def _roots(forms: DataFrame, scratch: Scratch) -> DataFrame:
    """(word, root) of words that have a form: pointers double until none moves."""
    state, k = scratch.keep(forms.select("word", F.col("form").alias("root"), F.lit(True).alias("moved")), "root-0"), 0
    while not state.where("moved").isEmpty():
        on = state.select(F.col("word").alias("root"), F.col("root").alias("further"))
        k += 1
        state = scratch.keep(state.select("word", "root").join(on, "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")), f"root-{k}")
        scratch.drop(f"root-{k - 1}")
    return state.select("word", "root")


def variants(words: DataFrame, ratio: int = RATIO, group: int = GROUP) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of each word of (word, n)."""
    scratch = Scratch(words.sparkSession, "spelling")
    words = scratch.keep(words, "words")
    best = F.min(F.struct((-F.col("other_n")).alias("m"), "other")).alias("b")
    near = scratch.keep(near_words(words, scratch, group).groupBy("word").agg(F.count("*").alias("n_near"), best), "near")
    judged = words.join(near, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(-F.col("b.m") >= ratio * F.col("n"), F.struct(F.col("b.other").alias("form"), (-F.col("b.m")).alias("form_n"))).alias("f"))
    judged = scratch.keep(judged.select("word", "n", "n_near", "f.form", "f.form_n"), "judged")
    roots = _roots(judged.where("form is not null"), scratch)
    return judged.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op13_spelling(spark, sf_dir: str) -> DataFrame:
    """Variants of all documents' words."""
    return variants(vocabulary(table(spark, sf_dir, "documents")))


_LETTERS = "[A-Za-zÀ-ÿ]+"
_BYTES = "flatten(list_transform(string_split(doc_id || ':' || run, ''), lambda c: CASE WHEN ord(c) < 128 THEN [CAST(ord(c) AS BIGINT)] ELSE [CAST(195 AS BIGINT), CAST(ord(c) - 64 AS BIGINT)] END))"
ORACLE = f"""WITH RECURSIVE {CRC_TABLE},
o AS (SELECT coalesce(CAST(doc_id AS VARCHAR), '') AS doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{_LETTERS}')) AS run FROM documents),
r AS (SELECT doc_id, run, count(*) AS c FROM o WHERE length(run) >= {LEAST_LENGTH} GROUP BY ALL),
h AS (SELECT run, c, {crc_sql(_BYTES)} AS h FROM r, crc),
f AS (SELECT CASE WHEN h % {FAULT} = 0 THEN substr(run, 1, h % length(run)) || substr(run, 2 + h % length(run)) ELSE run END AS word, c FROM h),
w AS MATERIALIZED (SELECT word, CAST(sum(c) AS BIGINT) AS n FROM f WHERE length(word) >= {LEAST_LENGTH} GROUP BY 1 HAVING sum(c) >= {LEAST_COUNT}),
v AS (SELECT word, n, i, substr(word, 1, i - 1) || substr(word, i + 1) AS v FROM w, range(1, 200) r(i) WHERE i <= length(word)),
p AS (SELECT a.word AS a, b.word AS b FROM v a JOIN v b ON a.i = b.i AND a.v = b.v AND a.word <> b.word AND length(a.word) = length(b.word) UNION SELECT v.word, w.word FROM v JOIN w ON v.v = w.word UNION SELECT w.word, v.word FROM v JOIN w ON v.v = w.word),
g AS (SELECT a AS word, count(*) AS n_near, min({{'m': -n, 'w': b}}) AS best FROM p JOIN w ON w.word = b GROUP BY 1),
j AS (SELECT w.word, n, coalesce(n_near, 0) AS n_near, CASE WHEN -best.m >= {RATIO} * n THEN best.w END AS form, CASE WHEN -best.m >= {RATIO} * n THEN -best.m END AS form_n FROM w LEFT JOIN g USING (word)),
c AS (SELECT word, word AS at, form FROM j UNION ALL SELECT c.word, j.word, j.form FROM c JOIN j ON j.word = c.form)
SELECT j.word, j.form, c.at AS root, n, n_near, form_n FROM j JOIN c ON c.word = j.word AND c.form IS NULL"""
