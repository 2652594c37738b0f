"""Operator 7: quality rules and n-gram perplexity bands.

Base rules count words, symbols, repeated lines and words in repeated 8-word windows. The language model is an
interpolated modified Kneser-Ney model of order 5 over code points (case and accents count), so it is open to any
word and script and grows with the corpus; nothing is dropped for being rare. Code points from 4096 up share 4096
hashed values. The lowest level is an equal share of all 4096. Each language has its own counts, shrunk toward the model of all text by PRIOR pseudo-counts an
n-gram's context, whatever its share. Documents are split into two folds by the hash of their text and each fold
is scored by the counts of the other, so no document (nor its exact copies) is likely by what it alone holds.

Documents lie in blocks of about BLOCK characters. A block asks for its distinct n-grams; the requests meet in
shards, by the hash of an n-gram's last two context symbols, where all counts of an n-gram, its contexts and its
shorter forms are. Some contexts are common however many shards there are, so a shard is also cut into parts of
PART blocks: each part adds up its counts as sorted arrays, rounds of MERGED parts add up those of the whole shard,
and every part fits the shard's model (discounts are each shard's own) and answers its blocks. So what a task reads grows with the number of
different n-grams of a shard, not with the corpus. Nothing of the model is broadcast or brought to the driver.

Bigrams and unigrams belong to no one shard: how many symbols stand before a bigram is a sum over shards. So shards give
their sums by context symbol (at most 4096), the two lowest levels of a fold are fitted on these (at most 4096 x 4096
numbers, whatever the corpus), and each shard gets back the probabilities of just the bigrams that it holds.

log_perplexity is a word's: minus the log probability of the whole text by its words with a letter or digit (one
for each started LONG characters), so that marks between words count as cost and not as length. A language's band,
for each power of two in text length, is its median plus and minus `width` robust spreads (median absolute
deviation, times 1.4826), both over documents that pass the base rules and shrunk by SHRINK documents' weight from
length to language and from language to all. Documents outside are not kept. Defined results: null and empty texts
have no words, fail the base rules and are not kept; a null language is a language of its own; an empty table gives
no rows; extra columns are not read (or kept by `filter_quality`, whatever their names); each row of repeated ids or
texts is judged alone.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from voxelweave.llm.common import quoted, table, texts_of, trim
from voxelweave.session import materialize

WINDOW, LEAST_WORDS, REPEATED_PERCENT = 8, 20, 30
BITS, LONGEST, SHORTEST = 12, 5, 3  # bits a symbol of the model, its longest order and the shortest that a shard counts alone
BLOCK, CHUNK, LONG, SHRINK = 8_000_000, 500_000, 20, 20
STEPS = 1000  # of a log probability in a nat, as shards answer
PART, MERGED = 512, 32  # blocks of a fold that a shard's task answers at once, parts that are added up at once
#: Chosen without the labels of the fifth of documents whose crc32(doc_id) mod 5 is 0 (selection.py).
PRIOR, WIDTH = 8, 6.0


# --- characters and base counts ----------------------------------------------------------------------------


def repeated_words(words: list[bytes]) -> int:
    """Words covered by 8-word windows that occur twice or more, the first occurrence included."""
    n = len(words) - WINDOW + 1
    if n < 2:
        return 0
    number: dict[bytes, int] = {}
    ids = np.array([number.setdefault(w, len(number)) for w in words], np.uint64)
    with np.errstate(over="ignore"):
        mixed = (ids + np.uint64(0x9E3779B97F4A7C15)) * np.uint64(0xBF58476D1CE4E5B9)
        mixed ^= mixed >> np.uint64(29)
        key = np.zeros(n, np.uint64)
        for k in range(WINDOW):
            key = key * np.uint64(0x94D049BB133111EB) + mixed[k : k + n]
            key ^= key >> np.uint64(31)
    order = np.argsort(key, kind="stable")
    same = key[order][1:] == key[order][:-1]
    twice = np.zeros(n, bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    if not twice.any():
        return 0
    edge = np.zeros(len(words) + 1, np.int64)
    at = np.flatnonzero(twice)
    np.add.at(edge, at, 1)
    np.add.at(edge, at + WINDOW, -1)
    return int((np.cumsum(edge[:-1]) > 0).sum())


def base_counts(text: str) -> tuple[int, int, int, int, int, bool]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed."""
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()  # at the six ASCII characters of white space, no others
    chars = len(text) - sum(map(raw.count, (b" ", b"\t", b"\n", b"\r", b"\x0b", b"\x0c")))
    symbols = sum(map(raw.count, (b"#", b"*", b"$", b"%", b"&", b"|", b"<", b">")))
    lines = [x for x in raw.split(b"\n") if x.strip()] if b"\n" in raw else []
    repeated = repeated_words(words)
    return len(words), chars, symbols, len(lines) - len(set(lines)), repeated, len(words) < LEAST_WORDS or 100 * repeated > REPEATED_PERCENT * len(words)


# --- the model ---------------------------------------------------------------------------------------------


_SYMBOL, _PAIR, _TRIPLE = ((1 << BITS * k) - 1 for k in (1, 2, 3))  # the last symbols of an n-gram


def _hash(order: int, code: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        z = code.astype(np.uint64) + np.uint64(order << 40)
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return z ^ (z >> np.uint64(31))


def _discounts(counts: np.ndarray) -> np.ndarray:
    """D for counts 0, 1, 2 and 3 or more, from the counts of counts; plain halves where those are missing."""
    n = [int((counts == k).sum()) for k in range(5)]
    if min(n[1:]) == 0:
        return np.array([0, 0.5, 0.75, 0.9])
    y = n[1] / (n[1] + 2 * n[2])
    return np.array([0, *(float(np.clip(k - (k + 1) * y * n[k + 1] / n[k], 0.05, k - 0.05)) for k in (1, 2, 3))])


def symbols_of(text: str) -> np.ndarray:
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    return np.where(points < 1 << BITS, points, (points * np.uint32(2654435761)) >> np.uint32(32 - BITS)).astype(np.int64)


def open_grams(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The packed 5-gram that ends at each character of the texts, and the number of characters of each text."""
    lengths = np.array([len(t) for t in texts], np.int64)
    pad = "\n" * (LONGEST - 1)
    symbols = symbols_of(pad + pad.join(texts))
    gram = symbols.copy()
    for back in range(1, LONGEST):
        gram[back:] += symbols[:-back] << (BITS * back)
    ends = np.cumsum(lengths + LONGEST - 1)
    keep = np.ones(len(symbols), bool)
    for k in range(LONGEST - 1):
        keep[ends - lengths - 1 - k] = False
    return gram[keep], lengths


def shard_of(grams: np.ndarray, shards: int) -> np.ndarray:
    """By the last two symbols of the context, so that an n-gram meets its contexts and its forms of three symbols or more."""
    return (_hash(0, (grams >> BITS) & ((1 << 2 * BITS) - 1)) % np.uint64(shards)).astype(np.int64)


def _find(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if not len(keys):
        return np.zeros(len(wanted), np.int64), np.zeros(len(wanted), bool)
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return at, keys[at] == wanted


def _summed(grams: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    keys, inverse = np.unique(grams, return_inverse=True)
    return keys, np.bincount(inverse, counts, len(keys)).astype(np.int64)


def _contexts(grams: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct contexts of sorted n-grams and the sums of the values of each."""
    context = grams >> BITS
    starts = np.flatnonzero(np.r_[True, context[1:] != context[:-1]]) if len(grams) else np.zeros(0, np.int64)
    return context[starts], np.add.reduceat(values, starts) if len(grams) else values


class OpenModel:
    """Interpolated modified Kneser-Ney of orders 5 to 1 over sorted packed n-grams, above equal shares of all symbols.

    With `low`, the sorted bigrams that may be asked for and their probabilities, only orders 5 to 3 are fitted.
    """

    def __init__(self, grams: np.ndarray, counts: np.ndarray, low: tuple[np.ndarray, np.ndarray] | None = None):
        self.levels, self.low = [], low
        for order in range(LONGEST, SHORTEST - 1 if low else 0, -1):
            off = _discounts(counts)[np.minimum(counts, 3)]
            contexts, total = _contexts(grams, counts)
            self.levels.append((order, grams, counts - off, contexts, total, _contexts(grams, off)[1] / np.maximum(total, 1)))
            grams, counts = np.unique(grams & ((1 << BITS * (order - 1)) - 1), return_counts=True)

    def prob(self, wanted: np.ndarray) -> np.ndarray:
        p = np.full(len(wanted), 1 / (1 << BITS))
        if self.low:
            at, given = _find(self.low[0], wanted & _PAIR)
            p = np.where(given, self.low[1][at], p) if given.any() else p
        for order, keys, kept, contexts, total, gamma in reversed(self.levels):
            gram = wanted & ((1 << BITS * order) - 1)
            at, known = _find(contexts, gram >> BITS)
            own, seen = _find(keys, gram)
            if known.any():
                p = np.where(known, np.where(seen, kept[own], 0) / total[at] + gamma[at] * p, p)
        return p


def low_levels(context: np.ndarray, symbol: np.ndarray, counts: np.ndarray, contexts: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, float]]:
    """Orders 2 and 1 from all bigrams and the numbers of symbols before them: for each of `contexts` the symbols of the model, their probabilities and that of any other symbol."""
    off = _discounts(counts)[np.minimum(counts, 3)]
    seen, place, before = np.unique(symbol, return_inverse=True, return_counts=True)
    less = _discounts(before)[np.minimum(before, 3)]
    total = max(int(before.sum()), 1)
    rest = (less.sum() / total if len(seen) else 1.0) / (1 << BITS)
    single = (before - less) / total + rest
    order = np.argsort(context, kind="stable")
    for x, y in zip(*(np.searchsorted(context[order], contexts, side) for side in ("left", "right")), strict=True):
        mine = order[x:y]
        all_, gamma = max(int(counts[mine].sum()), 1), float(off[mine].sum() / counts[mine].sum()) if y > x else 1.0
        p = gamma * single
        p[place[mine]] += (counts[mine] - off[mine]) / all_
        yield seen, p, gamma * rest


def shrunk(pooled: np.ndarray, grams: np.ndarray, counts: np.ndarray, wanted: np.ndarray, prior: float = PRIOR) -> np.ndarray:
    """A language's probabilities: its own counts, with `prior` more a context shared out as in the pooled model."""
    at, seen = _find(grams, wanted)
    contexts, total = _contexts(grams, counts)
    own, known = _find(contexts, wanted >> BITS)
    have = np.where(seen, counts[at], 0) if len(counts) else 0
    return (have + prior * pooled) / ((np.where(known, total[own], 0) if len(total) else 0) + prior)


def words_of(text: str) -> int:
    """Words with a letter or digit, one for each started LONG characters."""
    return sum(-(-len(w) // LONG) for w in text.split() if any(map(str.isalnum, w)))


# --- Spark -------------------------------------------------------------------------------------------------

_ASKED = "block int, fold int, lang string, shard int, part int, n int, grams binary, counts binary"
_SUMS = "fold int, lang string, shard int, part int, n int, grams binary, counts binary"
_PAIRS = "fold int, shard int, context int, symbols array<int>, counts array<long>"
_TOTALS = "fold int, context int, symbols array<int>, counts array<long>"
_LOW = "fold int, context int, symbols array<int>, probs array<double>, other double"
_ANSWERED = "block int, lang string, shard int, logs binary"
_COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def _by_language(langs: list[str | None]) -> dict[str | None, list[int]]:
    by: dict[str | None, list[int]] = {}
    for k, lang in enumerate(langs):
        by.setdefault(lang, []).append(k)
    return by


def _chunks(texts: list[str], rows: list[int]) -> Iterator[list[int]]:
    """Rows in runs of about CHUNK characters: n-grams of more texts than that are never held at once."""
    run, size = [], 0
    for k in rows:
        if run and size + len(texts[k]) > CHUNK:
            yield run
            run, size = [], 0
        run.append(k)
        size += len(texts[k])
    if run:
        yield run


def _distinct(grams: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct n-grams, and the place of each n-gram among them."""
    codes, found = pd.factorize(grams)
    order = np.argsort(found)
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    return found[order], place[codes]


def _packed(values: np.ndarray, size: int = 8) -> bytes:
    """Whole numbers of `size` bytes by their bytes, all first ones, all second ones and so on: most are zeros."""
    return pa.compress(values.astype(f"<i{size}").view(np.uint8).reshape(-1, size).T.tobytes(), codec="zstd", asbytes=True)


def _unpacked(raw: bytes, n: int, size: int = 8) -> np.ndarray:
    return np.frombuffer(pa.decompress(raw, size * n, codec="zstd", asbytes=True), np.uint8).reshape(size, n).T.copy().view(f"<i{size}").ravel()


def _rows(schema: str, rows: list[tuple]) -> pa.Table:
    kinds = {"int": pa.int32(), "double": pa.float64(), "string": pa.string(), "binary": pa.binary(), "array<int>": pa.list_(pa.int32()), "array<long>": pa.list_(pa.int64()), "array<double>": pa.list_(pa.float64())}
    fields = [f.split() for f in schema.split(", ")]
    columns = list(zip(*rows, strict=True)) or [[]] * len(fields)
    return pa.table({name: pa.array(c, kinds[kind]) for (name, kind), c in zip(fields, columns, strict=True)})


def _ask(block: pa.Table, shards: int, half: int, size: int) -> pa.Table:
    """A block's distinct n-grams and their counts, by language and shard."""
    texts, number, out = texts_of(block["text"]), block["block"][0].as_py(), []
    for lang, rows in _by_language(block["lang"].to_pylist()).items():
        found = [np.unique(open_grams([texts[k] for k in run])[0], return_counts=True) for run in _chunks(texts, rows)]
        keys, counts = _summed(*(np.concatenate(c) for c in zip(*found, strict=True)))
        shard = shard_of(keys, shards)
        order = np.argsort(shard, kind="stable")  # the keys of a shard stay in order
        ends = np.searchsorted(shard[order], np.arange(shards + 1))
        for x in np.flatnonzero(np.diff(ends)):
            mine = order[ends[x] : ends[x + 1]]
            out.append((number, number // half, lang, int(x), number % half // size, len(mine), _packed(np.diff(keys[mine], prepend=0)), _packed(counts[mine])))
    trim()
    return _rows(_ASKED, out)


class _Counts:
    """Rows of n-grams and counts."""

    def __init__(self, rows: pa.Table):
        self.fold, self.lang, n = (rows[c].to_pylist() for c in ("fold", "lang", "n"))
        self.grams = [np.cumsum(_unpacked(g, k)) for g, k in zip(rows["grams"].to_pylist(), n, strict=True)]
        self.counts = [_unpacked(c, k) for c, k in zip(rows["counts"].to_pylist(), n, strict=True)]

    def of(self, fold: int) -> dict[str | None, list[int]]:
        """The rows of each language."""
        rows = [k for k, f in enumerate(self.fold) if f == fold]
        return {lang: [rows[k] for k in own] for lang, own in _by_language([self.lang[k] for k in rows]).items()}

    def total(self, rows: list[int]) -> tuple[np.ndarray, np.ndarray]:
        none = np.zeros(0, np.int64)
        return _summed(np.concatenate([self.grams[k] for k in rows]), np.concatenate([self.counts[k] for k in rows])) if rows else (none, none)


def _merge(rows: pa.Table) -> pa.Table:
    """The counts of a shard's part added up, one row a fold and language."""
    own, out = _Counts(rows), []
    for fold in (0, 1):
        for lang, some in own.of(fold).items():
            keys, counts = own.total(some)
            out.append((fold, lang, rows["shard"][0].as_py(), rows["part"][0].as_py(), len(keys), _packed(np.diff(keys, prepend=0)), _packed(counts)))
    trim()
    return _rows(_SUMS, out)


def _pairs(rows: pa.Table) -> pa.Table:
    """A shard's bigrams, by their first symbol, each with the number of symbols before it: no other shard has these three symbols."""
    own, out = _Counts(rows), []
    for fold in (0, 1):
        mine = [k for some in own.of(fold).values() for k in some]
        if mine:
            triples = np.unique(np.concatenate([own.grams[k] for k in mine]) & _TRIPLE)
            pairs, counts = np.unique(triples & _PAIR, return_counts=True)
            edges = np.flatnonzero(np.diff(pairs >> BITS)) + 1
            for some, n in zip(np.split(pairs, edges), np.split(counts, edges), strict=True):
                out.append((fold, rows["shard"][0].as_py(), int(some[0] >> BITS), some & _SYMBOL, n))
    trim()
    return _rows(_PAIRS, out)


def _flat(rows: pa.Table, name: str) -> np.ndarray:
    return rows[name].combine_chunks().flatten().to_numpy(zero_copy_only=False)


def _pair_totals(rows: pa.Table) -> pa.Table:
    """The counts of all shards added up for one context: a row for each fold, empty where the fold lacks the context."""
    out = []
    for fold in (0, 1):
        some = rows.filter(pa.compute.equal(rows["fold"], fold))
        symbols, counts = _summed(_flat(some, "symbols").astype(np.int64), _flat(some, "counts")) if some.num_rows else (np.zeros(0, np.int64), np.zeros(0, np.int64))
        out.append((fold, rows["context"][0].as_py(), symbols, counts))
    return _rows(_TOTALS, out)


def _fit_low(rows: pa.Table) -> pa.Table:
    """The two lowest levels of a fold, a row a context; at most 4096 of these, of 4096 symbols each."""
    contexts = rows["context"].to_numpy()
    order = np.argsort(contexts)
    context = np.repeat(contexts, pa.compute.list_value_length(rows["counts"]).to_numpy())
    fitted = low_levels(context, _flat(rows, "symbols").astype(np.int64), _flat(rows, "counts"), contexts[order])
    return _rows(_LOW, [(rows["fold"][0].as_py(), int(c), *low) for c, low in zip(contexts[order], fitted, strict=True)])


def _give_low(pairs: pa.Table, low: pa.Table) -> pa.Table:
    """To each shard that holds bigrams of this context their probabilities in the other fold's model, as doubles in place of counts."""
    models = {r["fold"]: (np.array(r["symbols"], np.int64), np.array(r["probs"]), r["other"]) for r in low.to_pylist()}
    out = []
    for r in pairs.to_pylist():
        symbols, probs, other = models[1 - r["fold"]]
        wanted = np.array(r["symbols"], np.int64)
        at, seen = _find(symbols, wanted)
        p = np.where(seen, probs[at], other) if len(probs) else np.full(len(wanted), other)
        grams = (r["context"] << BITS) + wanted
        out.append((1 - r["fold"], None, r["shard"], 0, len(grams), _packed(np.diff(grams, prepend=0)), _packed(p.view(np.int64))))
    return _rows(_SUMS, out)


def _low_of(rows: pa.Table, fold: int) -> tuple[np.ndarray, np.ndarray]:
    """The sorted bigrams of a shard and their probabilities by the model of `fold`."""
    own = _Counts(rows)
    mine = [k for k, f in enumerate(own.fold) if f == fold]
    grams = np.concatenate([own.grams[k] for k in mine])
    order = np.argsort(grams)
    return grams[order], np.concatenate([own.counts[k] for k in mine]).view(np.float64)[order]


def _answer(asked: pa.Table, sums: pa.Table, prior: float) -> pa.Table:
    """Log probabilities of the n-grams that each block asked for, by the counts of the other fold."""
    low, sums = sums.filter(sums["low"]), sums.filter(pa.compute.invert(sums["low"]))
    own, models, logs = _Counts(asked), _Counts(sums), [b""] * asked.num_rows
    for fold in (0, 1):
        others, wanting = models.of(1 - fold), own.of(fold)
        pooled = OpenModel(*models.total([k for rows in others.values() for k in rows]), _low_of(low, 1 - fold)) if wanting else None
        for lang, rows in wanting.items():
            wanted = np.unique(np.concatenate([own.grams[k] for k in rows]))
            log = np.log(shrunk(pooled.prob(wanted), *models.total(others.get(lang, [])), wanted, prior))
            log = np.round(np.maximum(log, -32) * STEPS)  # two bytes hold a symbol's cost, which counts as 32 nats at most
            for k in rows:
                logs[k] = _packed(log[np.searchsorted(wanted, own.grams[k])], 2)
    trim()
    return pa.table({"block": asked["block"], "lang": asked["lang"], "shard": asked["shard"], "logs": pa.array(logs, pa.binary())})


def _score(block: pa.Table, answers: pa.Table, shards: int, names: list[str]) -> pa.Table:
    """Base counts and log perplexity of a block's documents."""
    texts = texts_of(block["text"])
    given = {(lang, x): logs for lang, x, logs in zip(*(answers[c].to_pylist() for c in ("lang", "shard", "logs")), strict=True)}
    score = np.zeros(len(texts))
    for lang, rows in _by_language(block["lang"].to_pylist()).items():
        keys = np.unique(np.concatenate([np.unique(open_grams([texts[k] for k in run])[0]) for run in _chunks(texts, rows)]))
        shard, log = shard_of(keys, shards), np.zeros(len(keys))
        for x in np.unique(shard):
            mine = np.flatnonzero(shard == x)
            log[mine] = _unpacked(given[lang, int(x)], len(mine), 2) / STEPS
        for run in _chunks(texts, rows):
            grams, n = open_grams([texts[k] for k in run])
            own, place = _distinct(grams)
            some = n > 0
            if some.any():
                score[np.array(run)[some]] = -np.add.reduceat(log[np.searchsorted(keys, own)][place], (np.cumsum(n) - n)[some])
    trim()
    base = [base_counts(t) for t in texts]
    out = {name: block[name] for name in names}
    out |= {name: pa.array([b[k] for b in base], pa.int64()) for k, name in enumerate(_COUNTS)}
    out["base_failed"] = pa.array([b[5] for b in base], pa.bool_())
    out["log_perplexity"] = pa.array(score / np.maximum([words_of(t) for t in texts], 1))
    out["size"] = pa.array([len(t).bit_length() for t in texts], pa.int32())
    return pa.table(out)


def _scored(docs: DataFrame, row: list[str], text: str, lang: str, with_text: bool, prior: float = PRIOR) -> DataFrame:
    """(row, lang, [text,] base counts, base_failed, log_perplexity, size) of each row of docs; `row` holds the columns asked for."""
    whole = quoted(text).cast("string")
    chars = docs.agg(F.sum(F.length(whole))).first()[0] or 0
    half = max(1, -(-chars // (2 * BLOCK)))
    shards, size = max(16, 2 * half), PART
    fold = F.pmod(F.xxhash64(F.coalesce(whole, F.lit(""))), F.lit(2)) * half
    within = F.pmod(F.xxhash64(whole, *(quoted(c).cast("string") for c in row if c != text), F.lit(7)), F.lit(half))
    rows = docs.select((fold + within).cast("int").alias("block"), whole.alias("text"), quoted(lang).cast("string").alias("lang"), F.struct(*map(quoted, row)).alias("row"))

    def ask(block: pa.Table) -> pa.Table:
        return _ask(block, shards, half, size)

    def answer(asked: pa.Table, sums: pa.Table) -> pa.Table:
        return _answer(asked, sums, prior)

    def score(block: pa.Table, answers: pa.Table) -> pa.Table:
        return _score(block, answers, shards, names)

    asked = rows.groupBy("block").applyInArrow(ask, _ASKED)  # with the columns of the cogroup below, so that both read one shuffle of the texts
    parts = left = -(-half // size)
    last = asked.groupBy("shard", "part")
    while left > 1:  # as many rounds as it takes to add up all parts, a bounded number at a time
        last = last.applyInArrow(_merge, _SUMS).withColumn("part", F.floor(F.col("part") / MERGED).cast("int")).groupBy("shard", "part")
        left = -(-left // MERGED)
    sums, pairs = last.applyInArrow(_merge, _SUMS), last.applyInArrow(_pairs, _PAIRS)  # both read one shuffle
    low = pairs.groupBy("context").applyInArrow(_pair_totals, _TOTALS).groupBy("fold").applyInArrow(_fit_low, _LOW)
    given = pairs.groupBy("context").cogroup(low.groupBy("context")).applyInArrow(_give_low, _SUMS)
    models = sums.withColumn("low", F.lit(False)).unionByName(given.withColumn("low", F.lit(True)))
    models = models.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    answered = asked.groupBy("shard", "part").cogroup(models.groupBy("shard", "part")).applyInArrow(answer, _ANSWERED)
    names = ["row", "lang", *(["text"] if with_text else [])]
    fields = [rows.schema[n] for n in names] + [T.StructField(n, T.LongType()) for n in _COUNTS]
    schema = T.StructType([*fields, T.StructField("base_failed", T.BooleanType()), T.StructField("log_perplexity", T.DoubleType()), T.StructField("size", T.IntegerType())])
    scored = rows.groupBy("block").cogroup(answered.groupBy("block")).applyInArrow(score, schema)
    return materialize(scored, "scored")


def bands_of(scored: DataFrame, width: float) -> DataFrame:
    """(lang, size, low, high) from the documents that pass the base rules; one row a language and length."""
    good = scored.where("not base_failed").select("lang", "size", F.round("log_perplexity", 3).alias("s"))
    middle = lambda c: F.percentile(c, F.lit(0.5))
    by_lang = good.groupBy("lang").agg(middle("s").alias("m1"), F.count("*").alias("n1"))
    by_size = good.groupBy("lang", "size").agg(middle("s").alias("m2"), F.count("*").alias("n2"))
    one = by_lang.select(F.col("lang").alias("l1"), "m1", "n1")
    two = by_size.select(F.col("lang").alias("l2"), F.col("size").alias("z2"), "m2", "n2")
    off = good.join(F.broadcast(one), F.col("lang").eqNullSafe(F.col("l1"))).join(F.broadcast(two), F.col("lang").eqNullSafe(F.col("l2")) & (F.col("size") == F.col("z2")))
    all_ = good.agg(middle("s").alias("m0")).join(F.broadcast(off.agg(middle(F.abs(F.col("s") - F.col("m1"))).alias("d0"))))  # one row each
    one = off.groupBy("l1", "m1", "n1").agg(middle(F.abs(F.col("s") - F.col("m1"))).alias("d1"))
    two = off.groupBy("l2", "z2", "m2", "n2").agg(middle(F.abs(F.col("s") - F.col("m2"))).alias("d2"))

    def toward(own: str, n: str, wider):
        return (F.col(own) * F.col(n) + wider * SHRINK) / (F.col(n) + SHRINK)

    centre, spread = (toward(x + "2", "n2", toward(x + "1", "n1", F.col(x + "0"))) for x in "md")
    reach = spread * (1.4826 * width) + 0.001  # scores are rounded to thousandths
    return two.join(one, F.col("l2").eqNullSafe(F.col("l1"))).join(F.broadcast(all_)).select(F.col("l2").alias("band_lang"), F.col("z2").alias("band_size"), (centre - reach).alias("low"), (centre + reach).alias("high"))


def _judged(scored: DataFrame, width: float) -> DataFrame:
    """scored plus `kept`; the bands are one row a language and length, whatever the number of documents."""
    bands = F.broadcast(bands_of(scored, width))
    rows = scored.join(bands, F.col("lang").eqNullSafe(F.col("band_lang")) & (F.col("size") == F.col("band_size")), "left")
    return rows.withColumn("kept", ~F.col("base_failed") & F.coalesce(F.col("log_perplexity").between(F.col("low"), F.col("high")), F.lit(False)))


def quality_rules(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", width: float = WIDTH) -> DataFrame:
    """Base counts, log perplexity and verdict, one row for each row of docs."""
    judged = _judged(_scored(docs, [doc_id], text, lang, False), width)
    return judged.select(F.col("row")[doc_id].cast("long").alias("doc_id"), *_COUNTS, "base_failed", "log_perplexity", "kept")


def filter_quality(docs: DataFrame, text: str = "text", lang: str = "lang", width: float = WIDTH) -> DataFrame:
    """The rows of docs that are kept, with all their columns."""
    row = [c for c in docs.columns if c != text]
    judged = _judged(_scored(docs, row, text, lang, True), width)
    return judged.where("kept").select(*(F.col("text").cast(docs.schema[text].dataType).alias(text) if c == text else F.col("row")[c].alias(c) for c in docs.columns))


def op7_quality_rules(spark, sf_dir: str) -> DataFrame:
    """All documents against the base rules and the perplexity bands of their language."""
    return quality_rules(table(spark, sf_dir, "documents"))
