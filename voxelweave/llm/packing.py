"""Operator 3: packing documents into fixed-length token sequences by linear grouping.

Only documents longer than a sequence are cut: the first piece takes what is left over a multiple of the
capacity, all later pieces fill a sequence each. What is to be packed then is a multiset of lengths below the
capacity, at most `capacity` distinct values whatever the number of documents. The packing is planned on that
histogram:

1. large lengths are split into groups of equal cardinality, each rounded up to its group's longest member;
2. few-size configurations (multisets of rounded lengths that fit) are optimised by column generation: a linear
   programme over the configurations, whose duals price new ones by a knapsack, rounded down to whole numbers;
3. actual documents are substituted: a place takes the longest document left that still leaves the configuration's other
   places their rounded lengths, so what rounding gave away in one place is used by the next;
4. small documents go to the fullest sequence that still holds them (best fit), longest first; the few large ones
   that whole-number configurations left over are placed in the same way, before the small ones.

What counts as large is a short list of cases (`CASES`): a plan is made for each and the one with fewest sequences is
taken. All large documents but those few are placed by configurations, and with them nearly all sequences that hold
several of them.

The plan is a short list of (pattern, times). Its places for each length are numbered, and a document takes the
place with its own number among the documents of that length. These numbers come from counts per partition and
length, so no length, however common, gathers its documents in one task.

Defined results: null and empty texts have id 0 alone; an empty table gives no rows; rows with equal ids or
texts are packed as rows of their own; extra columns are not read.
"""

from __future__ import annotations

import heapq
from bisect import bisect_right
from collections import Counter, defaultdict
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from voxelweave.llm.common import batches, crc32_of, table, texts_of
from voxelweave.llm.tokens import encoder, read_tokenizer
from voxelweave.session import materialize

CAPACITY = 2048
#: Shares of the capacity above which a length is large.
CASES = (0.25, 1 / 3, 0.4)
_PIECE = T.StructType(
    [T.StructField("doc_id", T.LongType()), T.StructField("piece", T.IntegerType()), T.StructField("start", T.LongType()), T.StructField("length", T.LongType()), T.StructField("ids_crc32", T.LongType()), T.StructField("part", T.IntegerType()), T.StructField("nth", T.LongType())]
)
_PACKED = T.StructType([*_PIECE.fields[:5], T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])


# --- the plan: histogram of lengths -> patterns ------------------------------------------------------------

Pattern = tuple[int, ...]


def _groups(lengths: list[tuple[int, int]], groups: int) -> list[tuple[int, list[tuple[int, int]]]]:
    """Descending (length, count) into groups of equal cardinality: (rounded length, its members). Lengths may be split between groups."""
    total = sum(c for _, c in lengths)
    size = -(-total // groups)
    out, members, room = [], [], size
    for length, count in lengths:
        while count:
            take = min(count, room)
            members.append((length, take))
            count, room = count - take, room - take
            if not room:
                out.append((members[0][0], members))
                members, room = [], size
    if members:
        out.append((members[0][0], members))
    return out


def _best_knapsack(sizes: np.ndarray, prices: np.ndarray, capacity: int) -> tuple[float, list[int]]:
    """The most valuable multiset of sizes within capacity (unbounded knapsack), as counts per size."""
    value = np.zeros(capacity + 1)
    last = np.full(capacity + 1, -1)
    order = [int(k) for k in np.argsort(sizes) if prices[k] > 1e-12]
    if order:
        small = np.array(order)
        for room in range(int(sizes[order[0]]), capacity + 1):
            fit = small[sizes[small] <= room]
            gains = value[room - sizes[fit]] + prices[fit]
            best = int(np.argmax(gains))
            value[room], last[room] = value[room - 1], -2
            if gains[best] > value[room] + 1e-12:
                value[room], last[room] = gains[best], fit[best]
    counts, room = [0] * len(sizes), capacity
    while room > 0 and last[room] != -1:
        if last[room] == -2:
            room -= 1
        else:
            counts[last[room]] += 1
            room -= int(sizes[last[room]])
    return float(value[capacity]), counts


def _configurations(sizes: list[int], demand: list[int], capacity: int, rounds: int = 60) -> list[tuple[list[int], int]]:
    """Whole-number multiples of few-size configurations that cover at most the demand, by column generation with a dual-ascent simplex."""
    m = len(sizes)
    s, d = np.array(sizes), np.array(demand, float)
    columns = [[capacity // size if k == j else 0 for k in range(m)] for j, size in enumerate(sizes)]
    basis = np.array(columns, float).T  # one column a size: an invertible start
    kept, x = [list(c) for c in columns], d / np.diag(basis)
    for _ in range(rounds * 4):
        prices = np.linalg.solve(basis.T, np.ones(m))
        value, counts = _best_knapsack(s, np.maximum(prices, 0), capacity)
        if value <= 1 + 1e-7:
            break
        direction = np.linalg.solve(basis, np.array(counts, float))
        ratios = np.where(direction > 1e-9, x / np.where(direction > 1e-9, direction, 1), np.inf)
        out = int(np.argmin(ratios))
        step = ratios[out]
        x = np.maximum(x - step * direction, 0)
        x[out] = step
        basis[:, out], kept[out] = counts, counts
    left = np.array(demand)
    result = []
    for k in np.argsort(-x):
        column = np.array(kept[k])
        used = column > 0
        times = int(min(np.floor(x[k] + 1e-9), (left[used] // column[used]).min())) if used.any() else 0
        if times > 0:
            left = left - times * column
            result.append((kept[k], times))
    return result


def plan(histogram: dict[int, int], capacity: int = CAPACITY, groups: int = 64, cases: tuple[float, ...] = CASES) -> list[tuple[Pattern, int]]:
    """(pattern, times) pairs that hold exactly the lengths of the histogram; a pattern's lengths sum to capacity at most.

    Of the plans for the cases the one with fewest sequences.
    """
    if any(length < 1 or length > capacity for length in histogram):
        raise ValueError("lengths must be between 1 and the capacity")
    plans = [_grouped_plan(histogram, capacity, groups, large) for large in cases]
    return min(plans, key=lambda p: sum(times for _, times in p))


def _grouped_plan(histogram: dict[int, int], capacity: int, groups: int, large: float) -> list[tuple[Pattern, int]]:
    done = [((capacity,), histogram[capacity])] if histogram.get(capacity) else []
    rest = sorted(((k, c) for k, c in histogram.items() if k < capacity and c), reverse=True)
    big, small = [x for x in rest if x[0] > capacity * large], [x for x in rest if x[0] <= capacity * large]
    bins: dict[int, dict[Pattern, int]] = defaultdict(Counter)  # room -> pattern -> times
    left = _substitute(bins, big, groups, capacity) if big else []
    for length, count in left + small:
        _best_fit(bins, length, count, capacity)
    return done + [(p, t) for by in bins.values() for p, t in by.items()]


def _substitute(bins: dict[int, dict[Pattern, int]], big: list[tuple[int, int]], groups: int, capacity: int) -> list[tuple[int, int]]:
    """Fills bins with large lengths by configurations of rounded ones; returns what these leave over, longest first."""
    rounded: Counter[int] = Counter()
    for size, members in _groups(big, groups):
        rounded[size] += sum(c for _, c in members)
    sizes = sorted(rounded, reverse=True)
    stock = dict(big)
    lengths = sorted(stock)
    for counts, times in _configurations(sizes, [rounded[z] for z in sizes], capacity):
        slots = [z for z, n in zip(sizes, counts, strict=True) for _ in range(n)]
        while times:  # as many sequences of the same actual lengths at once as the stock has
            take: list[int] = []
            drawn: Counter[int] = Counter()
            spare = capacity - sum(slots)
            for z in slots:
                k = bisect_right(lengths, z + spare) - 1
                while k >= 0 and stock[lengths[k]] <= drawn[lengths[k]]:
                    k -= 1
                if k >= 0:
                    drawn[lengths[k]] += 1
                    take.append(lengths[k])
                spare += z - (lengths[k] if k >= 0 else 0)
            if not take:
                break
            run = min(times, *(stock[length] // n for length, n in drawn.items()))
            for length, n in drawn.items():
                stock[length] -= n * run
                if not stock[length]:
                    lengths.remove(length)
            bins[capacity - sum(take)][tuple(take)] += run
            times -= run
    return [(length, stock[length]) for length in reversed(lengths)]


def _best_fit(bins: dict[int, dict[Pattern, int]], length: int, count: int, capacity: int) -> None:
    rooms = [r for r in bins if r >= length and bins[r]]
    heapq.heapify(rooms)
    while count:
        if not rooms:
            each = capacity // length
            full, over = divmod(count, each)
            if full:
                bins[capacity - each * length][(length,) * each] += full
            if over:
                bins[capacity - over * length][(length,) * over] += 1
            return
        room = heapq.heappop(rooms)
        each = room // length
        for pattern in list(bins[room]):
            times = bins[room].pop(pattern)
            full = min(times, count // each)
            if full:
                bins[room - each * length][pattern + (length,) * each] += full
                times, count = times - full, count - full * each
            if times and count:  # fewer than one bin takes
                bins[room - count * length][pattern + (length,) * count] += 1
                times, count = times - 1, 0
            if times:
                bins[room][pattern] += times
            if not count:
                break


# --- documents -> pieces -> places -------------------------------------------------------------------------


def _pieces(source: Iterator[pa.RecordBatch], tokenizer, words: bool, end_id: int, capacity: int) -> Iterator[pa.RecordBatch]:
    enc, end, part = encoder(tokenizer.value, words), np.array([end_id], "<u4").tobytes(), TaskContext.get().partitionId()
    seen: Counter[int] = Counter()
    for batch in batches(source):
        rows = []
        for doc, ids in zip(batch.column(0).to_pylist(), enc.ids(texts_of(batch.column(1))), strict=True):
            ids += end
            n = len(ids) // 4
            at, piece, length = 0, 0, n % capacity or capacity
            while at < n:
                rows.append((doc, piece, at, length, crc32_of(ids[4 * at : 4 * (at + length)]), part, seen[length]))
                seen[length] += 1
                at, piece, length = at + length, piece + 1, capacity
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64()), strict=True)], names=_PIECE.names)


def _places(patterns: list[tuple[Pattern, int]]) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each length: first number of each run of places, the run's first sequence, and its offset."""
    runs: dict[int, list[tuple[int, int, int]]] = defaultdict(list)
    filled: Counter[int] = Counter()
    sequence = 0
    for pattern, times in patterns:
        offset = 0
        for length in pattern:
            runs[length].append((filled[length], sequence, offset))
            filled[length] += times
            offset += length
        sequence += times
    return {k: tuple(np.array(c, np.int64) for c in zip(*v, strict=True)) for k, v in runs.items()}


def _seat(source: Iterator[pa.RecordBatch], places) -> Iterator[pa.RecordBatch]:
    for batch in source:
        length, number = (batch.column(k).to_numpy(zero_copy_only=False) for k in (3, 5))
        sequence, offset = np.zeros(len(length), np.int64), np.zeros(len(length), np.int64)
        for n in np.unique(length):
            at = np.flatnonzero(length == n)
            first, start, where = places.value[int(n)]
            run = np.searchsorted(first, number[at], "right") - 1
            sequence[at] = start[run] + number[at] - first[run]
            offset[at] = where[run]
        yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(sequence), pa.array(offset)], names=_PACKED.names)


def pack(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, end_id: int = 0, words: bool = False, groups: int = 64, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row a piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    context = docs.sparkSession.sparkContext
    tokenizer = context.broadcast(read_tokenizer(tokenizer_path))
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    pieces = materialize(rows.mapInArrow(partial(_pieces, tokenizer=tokenizer, words=words, end_id=end_id, capacity=capacity), _PIECE), "pieces")
    counts = pieces.groupBy("part", "length").agg(F.count("*").alias("n"))
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = counts.select("part", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most `capacity` rows
    places = context.broadcast(_places(plan(histogram, capacity, groups)))  # a few runs a length, whatever the number of documents
    numbered = pieces.join(bases, ["part", "length"]).select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("base") + F.col("nth")).alias("number"))
    return numbered.mapInArrow(partial(_seat, places=places), _PACKED)


def op3_packing(spark, sf_dir: str) -> DataFrame:
    """All documents in sequences of 2048 ids of byte_bpe_50k.json, each document ended by id 0."""
    import public_tokenizers

    return pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
