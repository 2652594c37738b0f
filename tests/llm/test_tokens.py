"""Ops 3, 5 and 6: token ids, their files and sequences, unigram pieces."""

from __future__ import annotations

import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers as P
import pytest
from tokenizers import Tokenizer, models

from voxelweave.llm import packing, token_files, unigram
from voxelweave.llm.tokens import Encoder, read_tokenizer

ODD = ["", None, " ", "\n", "a  b\n\n c", "  x ", "It's 12 3a ?? é\nb", "\x1fz a", "don't you'll\tx", "<|endoftext|> hi <|startoftext|>", "a<|EndOfText|>", "x <|endoftext|>y", "日本 語 ²x", "İSTANBUL ΟΔΟΣ", "a.. ,b '.x .., x_y_ 'Ll", "été. ß, ÀÉ- 1,000.5", "A.\n.B ,\n, y", "word " * 3000, "x" * 5000, "a\0b"]


@pytest.mark.parametrize(("name", "words"), [("byte_bpe_50k.json", False), ("word_bpe_49k.json", True)])
def test_encoder_equals_library(name, words):
    enc = Encoder(read_tokenizer(P.path(name)), words, most=50)
    rng = random.Random(1)
    texts = [t or "" for t in ODD] + ["".join(rng.choice("ab é,.'\n 1T-") for _ in range(rng.randrange(60))) for _ in range(400)]
    whole = Tokenizer.from_file(P.path(name)).encode_batch(texts, add_special_tokens=False)
    assert enc.ids(texts) == [np.array(e.ids, "<u4").tobytes() for e in whole]


def _ids(name, texts, end):
    t = Tokenizer.from_file(P.path(name))
    return [[*e.ids, end] for e in t.encode_batch([x or "" for x in texts], add_special_tokens=False)]


def _crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def test_token_files(spark, docs_of, tmp_path):
    ids = random.Random(2).sample(range(1000), len(ODD))
    docs = docs_of(ODD, ids)
    path = str(tmp_path / "t")
    token_files.write_token_files(docs, path, P.path("word_bpe_49k.json"), 1, parts=3)
    want, at = {}, 0
    for i, own in sorted(zip(ids, _ids("word_bpe_49k.json", ODD, 1), strict=True)):
        want[i] = (at, len(own), _crc(own))
        at += len(own)
    got = {r["doc_id"]: (r["start"], r["n_tokens"], r["ids_crc32"]) for r in token_files.token_digest(spark, path).collect()}
    assert got == want
    one = token_files.read_token_files(spark, path).where(f"doc_id = {ids[3]}")
    assert one.count() == 1 and "EqualTo(doc_id" in one._jdf.queryExecution().toString()
    token_files.write_token_files(docs.where("false"), str(tmp_path / "e"), P.path("word_bpe_49k.json"), 1)
    assert token_files.token_digest(spark, str(tmp_path / "e")).count() == 0


def test_token_files_repeated_and_null_ids(spark, docs_of, tmp_path):
    token_files.write_token_files(docs_of(["a b", "a b", "c", None], [5, 5, None, 5]), str(tmp_path / "t"), P.path("word_bpe_49k.json"), 1)
    rows = sorted((r["start"], r["n_tokens"]) for r in token_files.token_digest(spark, str(tmp_path / "t")).collect())
    assert [s for s, _ in rows] == [0, *np.cumsum([n for _, n in rows])[:-1]] and len(rows) == 4


def test_indexes_and_bloom_filters_skip_rows(spark, tmp_path):
    """An id beyond every row group's range, and an absent one within a range, are not read; a present one reads its row group."""
    docs = spark.range(0, 50_000, 2).selectExpr("id AS doc_id", "'a b' AS text")
    token_files.write_token_files(docs, str(tmp_path / "t"), P.path("word_bpe_49k.json"), 1, parts=1)

    def rows_read(i):
        df = token_files.read_token_files(spark, str(tmp_path / "t")).where(f"doc_id = {i}").select("doc_id", "n_tokens")
        found = len(df.collect())
        return found, df._jdf.queryExecution().executedPlan().collectLeaves().apply(0).metrics().apply("numOutputRows").value()

    assert rows_read(60_000) == (0, 0)
    assert rows_read(7) == (0, 0)  # between 6 and 8: only a Bloom filter knows that it isn't there
    found, read = rows_read(30_000)
    assert found == 1 and 0 < read <= 10_000


def test_packing_and_pieces_of_repeated_ids(spark, docs_of):
    docs = docs_of(["a b", "a b", None, "c " * 5000, "c " * 5000], [4, 4, None, 4, 4])
    rows = packing.pack(docs, P.path("byte_bpe_50k.json")).collect()
    whole = sorted(len(x) for x in _ids("byte_bpe_50k.json", ["a b", "a b", None, "c " * 5000, "c " * 5000], 0))
    assert sum(r["length"] for r in rows) == sum(whole) and sum(r["piece"] == 0 for r in rows) == 5
    places = sorted((r["sequence_id"], r["offset"], r["length"]) for r in rows)
    assert all(a != b or x + n == y for (a, x, n), (b, y, _) in zip(places, places[1:], strict=False))
    got = unigram.encode_digest(docs, unigram.Vocabulary.read(P.path("piece_bpe_32k.model"))).collect()
    assert len(got) == 5 and all(r["exact"] for r in got) and sorted(str(r["doc_id"]) for r in got) == ["4", "4", "4", "4", "None"]


def _check_plan(histogram, capacity=2048, **kw):
    patterns = packing.plan(histogram, capacity, **kw)
    held = Counter()
    for p, times in patterns:
        assert sum(p) <= capacity and times > 0
        for length in p:
            held[length] += times
    assert held == Counter({k: v for k, v in histogram.items() if v})
    return sum(t for _, t in patterns)


def test_plan_is_whole_and_near_the_bound():
    rng = np.random.default_rng(3)
    assert packing.plan({}) == [] and _check_plan({1: 5_000_000}) == -(-5_000_000 // 2048)
    for n in (1, 7, 300, 5000):
        h = Counter(rng.integers(1, 2049, n).tolist())
        used = _check_plan(h)
        large = sum(c for k, c in h.items() if k > 1024)
        least = max(-(-sum(k * c for k, c in h.items()) // 2048), large)
        assert used <= 1.03 * least + 3
    h = Counter(np.minimum(rng.geometric(1 / 500, 20_000), 2048).tolist())
    assert _check_plan(h) <= 1.01 * sum(k * c for k, c in h.items()) / 2048 + 1
    with pytest.raises(ValueError):
        packing.plan({3000: 1})


def test_plans_are_as_good_as_best_fit_and_made_by_configurations():
    """Lengths as texts have them: no more sequences than best fit alone, and those with several large documents come from configurations."""
    rng = np.random.default_rng(6)
    for n in (3000, 20_000):
        h = dict(Counter(np.clip(rng.lognormal(6, 1, n).astype(int), 1, 2048).tolist()))
        alone = packing.plan(h, cases=(1.0,))  # nothing is large
        assert _check_plan(h) <= sum(t for _, t in alone) + 1
        bins, big = defaultdict(Counter), sorted(((k, c) for k, c in h.items() if 2048 / 3 < k < 2048), reverse=True)
        left = packing._substitute(bins, big, 64, 2048)
        made = sum(t for by in bins.values() for p, t in by.items() if len(p) > 1)
        several = sum(t for p, t in packing._grouped_plan(h, 2048, 64, 1 / 3) if sum(k > 2048 / 3 for k in p) > 1)
        assert made >= 0.9 * several > 0 and sum(c for _, c in left) <= 64


def test_small_plans_against_best_possible():
    """Exhaustive search over small cases: at most one sequence more than the optimum."""

    def best(items, capacity):
        low = [len(items)]

        def go(k, rooms):
            if len(rooms) >= low[0]:
                return
            if k == len(items):
                low[0] = len(rooms)
                return
            for j in range(len(rooms)):
                if rooms[j] >= items[k] and rooms[j] not in rooms[:j]:
                    go(k + 1, [*rooms[:j], rooms[j] - items[k], *rooms[j + 1 :]])
            go(k + 1, [*rooms, capacity - items[k]])

        go(0, [])
        return low[0]

    rng = random.Random(5)
    for _ in range(40):
        items = sorted((rng.randint(1, 20) for _ in range(rng.randint(1, 9))), reverse=True)
        assert _check_plan(Counter(items), 20) <= best(items, 20) + 1


def test_pack(spark, docs_of):
    texts = [*ODD, "one two three " * 2500, *["same text here"] * 30]
    docs = docs_of(texts)
    rows = packing.pack(docs.repartition(3), P.path("byte_bpe_50k.json")).collect()
    own = _ids("byte_bpe_50k.json", texts, 0)
    by_doc, by_sequence = {}, {}
    for r in rows:
        by_doc.setdefault(r["doc_id"], []).append(r)
        by_sequence.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    assert sorted(by_doc) == list(range(len(texts)))
    for d, pieces in by_doc.items():
        pieces.sort(key=lambda r: r["piece"])
        at = 0
        for k, r in enumerate(pieces):
            assert (r["piece"], r["start"]) == (k, at) and (k == 0 or r["length"] == 2048)
            assert r["ids_crc32"] == _crc(own[d][at : at + r["length"]])
            at += r["length"]
        assert at == len(own[d]) and (len(pieces) == 1) == (at <= 2048)
    for places in by_sequence.values():
        places.sort()
        assert [o for o, _ in places] == [0, *np.cumsum([n for _, n in places])[:-1]] and sum(n for _, n in places) <= 2048
    assert packing.pack(docs.where("false"), P.path("byte_bpe_50k.json")).count() == 0


def test_unigram_equals_library_and_round_trips(spark, docs_of):
    vocabulary = unigram.Vocabulary.read(P.path("piece_bpe_32k.model"))
    trie = unigram.DoubleArray.build([(p.encode(), i) for p, i in vocabulary.pieces.items()])
    codec = unigram.Unigram(vocabulary, trie, most=40)
    library = Tokenizer(models.Unigram([(p, vocabulary.scores[i]) for p, i in vocabulary.pieces.items()]))
    ids = list(vocabulary.pieces.values())
    rng = random.Random(4)
    score = lambda x: sum(vocabulary.scores[i] for i in x)
    for _ in range(500):
        word = unigram.MARK + "".join(rng.choice("theinandsoqzx") for _ in range(rng.randrange(1, 14)))
        assert abs(score(codec.search(word)) - score([ids[k] for k in library.encode(word).ids])) < 1e-6
    texts = [*(t or "" for t in ODD), unigram.MARK + "a " + unigram.MARK, unigram.LITERAL + "x" + unigram.MARK, "😀 ퟿ a", "x" * 3000]
    for t in texts:
        assert codec.decode(codec.encode(t)) == t
    rows = unigram.encode_digest(docs_of([*texts, None]), vocabulary).collect()
    assert len(rows) == len(texts) + 1 and all(r["exact"] or r["n_pieces"] == 0 for r in rows)
    arrays = {r["doc_id"]: r["ids"] for r in unigram.encode(docs_of(texts), vocabulary).collect()}
    assert all(np.array(arrays[k], "<u4").tobytes() == codec.encode(t) for k, t in enumerate(texts))


def test_unigram_small_vocabulary_against_brute_force():
    pieces = [("▁", 0, -3.0), ("a", 1, -1.0), ("b", 2, -1.5), ("ab", 3, -1.8), ("▁a", 4, -2.5), ("ba", 5, -2.2), ("a▁b", 6, -1.0)]
    vocabulary = unigram.Vocabulary.of(pieces, list(range(100, 356)))
    codec = unigram.Unigram(vocabulary, unigram.DoubleArray.build([(p.encode(), i) for p, i, _ in pieces]))

    def best(text):
        if not text:
            return 0.0
        return max(s + best(text[len(p) :]) for p, _, s in pieces if text.startswith(p))

    assert codec.crossing
    rng = random.Random(6)
    for _ in range(200):
        text = "".join(rng.choice("ab▁") for _ in range(rng.randrange(1, 9)))
        assert abs(sum(vocabulary.scores[i] for i in codec.search(text)) - best(text)) < 1e-9
    assert codec.decode(codec.encode("ab zb a")) == "ab zb a"
