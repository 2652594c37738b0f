from __future__ import annotations

import random
from collections import Counter, defaultdict

import numpy as np
import pytest

from voxelweave.llm import quality_rules


def words(letters, n=300, seed=3):
    rng = random.Random(seed)
    return ["".join(rng.choice(letters) for _ in range(rng.randint(2, 8))) for _ in range(n)]


def prose(vocabulary, n, seed):
    rng = random.Random(seed)
    return " ".join(rng.choice(vocabulary) for _ in range(n)) + "."


LATIN, GREEK, CYRILLIC = words("abcdefghilmnoprstu"), words("αβγδεζηθικλμνοπρ"), words("абвгдежзиклмнопр")


def kept(docs, **more):
    return {r["doc_id"]: r["kept"] for r in quality_rules.quality_rules(docs, **more).collect()}


def test_open_model_sums_to_one():
    grams, _ = quality_rules.open_grams([prose(CYRILLIC, 300, k) for k in range(3)])
    keys, counts = np.unique(grams, return_counts=True)
    model = quality_rules.OpenModel(keys, counts)
    for context in [int(keys[5] >> quality_rules.BITS), int(keys[-9] >> quality_rules.BITS), 77]:
        wanted = (context << quality_rules.BITS) + np.arange(1 << quality_rules.BITS)
        pooled = model.prob(wanted)
        assert pooled.sum() == pytest.approx(1)
        assert quality_rules.shrunk(pooled, keys, counts, wanted).sum() == pytest.approx(1)


@pytest.mark.parametrize("vocabulary", [GREEK, CYRILLIC])
def test_gibberish_of_any_script_goes(docs_of, vocabulary):
    rng = random.Random(8)
    letters = "".join(sorted(set("".join(vocabulary))))
    junk = " ".join("".join(rng.choice(letters) for _ in range(rng.randint(2, 8))) for _ in range(60))
    got = kept(docs_of([prose(vocabulary, 60, k) for k in range(60)] + [junk]))
    assert not got[60] and sum(got[k] for k in range(60)) >= 59


def test_marks_after_each_word_are_outside_the_band(docs_of):
    clean = [prose(LATIN, 60, k) for k in range(80)]
    junk = [prose(LATIN, 60, 100 + k).replace(" ", " | ") for k in range(4)] + [prose(LATIN, 60, 200 + k).replace(" ", "### ") for k in range(4)]
    got = kept(docs_of(clean + junk))
    assert sum(got[k] for k in range(80)) >= 79 and not any(got[k] for k in range(80, 88))


def test_small_language_has_its_own_model_and_band(docs_of):
    small = words("abcdefghilmnoprstu", seed=9)  # the same letters, other words
    texts = [(prose(LATIN, 60, k), "en", "s") for k in range(1400)] + [(prose(small, 60, k), "xx", "s") for k in range(25)] + [(prose(LATIN, 60, 5000 + k), "yy", "s") for k in range(12)]
    got = kept(docs_of(texts))
    assert sum(got[k] for k in range(1400, 1425)) >= 24 and sum(got[k] for k in range(1425, 1437)) >= 11


def test_packed_numbers_come_back():
    for values in ([], [0], [1, 5, 2**59, 7, -3]):
        x = np.array(values, np.int64)
        assert (quality_rules._unpacked(quality_rules._packed(x), len(x)) == x).all()


def test_blocks_do_not_change_the_scores(docs_of, monkeypatch):
    docs = docs_of([prose(LATIN, 60, k) for k in range(40)] + [None, "", prose(CYRILLIC, 30, 1)])
    one = {r["doc_id"]: r["log_perplexity"] for r in quality_rules.quality_rules(docs).collect()}
    monkeypatch.setattr(quality_rules, "BLOCK", 2000)
    monkeypatch.setattr(quality_rules, "MERGED", 2)  # several rounds of adding up
    monkeypatch.setattr(quality_rules, "PART", 1)
    many = {r["doc_id"]: r["log_perplexity"] for r in quality_rules.quality_rules(docs.repartition(3)).collect()}
    assert len(one) == len(many) == 43 and all(abs(one[k] - many[k]) < 1e-4 for k in one)


def _grams(text):
    """The 5-gram that ends at each character."""
    s = [int(x) for x in quality_rules.symbols_of("\n" * 4 + text)]
    return [tuple(s[k - 4 : k + 1]) for k in range(4, len(s))]


def _slow_model(fives, everything=None):
    """Interpolated modified Kneser-Ney of orders 5 to 1, from the definition: raw counts at order 5, continuation counts below.

    Orders 2 and 1 are those of `everything`, where these n-grams are a part of it.
    """
    counts = {5: dict(Counter(fives))}
    for order in (4, 3, 2, 1):
        counts[order] = {}
        if order == 2 and everything is not None:
            triples = {g[-3:] for g in everything}
            counts[2] = dict(Counter(g[1:] for g in triples))
            continue
        for g in counts[order + 1]:
            counts[order][g[1:]] = counts[order].get(g[1:], 0) + 1

    def discounts(c):
        n = [0, *(sum(v == k for v in c.values()) for k in (1, 2, 3, 4))]
        if min(n[1:]) == 0:
            return [0, 0.5, 0.75, 0.9]
        y = n[1] / (n[1] + 2 * n[2])
        return [0, *(min(max(k - (k + 1) * y * n[k + 1] / n[k], 0.05), k - 0.05) for k in (1, 2, 3))]

    d = {o: discounts(c) for o, c in counts.items()}

    def prob(g, order):
        if order < 1:
            return 1 / 4096
        tail = g[-order:]
        follow = {h: c for h, c in counts[order].items() if h[:-1] == tail[:-1]}
        if not follow:
            return prob(g, order - 1)
        total, own = sum(follow.values()), counts[order].get(tail, 0)
        gamma = sum(d[order][min(c, 3)] for c in follow.values()) / total
        return (own - d[order][min(own, 3)]) / total + gamma * prob(g, order - 1)

    return lambda g: prob(g, 5)


def test_open_model_against_a_slow_one():
    texts = [prose(LATIN[:12], 25, k) for k in range(4)] + [prose(GREEK[:9], 12, 8), "日本 a"]
    grams, _ = quality_rules.open_grams(texts)
    keys, counts = np.unique(grams, return_counts=True)
    assert {1, 2, 3} <= set(counts.tolist())  # so that each of the three discounts is used
    model, slow = quality_rules.OpenModel(keys, counts), _slow_model([g for t in texts for g in _grams(t)])
    wanted = np.unique(np.concatenate([keys[::7], quality_rules.open_grams([prose(LATIN[:12], 6, 99) + "zq日ж"])[0]]))
    unpack = lambda g: tuple((int(g) >> (12 * k)) & 4095 for k in range(4, -1, -1))
    assert np.allclose(model.prob(wanted), [slow(unpack(g)) for g in wanted], rtol=1e-9)


def _slow_bands(good, width):
    """(low, high) of each (language, size) of documents (language, size, score) that pass the base rules."""
    middle = lambda v: float(np.percentile(v, 50))
    shrink = lambda own, n, wider: (own * n + wider * quality_rules.SHRINK) / (n + quality_rules.SHRINK)
    m1 = {g: middle([v for lang, _, v in good if lang == g]) for g in {lang for lang, _, _ in good}}
    m0, d0 = middle([v for _, _, v in good]), middle([abs(v - m1[lang]) for lang, _, v in good])
    out = {}
    for lang, size in {x[:2] for x in good}:
        one, two = [x[2] for x in good if x[0] == lang], [x[2] for x in good if x[:2] == (lang, size)]
        d1, m2 = middle([abs(v - m1[lang]) for v in one]), middle(two)
        d2 = middle([abs(v - m2) for v in two])
        centre, spread = shrink(m2, len(two), shrink(m1[lang], len(one), m0)), shrink(d2, len(two), shrink(d1, len(one), d0))
        out[lang, size] = centre - width * 1.4826 * spread - 0.001, centre + width * 1.4826 * spread + 0.001
    return out


def test_bands_against_slow_ones(spark):
    rng = random.Random(3)
    rows = [(lang, size, rng.random() < 0.1, round(rng.gauss(3, 0.4) + (lang == "b"), 3)) for lang, n in (("a", 90), ("b", 25), (None, 4)) for size in (6, 7) for _ in range(n)]
    scored = spark.createDataFrame(rows, "lang string, size int, base_failed boolean, log_perplexity double")
    want = _slow_bands([(lang, size, v) for lang, size, failed, v in rows if not failed], 4.0)
    got = quality_rules.bands_of(scored, 4.0).collect()
    assert len(got) == len(want)
    for r in got:
        assert np.allclose((r["low"], r["high"]), want[r["band_lang"], r["band_size"]], atol=1e-9)


def test_scores_and_verdicts_of_documents_against_slow_ones(docs_of, spark):
    """log_perplexity and kept, through folds, shards, thousandths and words, from the definitions."""
    rng = random.Random(5)
    letters = "".join(sorted(set("".join(LATIN))))
    junk = [" ".join("".join(rng.choice(letters) for _ in range(6)) for _ in range(30)) for _ in range(3)]
    texts = [(prose(LATIN[:40], 30 + k % 9, k), "en", "s") for k in range(30)] + [(prose(GREEK[:30], 30, 50 + k), "el" if k < 8 else None, "s") for k in range(12)] + [(j, "en", "s") for j in junk]
    texts += [(texts[3][0], "en", "s"), ("few words", "en", "s"), ("日本 " * 25, "ja", "s"), (" ".join(["word"] * 40), "en", "s")]
    docs = docs_of(texts)
    fold = {r[0]: r[1] for r in docs.selectExpr("doc_id", "pmod(xxhash64(text), 2)").collect()}
    key = lambda g: sum(x << (12 * (4 - k)) for k, x in enumerate(g))
    by: dict = defaultdict(list)  # of a fold and shard, by language
    shard = {}
    for k, (t, lang, _) in enumerate(texts):
        for g in _grams(t):
            if g not in shard:
                shard[g] = int(quality_rules.shard_of(np.array([key(g)]), 16)[0])
            by[fold[k], shard[g], lang].append(g)
    langs = {lang for _, lang, _ in texts}
    pooled, own, memo = {}, {}, {}
    for f in (0, 1):
        for s in range(16):
            pooled[f, s] = _slow_model([g for lang in langs for g in by[f, s, lang]], [g for k, (t, _, _) in enumerate(texts) if fold[k] == f for g in _grams(t)])
            for lang in langs:
                own[f, s, lang] = Counter(by[f, s, lang]), Counter(g[:4] for g in by[f, s, lang])
    scores, good = {}, []
    for k, (t, lang, _) in enumerate(texts):
        cost = 0.0
        for g in _grams(t):
            at = 1 - fold[k], shard[g]
            if (at, g) not in memo:
                memo[at, g] = pooled[at](g)
            counts, contexts = own[*at, lang]
            p = (counts[g] + quality_rules.PRIOR * memo[at, g]) / (contexts[g[:4]] + quality_rules.PRIOR)
            cost -= round(max(np.log(p), -32) * 1000) / 1000
        scores[k] = cost / max(1, quality_rules.words_of(t))
        if not quality_rules.base_counts(t)[5]:
            good.append((lang, len(t).bit_length(), round(scores[k], 3)))
    bands = _slow_bands(good, quality_rules.WIDTH)
    got = {r["doc_id"]: r for r in quality_rules.quality_rules(docs).collect()}
    assert len(got) == len(texts)
    for k, (t, lang, _) in enumerate(texts):
        assert abs(got[k]["log_perplexity"] - scores[k]) < 1e-3 * len(t) / 100 + 1e-6  # a thousandth that rounds the other way
        low, high = bands.get((lang, len(t).bit_length()), (0, 0))
        if abs(scores[k] - low) > 0.01 and abs(scores[k] - high) > 0.01:
            assert got[k]["kept"] == (not got[k]["base_failed"] and low <= scores[k] <= high)
    assert sum(got[k]["kept"] for k in range(42)) >= 40 and not any(got[k]["kept"] for k in (42, 43, 44))
