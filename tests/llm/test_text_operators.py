"""Ops 1, 4, 7, 8 and 10 against brute force on small tables, with nulls, empties, ties and clashing names."""

from __future__ import annotations

import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from voxelweave.llm import darts, near_dedup, quality_rules, sharding, site_quality, toxicity

RNG = random.Random(11)
WORDS = ["".join(RNG.choice("abcdefghilmnoprstu") for _ in range(RNG.randint(2, 8))) for _ in range(300)]


def prose(n, seed):
    rng = random.Random(seed)
    return " ".join(rng.choice(WORDS) for _ in range(n)) + "."


# --- 7 -----------------------------------------------------------------------------------------------------


def _slow_base(text):
    words = [w for w in __import__("re").findall(r"[^\x20\x09-\x0D]+", text)]
    windows = [tuple(words[k : k + 8]) for k in range(len(words) - 7)]
    tally = Counter(windows)
    covered = {k + j for k, w in enumerate(windows) if tally[w] > 1 for j in range(8)}
    lines = [x for x in text.split("\n") if x.strip(" \t\n\v\f\r")]
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered), len(words) < 20 or 100 * len(covered) > 30 * len(words)


def test_base_counts_against_slow_ones():
    rng = random.Random(1)
    texts = ["", " \n", "a\x1cb c\x85d\xa0e", "x " * 50, "a\nb\na\n\na\r\n", "日本 語# é|"] + [" ".join(rng.choice("abc") + rng.choice(["", "\n", "#", "\v"]) for _ in range(rng.randrange(80))) for _ in range(300)]
    for t in texts:
        assert quality_rules.base_counts(t) == _slow_base(t), repr(t)


def test_model_backs_off():
    texts = [prose(400, k) for k in range(5)]
    model = quality_rules.OpenModel(*np.unique(quality_rules.open_grams(texts)[0], return_counts=True))
    likely, unlikely = (np.log(model.prob(quality_rules.open_grams([t])[0])).mean() for t in (prose(100, 99), "zqxj kwvy zzkq xqjw"))
    assert likely > unlikely + 1


def test_grams_have_boundaries():
    one, n = quality_rules.open_grams(["ab", "", "c"])
    assert n.tolist() == [2, 0, 1] and one.tolist() == [*quality_rules.open_grams(["ab"])[0], *quality_rules.open_grams(["c"])[0]]


def test_quality_rules_table(spark, docs_of):
    rng = random.Random(4)
    noise = " ".join("".join(chr(97 + rng.randrange(26)) for _ in range(rng.randint(3, 9))) for _ in range(80))
    texts = [prose(60, k) for k in range(60)] + [noise, None, "", prose(60, 1), prose(5, 3)]
    docs = docs_of([(t, None if k == 3 else "en", "s") for k, t in enumerate(texts)]).withColumn("kept", F.lit("clash"))
    rows = {r["doc_id"]: r for r in quality_rules.quality_rules(docs.repartition(3)).collect()}
    assert len(rows) == len(texts)
    for k, t in enumerate(texts):
        r = rows[k]
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"]) == _slow_base(t or "")
    assert all(rows[k]["kept"] for k in range(60)) and rows[63]["kept"] and not any(rows[k]["kept"] for k in (60, 61, 62, 64))
    kept = quality_rules.filter_quality(docs)
    assert kept.columns == docs.columns and {r["doc_id"] for r in kept.collect()} == {k for k, r in rows.items() if r["kept"]}
    assert quality_rules.quality_rules(docs.where("false")).count() == 0


# --- 4 -----------------------------------------------------------------------------------------------------


def _labelled(spark, docs_of, n=400):
    texts = [prose(60, k) if k % 4 else prose(30, k) + " wretchgoon " + prose(30, k + 9) + " slimetwerp" for k in range(n)]
    labels = spark.createDataFrame([(k, int(k % 7 > 0), int(k % 4 == 0)) for k in range(n)], "doc_id long, quality int, toxic int")
    return docs_of(texts), labels


def test_toxicity_held_out(spark, docs_of):
    docs, labels = _labelled(spark, docs_of)
    rows = toxicity.score_toxicity(docs.repartition(2), labels).collect()
    assert len(rows) == 400 and all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in rows)
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in rows)
    out = [r for r in rows if r["held_out"]]
    assert np.mean([r["predicted"] == (r["doc_id"] % 4 == 0) for r in out]) > 0.95
    flipped = labels.withColumn("toxic", F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    assert sorted(toxicity.score_toxicity(docs, flipped).collect()) == sorted(rows)  # held-out labels are never read


def test_toxicity_odd_inputs(spark, docs_of):
    docs, labels = _labelled(spark, docs_of, 120)
    odd = docs.unionByName(docs_of([None, "", "a"], [1000, 1000, None])).withColumn("score", F.lit(1))
    assert toxicity.score_toxicity(odd, labels.unionByName(spark.createDataFrame([(None, None, None), (5, 1, None)], labels.schema))).count() == 123
    kept = toxicity.filter_toxic(odd, labels)
    assert kept.columns == odd.columns and kept.count() < 123
    assert all(r["score"] < 0.5 for r in toxicity.score_toxicity(docs, labels.where("false")).collect())
    assert toxicity.score_toxicity(docs.where("false"), labels).count() == 0


def test_risk_and_its_direction():
    """Against the definition, and the gradient against differences where the second term is positive; turned round where it isn't."""
    rng = np.random.default_rng(6)
    loss = lambda g: np.log1p(np.exp(g))
    for shift in (1.0, -6.0):
        gp, gu, prior, cap = rng.normal(3, 2, 30), rng.normal(shift, 2, 50), 0.2, 14.0
        value, dp, du = toxicity.nn_risk(gp, gu, prior, cap)
        second = np.mean([loss(min(g, cap)) for g in gu]) - prior * np.mean([loss(min(g, cap)) for g in gp])
        assert value == pytest.approx(prior * np.mean([loss(-g) for g in gp]) + max(0, second))
        turned = lambda p, u, over=second < 0: -(np.logaddexp(0, np.minimum(u, cap)).mean() - prior * np.logaddexp(0, np.minimum(p, cap)).mean()) if over else toxicity.nn_risk(p, u, prior, cap)[0]
        assert (second < 0) == (shift < 0)
        for k in range(5):
            e = np.eye(50)[k] * 1e-5
            assert du[k] == pytest.approx((turned(gp, gu + e) - turned(gp, gu - e)) / 2e-5, abs=1e-7)
            assert dp[k] == pytest.approx((turned(gp + e[:30], gu) - turned(gp - e[:30], gu)) / 2e-5, abs=1e-7)


def test_toxicity_repeated_ids_and_long_texts(spark, docs_of):
    """An id that a third of all rows share counts once in the fit; a passage at the end of a very long text counts."""
    docs, labels = _labelled(spark, docs_of, 200)
    model = toxicity.fit_toxicity(docs, labels)
    again = toxicity.fit_toxicity(docs.unionByName(docs.where("doc_id = 4").crossJoin(spark.range(100)).drop("id")), labels)
    assert (model.features == again.features).all() and np.allclose(model.weights, again.weights)
    end = docs_of([prose(30_000, 1), prose(30_000, 1) + " wretchgoon slimetwerp", None, None], [7000, 7001, 7002, 7002])
    got = {r["doc_id"]: r["score"] for r in toxicity.score_toxicity(docs.unionByName(end), labels).collect()}
    assert got[7000] < 0.5 < got[7001] and got[7002] < 0.5


# --- 1 -----------------------------------------------------------------------------------------------------


def test_site_quality(spark, docs_of):
    rng = random.Random(5)
    texts, good = [], []
    for k in range(400):
        site = f"s{k % 8}"
        g = rng.random() < (0.2 if site == "s0" else 0.9)
        good.append(int(g))
        texts.append((prose(60, k) if g else "spam! " * 20 + prose(5, k), "en", site))
    docs = docs_of([*texts, (None, None, None), ("", "en", "s1")]).withColumn("p", F.lit("clash"))
    labels = spark.createDataFrame([(k, g) for k, g in enumerate(good)], "doc_id long, quality int")
    rows = {r["doc_id"]: r for r in site_quality.site_quality(docs, labels, "source", "lang").collect()}
    assert len(rows) == 402
    assert np.mean([rows[k]["kept"] == bool(g) for k, g in enumerate(good) if rows[k]["held_out"]]) > 0.97
    host = lambda s: np.mean([rows[k]["host_posterior"] for k in range(400) if texts[k][2] == s])
    assert host("s0") < 0.5 < host("s1")
    assert all(0 <= r["score"] <= 1 for r in rows.values())
    assert site_quality.site_quality(docs.where("false"), labels, "source", "lang").count() == 0
    assert site_quality.site_quality(docs, labels.where("false"), "source", "lang").count() == 402


def test_posteriors_and_scores_against_slow_ones(spark, docs_of):
    """Few documents a path: posteriors lie between the path's own mean and its host's, nearer the host's the fewer there are."""
    rng = random.Random(15)
    texts = [(prose(30, k) if rng.random() < 0.7 else "spam! " * 20 + prose(5, k), f"p{rng.randrange(1 + h)}", f"h{h}") for k, h in enumerate(rng.randrange(12) for _ in range(240))]
    texts += [texts[0], texts[0], (prose(40_000, 3), None, "h1")]
    docs = docs_of(texts, [*range(240), 0, 0, 500])
    labels = spark.createDataFrame([(k, int("spam" not in texts[k][0])) for k in range(240)], "doc_id long, quality int")
    rows = site_quality.site_quality(docs, labels, "source", "lang").collect()
    assert len(rows) == 243
    p = [(r["host"], r["path"], r["p"]) for r in rows]
    mean = np.clip(np.mean([x for *_, x in p]), 1e-4, 1 - 1e-4)

    def strength(key):
        groups = {}
        for h, l, x in p:
            groups.setdefault(key(h, l), []).append(x)
        some = [np.array(g) for g in groups.values() if len(g) > 1]
        n, k = sum(map(len, some)), len(some)
        between, within = sum(len(g) * (g.mean() - mean) ** 2 for g in some), sum(((g - g.mean()) ** 2).sum() for g in some) / (n - k)
        return float(np.clip(within / max((between - (k - 1) * within) / n, 1e-9), 1, 10_000)), groups

    (kh, hosts), (kp, paths) = strength(lambda h, _: h), strength(lambda h, l: (h, l))
    logit = lambda x: np.log(x / (1 - x))
    for r in rows:
        h, own = hosts[r["host"]], paths[r["host"], r["path"]]
        host = (sum(h) - r["p"] + kh * mean) / (len(h) - 1 + kh)
        path = (sum(own) - r["p"] + kp * host) / (len(own) - 1 + kp)
        inside = lambda x: min(max(x, 1e-6), 1 - 1e-6)
        score = 1 / (1 + np.exp(-(logit(inside(path)) + logit(inside(r["p"])) - logit(mean))))
        assert r["host_posterior"] == pytest.approx(host) and r["path_posterior"] == pytest.approx(path) and r["score"] == pytest.approx(score)
        if len(own) > 1:
            others = (sum(own) - r["p"]) / (len(own) - 1)
            assert min(others, host) - 1e-9 <= r["path_posterior"] <= max(others, host) + 1e-9
            assert abs(r["path_posterior"] - host) <= abs(others - host) * (len(own) - 1) / (len(own) - 1 + kp) + 1e-9


def test_sparse_sites_shrink(spark):
    sites = spark.createDataFrame([(10.0, 9.0, 20), (18.0, 17.0, 20), (2.0, 1.9, 20)], "s double, q double, n long")
    noise = spark.createDataFrame([(10.0, 10.0, 20), (11.0, 11.0, 20), (9.0, 9.0, 20)], "s double, q double, n long")
    assert site_quality._strength(sites, 0.5) < site_quality._strength(noise, 0.5)


# --- 8 -----------------------------------------------------------------------------------------------------


def test_sharding(spark, docs_of):
    texts = [prose(RNG.randint(1, 60), k) for k in range(500)] + ["copy"] * 300 + [None, "", "é" * 5000]
    docs = docs_of(texts, [*range(800), 900, None, 900]).withColumn("size", F.lit("clash"))
    rows = sharding.assign_shards(docs.repartition(5), 16).collect()
    assert len(rows) == len(texts)
    total = sum(r["size"] for r in rows)
    assert total == sum(len((t or "").encode()) + 1 for t in texts)
    biggest = max(r["size"] for r in rows)
    for shard in range(16):
        own = sorted(r["slot"] for r in rows if r["shard"] == shard)
        assert own == list(range(len(own)))
        assert abs(sum(r["size"] for r in rows if r["shard"] == shard) - total / 16) <= biggest
    ordered = sorted(rows, key=lambda r: r["byte_start"])
    assert [r["shard"] for r in ordered] == sorted(r["shard"] for r in rows)
    assert [r["byte_start"] for r in ordered] == [0, *np.cumsum([r["size"] for r in ordered])[:-1]]
    assert {r["text_crc32"] for r in rows} == {zlib.crc32((t or "").encode()) for t in texts}
    assert sharding.assign_shards(docs.where("false")).count() == 0


# --- 10 ----------------------------------------------------------------------------------------------------


def test_darts_estimate_weighted_similarity():
    rng = np.random.default_rng(2)
    for weighted in (False, True):
        got, want = [], []
        for _ in range(40):
            e = rng.integers(0, 2**63, 200, dtype=np.uint64)
            w = rng.uniform(0.2, 6, 200) if weighted else np.ones(200)
            v = w * rng.choice([1, 1, 1, 0.5, 0] if weighted else [1, 1, 1, 0], 200)
            got.append((darts.signature(e, w) == darts.signature(e[v > 0], v[v > 0])).mean())
            want.append(np.minimum(w, v).sum() / np.maximum(w, v).sum())
        assert abs(np.mean(got) - np.mean(want)) < 0.02
    assert len(darts.signature(np.zeros(0, np.uint64))) == 0 and len(set(darts.signature(np.array([5], np.uint64)).tolist())) == 128


def _weights(text):
    """Windows of five words (of all words, if fewer) and how often each occurs."""
    words = (text or "").encode().split()
    size = min(5, len(words))
    return Counter(tuple(words[k : k + size]) for k in range(len(words) - size + 1)) if words else Counter()


def _classes(texts, weighted=True):
    sets = [_weights(t) if weighted else Counter(set(_weights(t))) for t in texts]
    root = list(range(len(texts)))

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    for a in range(len(texts)):
        for b in range(a):
            same = (texts[a] or "") == (texts[b] or "")
            if same or (sets[a] and sets[b] and (sets[a] & sets[b]).total() >= 0.8 * (sets[a] | sets[b]).total()):
                root[find(a)] = find(b)
    return [find(a) for a in range(len(texts))]


def _near_texts():
    rng = random.Random(8)
    texts = [None, "", "", "one two", "one two", "one three"]
    passage = prose(60, 77)
    for k in range(12):
        base = prose(120, 100 + k).split()
        for edits in (0, 0, 1, 2, 3, 4, 6):
            words = base.copy()
            for _ in range(edits):
                words[rng.randrange(len(words))] = "changed"
            texts.append(" ".join(words))
        texts.append(passage + " " + prose(50, 900 + k))
    line = prose(12, 55)
    for times in (1, 2, 10, 11, 12, 30):  # the same windows, more or less often: alike as sets, not all by weight
        texts.append(" ".join([line] * times))
    return [*texts, " ".join([prose(2000, 66)] * 8)]  # a very long text


def test_near_duplicates_against_brute_force(spark, docs_of):
    texts = _near_texts()
    clashes = ("signature", "key", "id", "row", "order", "head", "first", "__key", "__head", "__nth", "a.b")
    docs = docs_of(texts).select("*", *(F.concat(F.lit(c), F.col("doc_id")).alias(c) for c in clashes))
    rows = {r["doc_id"]: r for r in near_dedup.near_duplicates(docs.repartition(3)).collect()}
    want = _classes(texts)
    assert len(rows) == len(texts)
    first = {}
    for k, c in enumerate(want):
        first.setdefault(c, k)
    assert all(rows[k]["class_id"] == first[c] for k, c in enumerate(want))
    assert {k for k, r in rows.items() if r["kept"]} == set(first.values())
    kept = near_dedup.keep_one(docs)
    kept_rows = kept.collect()
    assert kept.columns == docs.columns and {r["doc_id"] for r in kept_rows} == set(first.values())
    assert all(r[c] == f"{c}{r['doc_id']}" for r in kept_rows for c in clashes)


def test_near_duplicates_by_sets(spark, docs_of):
    texts = _near_texts()
    rows = {r["doc_id"]: r["class_id"] for r in near_dedup.near_duplicates(docs_of(texts), weighted=False).collect()}
    want, weighted = _classes(texts, False), _classes(texts)
    assert len({(rows[k], c) for k, c in enumerate(want)}) == len(set(want)) == len(set(rows.values()))
    assert len(set(want)) < len(set(weighted))  # weights matter here


def test_near_duplicates_blocks_and_repeats(spark, docs_of, monkeypatch):
    texts = _near_texts()
    monkeypatch.setattr(near_dedup, "BLOCK", 3)
    docs = docs_of(texts)
    rows = {r["doc_id"]: r["class_id"] for r in near_dedup.near_duplicates(docs).collect()}
    want = _classes(texts)
    assert len({(rows[k], c) for k, c in enumerate(want)}) == len(set(want)) == len(set(rows.values()))
    doubled = docs.unionByName(docs)
    assert near_dedup.keep_one(doubled).count() == len(set(want)) and near_dedup.near_duplicates(doubled).count() == 2 * len(texts)
    assert near_dedup.near_duplicates(docs.where("false")).count() == 0 and near_dedup.keep_one(docs.where("false")).count() == 0


def _block(sets, band):
    """Rows of one block: all members are asked, and those outside the component of the first ask."""
    import pandas as pd

    signed = [(darts.signature(e, w) & np.uint64(0xFFFF)).astype(np.uint16).tobytes() for e, w in sets]
    rows = [(1, 0, 0, asks, k > 0, band, k, k, signed[k], e.tobytes(), w.astype(np.float32).tobytes()) for asks in (True, False) for k, (e, w) in enumerate(sets) if k > 0 or not asks]
    return pd.DataFrame(rows, columns=["bucket", "i", "j", "asks", "outside", "band", "node", "component", "signature", "elements", "weights"])


def test_links_in_block_find_every_component():
    """Variants that link only through their common source end in one component; each pair is looked at in the first band it shares."""
    base = np.arange(1, 101, dtype=np.uint64)
    sets = [base] + [np.sort(np.concatenate([np.delete(base, np.arange(7 * k, 7 * k + 7)), 1000 * (k + 1) + np.arange(7, dtype=np.uint64)]).astype(np.uint64)) for k in range(6)]
    sets = [(s, np.ones(len(s))) for s in sets]
    links = [near_dedup._links_in_block(_block(sets, band)) for band in range(near_dedup.BANDS)]
    pairs = {tuple(sorted(p)) for found in links for p in found.itertuples(index=False)}
    short = [np.frombuffer(r, np.uint16)[None] for r in _block(sets, 0)["signature"][-7:]]
    first = {}
    for a in range(7):
        for b in range(a):
            shared = np.flatnonzero((near_dedup._rows(short[a]) == near_dedup._rows(short[b])).all(2)[0])
            if len(shared):
                first[b, a] = shared[0]
    assert {p for p in first if 0 in p} <= pairs and pairs <= set(first)
    for band, found in enumerate(links):
        assert all(first[tuple(sorted(p))] == band for p in found.itertuples(index=False))


@pytest.mark.parametrize("n", [0, 1, 7])
def test_components_of_a_chain(spark, n):
    from voxelweave.llm.graph import components

    edges = spark.createDataFrame([(k, k + 1) for k in range(n)] + [(50, 50), (20, 21), (21, 20)], "a long, b long")
    got = {r["node"]: r["component"] for r in components(edges).collect()}
    assert got == {k: 0 for k in range(n + 1) if n} | {20: 20, 21: 20}
