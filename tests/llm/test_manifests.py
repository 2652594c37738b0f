"""Operators 11 to 13 against slow twins, with edge rows."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from voxelweave.llm import fingerprints, merkle, spelling
from voxelweave.session import Scratch

H = lambda s: hashlib.sha256(s.encode()).hexdigest()
ODD = "doc_id long, text string, lang string, source string, n_chars long, digest string, pos long, tree string"  # names that the operators use themselves


# --- op11 --------------------------------------------------------------------------------------------------


def _leaf(row) -> str:
    return H("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (row["doc_id"], row["source"], row["lang"], row["n_chars"], row["text"])))


def _climb(nodes: list[str], paths: list[list[tuple[str, str]]], owners: list[list[int]]) -> str:
    """The top of a level after another; every leaf below a node gets its siblings."""
    while len(nodes) > 1:
        up, over = [], []
        for a in range(0, len(nodes), 16):
            run = nodes[a : a + 16]
            for k in range(len(run)):
                for leaf in owners[a + k]:
                    paths[leaf].append(("".join(run[:k]), "".join(run[k + 1 :])))
            up.append(H("".join(run)))
            over.append([leaf for o in owners[a : a + 16] for leaf in o])
        nodes, owners = up, over
    return nodes[0]


def _slow_manifest(rows: list) -> list[tuple]:
    rows = sorted(rows, key=lambda r: (r["source"] is not None, (r["source"] or "").encode(), r["doc_id"] is not None, r["doc_id"] or 0, _leaf(r)))
    paths, subroots, owners = [[] for _ in rows], [], []
    for source in dict.fromkeys(r["source"] for r in rows):
        own = [i for i, r in enumerate(rows) if r["source"] == source]
        part = [[] for _ in own]
        subroots.append(_climb([_leaf(rows[i]) for i in own], part, [[k] for k in range(len(own))]))
        owners.append(own)
        for i, p in zip(own, part, strict=True):
            paths[i] = p
    sub = {i: s for s, own in zip(subroots, owners, strict=True) for i in own}
    root = _climb(list(subroots), paths, owners)
    out = []
    for i, r in enumerate(rows):
        at = _leaf(r)
        if r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0 and r["text"]:
            at = _leaf({**r.asDict(), "text": re.sub("[A-Z]", lambda m: m[0].lower(), r["text"])})
        for left, right in paths[i]:
            at = H(left + at + right)
        out.append((r["doc_id"], _leaf(r), sub[i], root, H("".join(a + b for a, b in paths[i])), at, at == root))
    return sorted(out, key=repr)


def _manifest(df) -> list[tuple]:
    tamper = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(False))
    return sorted((tuple(r) for r in merkle.Manifest(merkle.leaves(df, tamper)).proofs().collect()), key=repr)


def test_manifest_equals_a_slow_one(spark):
    """A tree of several blocks, small ones, and odd rows."""
    spread = random.Random(3)
    rows = [(i, f"Text {i} Àé", "en", spread.choice(["a", "a", "a", "b", "é", "z"]), 9, "x", 1, "y") for i in range(700)]
    rows += [(None, None, None, None, None, "x", 1, "y"), (5, "", "en", None, 0, "x", 1, "y"), (1000, "Alone", "fr", "lone", 5, "x", 1, "y"), (7, "Ties", "en", "a", 4, "x", 1, "y"), *[(1, "Copies", "en", "a", 6, "x", 1, "y")] * 3, (2000, "Long " * 50_000, "en", "b", 250_000, "x", 1, "y")]
    df = spark.createDataFrame(rows, ODD)
    assert _manifest(df) == _slow_manifest(df.collect())


def test_many_small_trees_and_one_leaf(spark):
    df = spark.createDataFrame([(i, "T", "en", f"s{i:03d}", 1) for i in range(300)], "doc_id long, text string, lang string, source string, n_chars long")
    assert _manifest(df) == _slow_manifest(df.collect())
    one = df.limit(1)
    got = merkle.Manifest(merkle.leaves(one)).proofs().first()
    assert got["leaf"] == got["subroot"] == got["root"] == got["folded_root"] and got["verified"] and got["proof"] == H("")


def test_whole_proofs_fold_and_an_empty_table_has_none(spark):
    df = spark.createDataFrame([(i, "T", "en", "s", 1) for i in range(40)], "doc_id long, text string, lang string, source string, n_chars long")
    for r in merkle.Manifest(merkle.leaves(df)).proofs(whole=True).collect():
        assert merkle.folded(r["leaf"], [(s["l"], s["r"]) for s in r["proof"]]) == r["root"]
    assert merkle.Manifest(merkle.leaves(df.limit(0))).proofs().count() == 0


# --- op12 --------------------------------------------------------------------------------------------------


def _slow_vector(text: str) -> list[int]:
    lanes = [0] * 256
    for paragraph in text.split("\n"):
        for piece in re.findall("[^.!?\n]*[.!?]+[ \t]*\n?|[^.!?\n]*\n", paragraph + "\n"):
            bits = bin(int(hashlib.sha256(piece.encode()).hexdigest(), 16))[2:].zfill(256)
            lanes = [v + (1 if b == "1" else -1) for v, b in zip(lanes, bits, strict=True)]
    return lanes


def _alike(a: list[int], b: list[int]) -> float:
    return max(0.0, 1 - sum((x - y) ** 2 for x, y in zip(a, b, strict=True)) / (sum(x * x for x in a) + sum(x * x for x in b)))


def test_edited_texts_equal_a_slow_twin(spark):
    texts = {k: f"One of {k}. Two of {k % 3}!\nThree of {k % 5}? four " * (1 + k % 4) for k in range(60)} | {100: "", 101: None, 102: "\n\n", 103: "é" * 7, 104: "No end", 105: "Long one. " * 30_000}
    df = spark.createDataFrame([(i, t, "en", "s", 0, "d", 1, "t") for i, t in texts.items()] + [(None, "No id. At all", "en", "s", 0, "d", 1, "t")], ODD)
    order = [*sorted(texts, reverse=True), None]
    texts = {k: t or "" for k, t in texts.items()} | {None: "No id. At all"}
    got = {r["doc_id"]: r for r in fingerprints.against_next(df).collect()}
    assert len(got) == len(order)
    slow = {k: _slow_vector(t) for k, t in texts.items()}
    for k, after in zip(order, [*order[1:], order[0]], strict=True):
        half = len(texts[k]) // 2
        new = texts[k][: len(texts[k]) - half] + texts[after][:half]
        v = _slow_vector(new)
        written = "".join(f"{x % 65536:04x}" for x in slow[k]), "".join(f"{x % 65536:04x}" for x in v)
        r = got[k]
        assert (r["n_chars"], r["edited_sha256"], r["fingerprint"], r["edited_fingerprint"]) == (len(texts[k]), H(new), *written)
        assert r["near_edited"] == pytest.approx(_alike(slow[k], v), abs=1e-12) and r["near_next"] == pytest.approx(_alike(slow[k], slow[after]), abs=1e-12)


def test_order_insertion_deletion_and_sums(spark):
    df = spark.createDataFrame([(1, "A one. Two\nB\nC"), (2, "C\nA one. Two\nB"), (3, "A one. Two\nC"), (4, "A one. Two\nB\nB\nC")], "doc_id long, text string")
    f = {r["doc_id"]: r["fingerprint"] for r in fingerprints.fingerprints(df).collect()}
    assert f[1] == f[2] and len({f[1], f[3], f[4]}) == 3
    rows = spark.createDataFrame([(1, f[1], [], ["B"]), (2, f[1], ["B"], None), (3, f[4], ["X"], ["X", "B", "B"])], "id long, fingerprint string, added array<string>, removed array<string>")
    assert {r["id"]: r["fingerprint"] for r in fingerprints.changed(rows).collect()} == {1: f[3], 2: f[4], 3: f[3]}
    whole = fingerprints.total(fingerprints.fingerprints(df)).first()["fingerprint"]
    assert whole == fingerprints.written(np.array(sum(map(np.array, map(_slow_vector, ["A one. Two\nB\nC", "C\nA one. Two\nB", "A one. Two\nC", "A one. Two\nB\nB\nC"])))) % 65536)


def test_one_row_no_row_and_repeated_rows(spark):
    df = spark.createDataFrame([(1, "Abc. Def")], "doc_id long, text string")
    r = fingerprints.against_next(df).first()
    assert r["near_next"] == 1.0 and r["edited_sha256"] == H("Abc.Abc.")
    assert fingerprints.against_next(df.limit(0)).count() == 0
    assert fingerprints.against_next(df.union(df).union(df)).where("near_next = 1").count() == 3


# --- op13 --------------------------------------------------------------------------------------------------


def _near(a: str, b: str) -> bool:
    cut = lambda w: {w[:k] + w[k + 1 :] for k in range(len(w))}
    if len(a) == len(b):
        return a != b and any(a[:k] == b[:k] and a[k + 1 :] == b[k + 1 :] for k in range(len(a)))
    return a in cut(b) or b in cut(a)


def _slow_variants(words: dict[str, int]) -> list[tuple]:
    near = {w: [v for v in words if _near(w, v)] for w in words}
    form = {}
    for w, n in words.items():
        best = min(near[w], key=lambda v: (-words[v], v), default=None)
        form[w] = best if best is not None and words[best] >= 5 * n else None
    out = []
    for w, n in words.items():
        root = w
        while form[root]:
            root = form[root]
        out.append((w, form[w], root, n, len(near[w]), words[form[w]] if form[w] else None))
    return sorted(out, key=repr)


def _some_words(seed: int, n: int) -> dict[str, int]:
    """Words of few letters, so that many are near each other."""
    r = random.Random(seed)
    made = {"".join(r.choice("abà") for _ in range(r.randint(6, 9))): r.choice([5, 6, 30, 40, 200, 1000]) for _ in range(n)}
    return made | {"aaaaaa": 5, "aaaaaaa": 25, "aaaaaaaa": 125, "aaaaaaaaa": 625, "zzzzzz": 7}


@pytest.mark.parametrize("group", [500, 3])
def test_variants_equal_all_pairs_with_and_without_hot_keys(spark, group):
    words = _some_words(1, 260)
    df = spark.createDataFrame(list(words.items()), "word string, n long")
    assert sorted((tuple(r) for r in spelling.variants(df, group=group).collect()), key=repr) == _slow_variants(words)


def test_words_of_texts_with_edges(spark):
    body = "Colour colour COLOUR ÀÉÿabc Élanéé éLANéé x1 colours"
    rows = [(i, body, "en", "s", 0, "d", 1, "t") for i in range(40)] + [(None, body, None, None, None, None, None, None), (77, None, "en", "s", 0, "d", 1, "t"), (78, "", "en", "s", 0, "d", 1, "t"), (79, "longer words " * 30_000, "en", "s", 0, "d", 1, "t"), (3, body, "en", "s", 0, "d", 1, "t")]
    words: Counter[str] = Counter()
    for r in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", r[1] or ""):
            run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'' if r[0] is None else r[0]}:{run}".encode())
            words[run[: h % len(run)] + run[h % len(run) + 1 :] if h % 199 == 0 else run] += 1
    words = {w: n for w, n in words.items() if len(w) >= 6 and n >= 5}
    df = spark.createDataFrame(rows, ODD)
    assert {r["word"]: r["n"] for r in spelling.vocabulary(df).collect()} == words
    assert sorted((tuple(r) for r in spelling.variants(spelling.vocabulary(df)).collect()), key=repr) == _slow_variants(words)
    assert spelling.variants(spelling.vocabulary(df.limit(0))).count() == 0


def test_no_key_deals_out_more_than_its_bound(spark):
    """A third of all words under one key: they meet by shorter keys, and no group stays large."""
    words = spark.createDataFrame([(f"qqq{a}{b}{c}", 5) for a in "abcdef" for b in "abcdef" for c in "abcdef"], "word string, n long")
    scratch = Scratch(spark, "test")
    assert spelling.near_words(words, scratch, group=20).count() == 216 * 15
    assert spark.read.parquet(f"{scratch.root}/hot").count() > 0
