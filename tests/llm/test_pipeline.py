"""The pipeline's stages one after another, against brute force, with edge rows."""

from __future__ import annotations

import random
from pathlib import Path

import corpus_pipeline
import public_tokenizers
import pyarrow.parquet as pq
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from voxelweave import session
from voxelweave.llm import quality_rules, toxicity

from tests.llm.test_text_operators import _classes, prose


def _documents(spark, docs_of, folder):
    rng = random.Random(21)
    texts = [prose(60, k) if k % 5 else prose(30, k) + " wretchgoon " + prose(30, k + 9) + " slimetwerp" for k in range(300)]
    texts += [prose(60, 7)] * 40 + [prose(60, 7) + " indeed"] * 3  # copies and near copies of a clean one
    texts += [" ".join("".join(chr(97 + rng.randrange(26)) for _ in range(6)) for _ in range(60)), "x " * 200, None, "", prose(5, 2), prose(9000, 4)]
    ids = [*range(len(texts) - 3), None, 5, 5]
    docs = docs_of(texts, ids).withColumn("key", F.lit("clash")).withColumn("row", F.lit(1))
    labels = spark.createDataFrame([(k, 1, int(k % 5 == 0)) for k in range(300)], "doc_id long, quality int, toxic int")
    docs.coalesce(2).write.parquet(f"{folder}/documents.parquet")
    labels.coalesce(1).write.parquet(f"{folder}/labels.parquet")
    return spark.read.parquet(f"{folder}/documents.parquet"), labels


def test_stages_and_run(spark, docs_of, tmp_path):
    docs, labels = _documents(spark, docs_of, tmp_path)
    rows = lambda df: sorted((str(r["doc_id"]), r["text"] or "") for r in df.collect())
    out, stages = [docs], dict(corpus_pipeline.STAGES)
    for name in list(stages)[:3]:
        out.append(session.materialize(stages[name](spark, out[-1], str(tmp_path)), "stage"))
        assert out[-1].columns == docs.columns
    judged = quality_rules.quality_rules(docs.withColumn("doc_id", F.monotonically_increasing_id())).where("kept").select("doc_id").collect()
    good = {r["doc_id"] for r in judged}
    assert rows(out[1]) == rows(docs.withColumn("n", F.monotonically_increasing_id()).where(F.col("n").isin(list(good))))
    scores = toxicity.score_toxicity(out[1], labels).collect()
    assert out[2].count() == sum(r["predicted"] == 0 for r in scores) and not any("wretchgoon" in t for _, t in rows(out[2]))
    texts = [r["text"] for r in out[2].orderBy(F.col("doc_id").asc_nulls_first(), "text").collect()]
    assert out[3].count() == len(set(_classes(texts)))
    assert sum(t == prose(60, 7) for _, t in rows(out[3])) == 1

    shared = Path(session.shared_folder(spark).removeprefix("file:")) / "voxelweave"
    before = set(shared.iterdir())
    packed = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert len(set(shared.iterdir()) - before) == 1  # the result: all that was written on the way is gone
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    lengths = sorted(len(library.encode(t, add_special_tokens=False).ids) + 1 for _, t in rows(out[3]))
    found, filled = {}, {}
    for r in packed:
        assert r["start"] >= 0 and r["offset"] + r["length"] <= 2048
        filled.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
        found[r["doc_id"]] = found.get(r["doc_id"], 0) + r["length"]
    assert sum(found.values()) == sum(lengths) and sum(r["piece"] == 0 for r in packed) == len(lengths)
    for places in filled.values():
        places.sort()
        assert all(a + n == b for (a, n), (b, _) in zip(places, places[1:], strict=False)) and places[0][0] == 0


def test_empty_documents(spark, docs_of, tmp_path):
    docs, _ = _documents(spark, docs_of, tmp_path)
    empty = str(tmp_path / "empty")
    docs.where("false").coalesce(1).write.parquet(f"{empty}/documents.parquet")
    spark.read.parquet(f"{tmp_path}/labels.parquet").where("false").coalesce(1).write.parquet(f"{empty}/labels.parquet")
    assert corpus_pipeline.run(spark, empty).count() == 0
    assert pq.read_table(f"{empty}/labels.parquet").num_rows == 0
