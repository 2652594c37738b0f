"""How op4's and op7's settings were chosen: python -m voxelweave.llm.selection toxicity|quality SF_DIR

Both look only at labels of documents whose crc32(doc_id as text) mod 5 is not 0. Toxicity: four-fold cross-validation
by that remainder, one setting varied at a time, the greatest mean F1 (then the least log loss) taken. Quality: bands
need no labels, so settings are compared on those rows at once, by the number of good documents rejected and bad ones
kept. With --held-out, the other fifth is scored once, by the settings as they stand in the code.
A tool for small tables: the labelled rows come to the driver.
"""

from __future__ import annotations

import argparse
import zlib

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxelweave.llm import quality_rules, toxicity
from voxelweave.llm.common import held_out
from voxelweave.session import local_session

TOXICITY = {"sure": (6.0, 12.0, 24.0), "cap": (8.0, 14.0, 30.0), "steps": (300, 600, 1200)}
QUALITY = {"PRIOR": (4, 8, 16), "width": (3.0, 4.0, 5.0, 6.0, 8.0, 10.0)}


def scores_of(predicted: np.ndarray, actual: np.ndarray) -> dict[str, float]:
    """precision, recall, F1 and log loss of probabilities."""
    said, p = predicted >= 0.5, np.clip(predicted, 1e-6, 1 - 1e-6)
    hit = float((said & (actual == 1)).sum())
    precision, recall = hit / max(said.sum(), 1), hit / max((actual == 1).sum(), 1)
    return {"precision": precision, "recall": recall, "f1": 2 * precision * recall / max(precision + recall, 1e-9), "log_loss": float(-np.mean(np.where(actual == 1, np.log(p), np.log(1 - p))))}


def select_toxicity(docs: DataFrame, labels: DataFrame) -> dict[str, float]:
    free = docs.where(~held_out()).select(F.col("doc_id").alias("id"), F.coalesce("text", F.lit("")).alias("text")).dropDuplicates(["id"])
    known = {r["doc_id"]: r["toxic"] for r in labels.where(~held_out()).where("toxic is not null").select("doc_id", "toxic").collect()}
    table = free.select(F.lit(True).alias("positive"), "text", "id").repartition(4)
    rows = [(r["id"], r["text"]) for r in table.collect()]
    features = [np.unique(np.concatenate([toxicity.word_features(w) for w in set(toxicity.WORD.findall(t.lower()))] or [[]])).astype(np.uint32) for _, t in rows]
    fold = np.array([zlib.crc32(str(i).encode()) % 5 for i, _ in rows])
    label = np.array([known.get(i, -1) for i, _ in rows])
    chosen = {"sure": toxicity.SURE, "cap": toxicity.CAP, "steps": toxicity.STEPS}
    for name, values in TOXICITY.items():
        found = []
        for value in values:
            each = []
            for f in (1, 2, 3, 4):
                train, test = np.flatnonzero(fold != f), np.flatnonzero((fold == f) & (label >= 0))
                prior = (label[train] == 1).sum() / (label[train] >= 0).sum()
                model = toxicity.PULogistic.fit([features[k] for k in train if label[k] == 1], [features[k] for k in train], prior, **chosen | {name: value})
                weight = dict(zip(model.features.tolist(), model.weights.tolist(), strict=True))
                g = np.array([model.bias + sum(weight.get(x, 0.0) for x in features[k].tolist()) for k in test])
                each.append(scores_of(1 / (1 + np.exp(-np.clip(g, -40, 40))), label[test]))
            mean = {k: float(np.mean([e[k] for e in each])) for k in each[0]}
            found.append((-round(mean["f1"], 4), mean["log_loss"], value))
            print(name, value, {k: round(v, 4) for k, v in mean.items()}, flush=True)
        chosen[name] = min(found)[2]
    print("chosen", chosen)
    return chosen


def _quality_rates(scored: DataFrame, labels: DataFrame, width: float, out: bool) -> tuple[int, int, int, int]:
    """(bad rejected, bad, good kept, good) of labelled documents that pass the base rules."""
    rows = quality_rules._judged(scored, width).where("not base_failed").select(F.col("row.doc_id").alias("doc_id"), "kept").join(labels.where(held_out() if out else ~held_out()), "doc_id")
    r = rows.agg(*(F.coalesce(F.sum(c.cast("int")), F.lit(0)) for c in ((F.col("quality") == 0) & ~F.col("kept"), F.col("quality") == 0, (F.col("quality") == 1) & F.col("kept"), F.col("quality") == 1))).first()
    return tuple(r)


def select_quality(docs: DataFrame, labels: DataFrame, held_out_only: bool = False) -> dict[str, float]:
    found = []
    for prior in (quality_rules.PRIOR,) if held_out_only else QUALITY["PRIOR"]:
        scored = quality_rules._scored(docs, ["doc_id"], "text", "lang", False, prior)
        for width in (quality_rules.WIDTH,) if held_out_only else QUALITY["width"]:
            a, b, c, d = _quality_rates(scored, labels, width, held_out_only)
            found.append((b - a + d - c, prior, width))
            print({"PRIOR": prior, "width": width, "bad rejected": f"{a} of {b}", "good kept": f"{c} of {d}"}, flush=True)
    print("chosen", min(found))
    return {"PRIOR": min(found)[1], "width": min(found)[2]}


def _read(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    return spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet")


def main() -> None:
    parser = argparse.ArgumentParser(prog="voxelweave.llm.selection")
    parser.add_argument("what", choices=["toxicity", "quality"])
    parser.add_argument("sf_dir")
    parser.add_argument("--held-out", action="store_true")
    args = parser.parse_args()
    docs, labels = _read(local_session(4, 8), args.sf_dir)
    if args.what == "quality":
        select_quality(docs, labels, args.held_out)
    elif args.held_out:
        rows = toxicity.score_toxicity(docs, labels).where("held_out").join(labels.where("toxic is not null"), "doc_id").select("score", "toxic").toPandas()
        print(scores_of(rows["score"].to_numpy(), rows["toxic"].to_numpy()), len(rows), int(rows["toxic"].sum()))
    else:
        select_toxicity(docs, labels)


if __name__ == "__main__":
    main()
