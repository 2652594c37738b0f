"""Near-duplicates in buckets of any size, and toxic passages without spaces."""

from __future__ import annotations

import random

import pyarrow as pa
import pytest

from voxelweave.llm import near_dedup, toxicity


@pytest.mark.parametrize(("members", "size"), [(4, 32_000_000), (1000, 3000)])
def test_pairs_of_one_shared_bucket_are_compared(spark, docs_of, monkeypatch, members, size):
    """All texts share one bucket and no other, and it is larger than a block."""
    sign = near_dedup._sign

    def one_bucket(weighted):
        def run(source):
            for batch in sign(weighted)(source):
                bands = pa.array([[7]] * batch.num_rows, pa.list_(pa.int64()))
                alike = pa.array([bytes(2 * near_dedup.ROWS) + s[2 * near_dedup.ROWS :] for s in batch.column(2).to_pylist()], pa.binary())  # in the first band
                yield pa.RecordBatch.from_arrays([*batch.columns[:2], alike, bands, batch.column(4)], names=batch.schema.names)

        return run

    monkeypatch.setattr(near_dedup, "_sign", one_bucket)
    monkeypatch.setattr(near_dedup, "BLOCK", members)
    monkeypatch.setattr(near_dedup, "BYTES", size)
    shapes, blocks = [], near_dedup._blocks

    def seen(*args):
        out = blocks(*args)
        shapes.append(out.where("asks").select("i", "j").distinct().count())
        return out

    monkeypatch.setattr(near_dedup, "_blocks", seen)
    rng, texts = random.Random(6), []
    for k in range(8):
        words = [f"w{k}x{rng.randrange(10**6)}" for _ in range(120)]
        texts += [" ".join(words), " ".join([*words[:-2], "other", "end"])]
    rows = {r["doc_id"]: r["class_id"] for r in near_dedup.near_duplicates(docs_of(texts)).collect()}
    assert rows == {k: k - k % 2 for k in range(16)} and shapes[0] > 4  # more than a few blocks, by members or by bytes


def test_long_words_give_their_grams():
    run = "a" * 60 + "wretchgoon"
    assert set(toxicity.word_features("wretchgoon")[2:5]) & set(toxicity.word_features(run))
    assert len(toxicity.word_features(run)) == 1 + (72 - 3) + (72 - 4)
