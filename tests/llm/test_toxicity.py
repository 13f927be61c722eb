from __future__ import annotations

import math
import random
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from twinframe.llm import toxicity
from twinframe.llm.queries import op3_toxicity, remainder

SF = "/root/testdata/sf0.01"


def plain_train(examples) -> tuple[float, dict[int, float]]:
    """FTRL-proximal coordinate by coordinate."""
    toxic = sum(y for _, y in examples)
    base = math.log((toxic + 0.5) / (len(examples) - toxic + 1))
    z, n = defaultdict(float), defaultdict(float)

    def weight(k):
        if abs(z[k]) <= toxicity.L1:
            return 0.0
        return -(z[k] - math.copysign(toxicity.L1, z[k])) / ((toxicity.BETA + math.sqrt(n[k])) / toxicity.ALPHA + toxicity.L2)

    for _ in range(toxicity.EPOCHS):
        for at, label in examples:
            w = {k: weight(k) for k in at}
            slope = 1 / (1 + math.exp(-(base + sum(w.values())))) - label
            for k in at:
                z[k] += slope - (math.sqrt(n[k] + slope * slope) - math.sqrt(n[k])) / toxicity.ALPHA * w[k]
                n[k] += slope * slope
    return base, {k: weight(k) for k in z if weight(k)}


def test_against_plain_ftrl():
    rng, examples = random.Random(5), []
    for i in range(400):
        toxic = i % 3 == 0
        examples.append((sorted({rng.randrange(60) + 40 * toxic for _ in range(rng.randrange(9))}), int(toxic)))
    base, wanted = plain_train(examples)
    found_base, at, w = toxicity.train([(np.array(at, np.int64), y) for at, y in examples])
    assert found_base == pytest.approx(base)
    assert wanted and at.tolist() == sorted(wanted)
    assert w == pytest.approx([wanted[k] for k in at.tolist()], rel=1e-4)


def test_edge_rows(frame):
    docs = frame("doc_id bigint, text string, score string", *[(i, "you vile thing" if i % 2 else "a kind word", "x") for i in range(60)], (90, None, "x"), (91, "", "x"), (92, "... !", "x"), (None, "you vile thing", "x"), (1, "you vile thing", "x"))
    labels = frame("doc_id bigint, toxic int", *[(i, i % 2) for i in range(60)], (1, 0), (2, None), (None, 1))
    model = toxicity.fit(docs, labels)
    rows = docs.select("doc_id", "score", toxicity.score("text", model).alias("s")).collect()
    rate = 1 / (1 + math.exp(-model[0]))
    assert all(r.score == "x" for r in rows)
    assert [r.s for r in rows if r.doc_id in (90, 91, 92)] == pytest.approx([rate] * 3)
    assert len({r.s for r in rows if r.doc_id == 1 or r.doc_id is None}) == 1
    assert all((r.s > 0.5) == (r.doc_id % 2 == 1) for r in rows if r.doc_id is not None and r.doc_id < 60)
    assert docs.limit(0).select(toxicity.score("text", model)).count() == 0
    for none in (toxicity.fit(docs.limit(0), labels), toxicity.fit(docs, labels.limit(0))):
        assert docs.select(toxicity.score("text", none).alias("s")).first().s == pytest.approx(1 / 3)


def test_query_on_held_out_rows(spark):
    toxic = {r.doc_id: r.toxic for r in spark.read.parquet(f"{SF}/labels.parquet").where("toxic IS NOT NULL").collect()}
    ids = {r.doc_id: r.held for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", (remainder(5) == 0).alias("held")).collect()}
    rows = op3_toxicity(spark, SF).collect()
    assert sorted(r.doc_id for r in rows) == sorted(ids)
    assert all(r.held_out == ids[r.doc_id] and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in rows)
    held = [(r.predicted, toxic[r.doc_id]) for r in rows if r.held_out and r.doc_id in toxic]
    assert {y for _, y in held} == {0, 1}
    right = sum(p == y for p, y in held)
    assert right >= 0.9 * len(held), (right, len(held))


def test_held_out_rows_are_not_used(spark, tmp_path):
    small = "/root/testdata/sf0.001"
    labels = spark.read.parquet(f"{small}/labels.parquet")
    labels.withColumn("toxic", F.when(remainder(5) == 0, 1 - F.col("toxic")).otherwise(F.col("toxic"))).write.parquet(str(tmp_path / "labels.parquet"))
    spark.read.parquet(f"{small}/documents.parquet").write.parquet(str(tmp_path / "documents.parquet"))
    found = lambda d: sorted((r.doc_id, r.score) for r in op3_toxicity(spark, d).collect())
    assert found(str(tmp_path)) == found(small)
