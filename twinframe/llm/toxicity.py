"""Toxicity scores by logistic regression, trained with FTRL-proximal on hashed word n-grams and skip-grams.

Features of a text: which words, pairs of neighbouring words and pairs with one word between occur in it, hashed to
2^18 buckets. Training follows per-coordinate rates (alpha, beta) and both penalties (l1, l2); l1 leaves few weights that
are not 0, and only those travel to the executors. The sample of labelled rows for training is bounded by
``sample_rows``, taken by hash; scoring covers every row and whole texts.

A label of a document that occurs several times is the largest; null labels do not count. Null and empty texts have no
features and get the base rate of the sample, as do texts without a known feature. Without labelled rows the score is
1/3. Extra columns stay as they are; repeated rows are scored alike; an empty table gives an empty table.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from twinframe.llm.common import PLAIN_WORDS, batches_by_bytes, folded, mix, text_slices, word_bytes, word_hashes, word_spans

cloudpickle.register_pickle_by_value(sys.modules[__name__])

BITS = 18
#: At most so many labelled rows train the model.
SAMPLE_ROWS = 12_000
EPOCHS, ALPHA, BETA, L1, L2 = 4, 1.0, 1.0, 3.0, 1.0


def features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, bucket) of every occurrence of a feature in a slice of texts."""
    data = folded(data)
    starts, ends, bounds = word_spans(data, offsets, word_bytes(PLAIN_WORDS))
    words = word_hashes(data, starts, ends)
    rows = np.repeat(np.arange(len(offsets) - 1), np.diff(bounds))
    found = [(rows, words)]
    with np.errstate(over="ignore"):
        for gap, salt in ((1, 0x51ED270B), (2, 0x2545F491)):
            if len(words) > gap:
                same = rows[gap:] == rows[:-gap]
                pair = mix(words[:-gap] * np.uint64(0x9E3779B97F4A7C15) + words[gap:] + np.uint64(salt))
                found.append((rows[gap:][same], pair[same]))
    return np.concatenate([r for r, _ in found]), (np.concatenate([h for _, h in found]) >> np.uint64(64 - BITS)).astype(np.int64)


def train(examples: list[tuple[np.ndarray, int]]) -> tuple[float, np.ndarray, np.ndarray]:
    """(base log-odds, buckets, weights): FTRL-proximal over examples in the given order; the base rate is not penalised."""
    toxic = sum(y for _, y in examples)
    base = float(np.log((toxic + 0.5) / (len(examples) - toxic + 1)))
    z, n = np.zeros(1 << BITS), np.zeros(1 << BITS)

    def weights(at) -> np.ndarray:
        return np.where(np.abs(z[at]) <= L1, 0.0, -(z[at] - np.sign(z[at]) * L1) / ((BETA + np.sqrt(n[at])) / ALPHA + L2))

    for _ in range(EPOCHS):
        for at, label in examples:
            w = weights(at)
            slope = 1 / (1 + np.exp(-np.clip(base + w.sum(), -35, 35))) - label
            z[at] += slope - (np.sqrt(n[at] + slope * slope) - np.sqrt(n[at])) / ALPHA * w
            n[at] += slope * slope
    final = weights(slice(None))
    kept = np.flatnonzero(final)
    return base, kept, final[kept].astype(np.float32)


def fit(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> tuple[float, np.ndarray, np.ndarray]:
    """The model of the labelled rows given (``docs``: doc_id, text; ``labels``: doc_id, toxic). Training runs in a task."""
    batches_by_bytes(docs.sparkSession)
    known = labels.where("doc_id IS NOT NULL AND toxic IS NOT NULL").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    order = F.xxhash64(F.col("doc_id"), F.lit(17))
    sample = known.join(docs.select("doc_id").distinct(), "doc_id", "left_semi").orderBy(order, "doc_id").limit(sample_rows)
    rows = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id").groupBy("doc_id", "toxic").agg(F.max("text").alias("text"))

    def describe(text: pa.Array) -> pa.Array:
        out = []
        for _, _, data, offsets in text_slices(text):
            row, bucket = features(data, offsets)
            keys = np.unique(row << BITS | bucket)
            ends = np.searchsorted(keys, np.arange(1, len(offsets)) << BITS)
            out += [x.astype(np.int32) for x in np.split(keys & ((1 << BITS) - 1), ends[:-1])]
        return pa.array(out, pa.list_(pa.int32()))

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        examples = [(np.array(at.values), y.as_py()) for b in batches for at, y in zip(b.column("at"), b.column("toxic"), strict=True)]
        base, at, w = train(examples)
        yield pa.RecordBatch.from_arrays([pa.array([-1, *at.tolist()], pa.int32()), pa.array([base, *w.tolist()], pa.float64())], ["at", "w"])

    described = rows.select("doc_id", F.col("toxic").cast("int").alias("toxic"), F.arrow_udf(describe, "array<int>")("text").alias("at"))
    learned = described.repartition(1).sortWithinPartitions(order, "doc_id").select("at", "toxic").mapInArrow(learn, "at int, w double").toPandas()
    if learned.empty:
        return train([])
    return float(learned.w[0]), learned["at"].to_numpy()[1:], learned.w.to_numpy(np.float32)[1:]


def score(text: str | Column, model: tuple[float, np.ndarray, np.ndarray]) -> Column:
    """The chance that a text is toxic, 0 to 1."""
    base, at, w = model

    def run(text: pa.Array) -> pa.Array:
        weight = np.zeros(1 << BITS, np.float32)
        weight[at] = w
        out = []
        for first, last, data, offsets in text_slices(text):
            row, bucket = features(data, offsets)
            counts = weight[bucket] != 0
            keys = np.unique(row[counts] << BITS | bucket[counts])
            total = np.bincount(keys >> BITS, weight[keys & ((1 << BITS) - 1)], last - first)
            out.append(1 / (1 + np.exp(-np.clip(base + total, -35, 35))))
        return pa.array(np.concatenate(out) if out else [], pa.float64())

    return F.arrow_udf(run, "double")(text)


def without_toxic(docs: DataFrame, model, threshold: float = 0.5) -> DataFrame:
    """The documents below the threshold, with their columns."""
    return docs.where(score(F.coalesce("text", F.lit("")), model) < threshold)
