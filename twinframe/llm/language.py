"""Language of texts by a byte convolutional network, trained here in numpy.

A text is folded (A-Z to a-z, other ASCII than letters to blanks) and cut into windows of ``WINDOW`` bytes. In each
window, filters of several widths slide over embedded bytes; their largest responses feed a softmax layer. The answer for
a text is the mean over all its windows. As the filters see two to four bytes only, their responses are looked up in
tables of byte pairs made from the trained weights, which gives the same sums without multiplying again.

The sample of labelled rows for training is bounded by ``sample_rows`` (taken by hash), ``DOC_WINDOWS`` windows a document,
spread over its text and cut in the tasks that read it, and ``SAMPLE_WINDOWS`` windows in all, shared evenly by the languages;
prediction covers every row and whole texts. Null texts and texts without a letter are ``und`` with score 0, as is
everything when no row has a language. Ties go to the language first in order. Extra columns stay as they are; repeated
rows are answered alike; an empty table gives an empty table.
"""

from __future__ import annotations

import pickle
import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from twinframe.llm.common import text_slices

cloudpickle.register_pickle_by_value(sys.modules[__name__])

WINDOW, WIDTHS, FILTERS, EMBEDDED = 128, (2, 3, 4), 8, 8
REACH = max(WIDTHS) - 1
SAMPLE_ROWS, DOC_WINDOWS, SAMPLE_WINDOWS = 3000, 64, 12_000
EPOCHS, BATCH, RATE = 4, 64, 0.01
#: Windows whose responses are in memory at once.
STEP = 2048


def fold_table() -> np.ndarray:
    out = np.full(256, 32, np.uint8)
    out[97:123] = out[65:91] = np.arange(97, 123)
    out[128:] = np.arange(128, 256)
    return out


def windows(data: np.ndarray, offsets: np.ndarray, most: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(row of each window, bytes of each window and the next ``REACH``); past the end of a text there are blanks.
    Of texts with more than ``most`` windows so many, spread over the text."""
    sizes = np.diff(offsets)
    counts = -(-sizes // WINDOW)
    taken = counts if most is None else np.minimum(counts, most)
    row = np.repeat(np.arange(len(sizes)), taken)
    nth = np.arange(len(row)) - np.repeat(np.cumsum(taken) - taken, taken)
    nth = nth * counts[row] // np.maximum(taken[row], 1)
    at = (offsets[:-1][row] + nth * WINDOW)[:, None] + np.arange(WINDOW + REACH)
    padded = np.append(fold_table()[data], np.uint8(32))
    return row, padded[np.where(at < offsets[1:][row][:, None], at, len(data))]


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def train(x: np.ndarray, y: np.ndarray, classes: int) -> dict:
    """Adam on batches of windows; through the maximum, the gradient goes to the position that reached it."""
    rng = np.random.default_rng(7)
    p = {"e": rng.normal(0, 0.5, (256, EMBEDDED)), "out": rng.normal(0, 0.1, (FILTERS * len(WIDTHS), classes)), "c": np.zeros(classes)}
    for w in WIDTHS:
        p |= {f"w{w}": rng.normal(0, (w * EMBEDDED) ** -0.5, (w * EMBEDDED, FILTERS)), f"b{w}": np.zeros(FILTERS)}
    p = {k: v.astype(np.float32) for k, v in p.items()}
    first, second, step = {k: np.zeros_like(v) for k, v in p.items()}, {k: np.zeros_like(v) for k, v in p.items()}, 0
    for _ in range(EPOCHS):
        order = rng.permutation(len(x))
        for at in range(0, len(x), BATCH):
            xb, yb = x[order[at : at + BATCH]], y[order[at : at + BATCH]]
            n = len(xb)
            embedded = p["e"][xb]
            pooled, places = [], []
            for w in WIDTHS:
                seen = np.concatenate([embedded[:, k : k + WINDOW] for k in range(w)], axis=2)
                response = seen @ p[f"w{w}"] + p[f"b{w}"]
                place = response.argmax(axis=1)
                places.append(place)
                pooled.append(np.take_along_axis(response, place[:, None], 1)[:, 0])
            pool = np.concatenate(pooled, axis=1)
            on = np.maximum(pool, 0)
            d = softmax(on @ p["out"] + p["c"])
            d[np.arange(n), yb] -= 1
            d /= n
            g = {"out": on.T @ d, "c": d.sum(axis=0), "e": np.zeros_like(p["e"])}
            back = (d @ p["out"].T) * (pool > 0)
            for i, w in enumerate(WIDTHS):
                part = back[:, i * FILTERS : (i + 1) * FILTERS]
                spots = xb[np.arange(n)[:, None, None], places[i][:, :, None] + np.arange(w)]
                g[f"w{w}"] = np.einsum("nf,nfk->kf", part, p["e"][spots].reshape(n, FILTERS, -1))
                g[f"b{w}"] = part.sum(axis=0)
                np.add.at(g["e"], spots, part[:, :, None, None] * p[f"w{w}"].T.reshape(1, FILTERS, w, EMBEDDED))
            step += 1
            for k in p:
                first[k] = 0.9 * first[k] + 0.1 * g[k]
                second[k] = 0.999 * second[k] + 0.001 * g[k] ** 2
                p[k] -= (RATE * first[k] / (1 - 0.9**step) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
    return p


def lookups(p: dict) -> list[list[np.ndarray]]:
    """Per width the tables whose entries for the byte pairs (or last byte) of a position add up to the responses there."""
    out = []
    for w in WIDTHS:
        parts = p[f"w{w}"].reshape(w, EMBEDDED, FILTERS)
        single = [p["e"] @ parts[k] for k in range(w)]
        single[0] = single[0] + p[f"b{w}"]
        pairs = [(single[k][:, None] + single[k + 1][None]).reshape(65536, FILTERS) for k in range(0, w - 1, 2)]
        out.append([np.ascontiguousarray(t, np.float32) for t in pairs + single[w - 1 :] * (w % 2)])
    return out


def chances(p: dict, tables: list[list[np.ndarray]], x: np.ndarray) -> np.ndarray:
    """Softmax outputs per window."""
    out = []
    for at in range(0, len(x), STEP):
        b = x[at : at + STEP]
        pairs = b[:, :-1].astype(np.int32) * 256 + b[:, 1:]
        pooled = []
        for w, parts in zip(WIDTHS, tables, strict=True):
            response = None
            for k, t in enumerate(parts):
                index = pairs[:, 2 * k : 2 * k + WINDOW] if len(t) > 256 else b[:, 2 * k : 2 * k + WINDOW]
                got = t.take(index, axis=0)
                response = got if response is None else np.add(response, got, out=response)
            pooled.append(response.max(axis=1))
        out.append(softmax(np.maximum(np.concatenate(pooled, axis=1), 0) @ p["out"] + p["c"]))
    return np.concatenate(out)


def balanced(code: np.ndarray, most: int) -> np.ndarray:
    """Places of at most ``most`` windows in random order, evenly many of each class; what a rare one leaves goes to the others."""
    order = np.random.default_rng(3).permutation(len(code))
    counts = np.bincount(code)
    share = np.zeros(len(counts), np.int64)
    for left, k in zip(range(len(counts), 0, -1), np.argsort(counts, kind="stable"), strict=True):
        share[k] = min(counts[k], (most - share.sum()) // left)
    kept = [order[code[order] == k][:n] for k, n in enumerate(share)]
    return np.random.default_rng(5).permutation(np.concatenate(kept))


def fit(rows: DataFrame, sample_rows: int = SAMPLE_ROWS) -> tuple[list[str], dict]:
    """(languages, weights) from labelled rows with doc_id, text and lang. Training runs in a task."""
    order = F.xxhash64(F.col("doc_id"), F.lit(29))
    usable = rows.where("doc_id IS NOT NULL AND lang IS NOT NULL AND text IS NOT NULL")
    sample = usable.select("doc_id").distinct().orderBy(order, "doc_id").limit(sample_rows)
    chosen = usable.join(F.broadcast(sample), "doc_id").groupBy("doc_id").agg(F.max(F.struct("lang", "text")).alias("x")).select("doc_id", "x.*")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            packed = []
            for first, last, data, offsets in text_slices(b.column("text")):
                row, x = windows(data, offsets, DOC_WINDOWS)
                bounds = np.searchsorted(row, np.arange(last - first + 1))
                packed += [x[i:j].tobytes() for i, j in zip(bounds[:-1], bounds[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("lang"), pa.array(packed, pa.binary())], ["doc_id", "lang", "windows"])

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        xs, langs = [], []
        for b in batches:
            for lang, packed in zip(b.column("lang").to_pylist(), b.column("windows").to_pylist(), strict=True):
                xs.append(np.frombuffer(packed, np.uint8).reshape(-1, WINDOW + REACH))
                langs += [lang] * len(xs[-1])
        names = sorted(set(langs))
        p = {}
        if names:
            x, code = np.concatenate(xs), np.searchsorted(np.array(names, str), np.array(langs, str))
            kept = balanced(code, SAMPLE_WINDOWS)
            p = train(x[kept], code[kept], len(names))
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps((names, p))], pa.binary())], ["model"])

    kind = chosen.schema["doc_id"].dataType.simpleString()
    found = chosen.mapInArrow(cut, f"doc_id {kind}, lang string, windows binary")
    learned = found.repartition(1).sortWithinPartitions(order, "doc_id").mapInArrow(learn, "model binary").collect()
    return pickle.loads(learned[0].model) if learned else ([], {})


def predict(text: str | Column, model: tuple[list[str], dict]) -> Column:
    """A struct of ``lang`` and ``score``."""
    names, p = model

    def run(text: pa.Array) -> pa.Array:
        tables = lookups(p) if names else []
        langs, scores = [], []
        for first, last, data, offsets in text_slices(text):
            rows = last - first
            row, x = windows(data, offsets)
            letter = (((data | 32) >= 97) & ((data | 32) <= 122)).astype(np.int64)
            known = np.diff(np.append(0, np.cumsum(letter))[offsets]) > 0
            for i in np.flatnonzero(~known & (np.diff(offsets) > 0)):
                known[i] = any(c.isalpha() for c in bytes(data[offsets[i] : offsets[i + 1]]).decode())
            mean = np.zeros((rows, max(1, len(names))))
            if names and len(x):
                chance = chances(p, tables, x)
                for k in range(len(names)):
                    mean[:, k] = np.bincount(row, chance[:, k], rows) / np.maximum(np.bincount(row, minlength=rows), 1)
            best = mean.argmax(axis=1)
            known &= bool(names)
            langs += [names[k] if yes else "und" for k, yes in zip(best, known, strict=True)]
            scores.append(np.where(known, np.clip(mean[np.arange(rows), best], 0, 1), 0.0))
        return pa.StructArray.from_arrays([pa.array(langs, pa.string()), pa.array(np.concatenate(scores) if scores else [], pa.float64())], ["lang", "score"])

    return F.arrow_udf(run, "struct<lang: string, score: double>")(text)
