"""Periodic runs of words: maximal stretches that repeat with a period, by tiles of each period octave.

Words are runs of other characters than the six ASCII white-space ones. A run is a stretch of words with smallest period q
and at least max(``LEAST``, ``POWER`` * q) words that no neighbouring word extends.

For each octave of periods, q from P to 2P - 1, a document is cut into overlapping tiles of ``SPAN`` * P words and a margin.
In a tile every multiple of P is a boundary. What repeats over a boundary c with period q is as long as the common extensions
of c and c + q to both sides, which two Z-functions give for all q of the octave at once. Each run has boundaries in its
first period, and there at least 2P words agree, so tiles without two equal blocks of 2P words at such a distance are not
made rows. Tiles are solved on their own, wherever Spark puts them. Their fragments, intervals of places that equal the place
q later, are shuffled by document and period and stitched where they touch. An interval whose words have a smaller period
that divides q belongs to that period.

Null and empty texts have no words and no runs. Rows equal in id and text are one document to the stitching and get the same
answer; of several texts under one id each is its own. Rows with a null id are answered as any other. Extra columns are
ignored, an empty table gives an empty table. Very long texts are rows of many tiles. Words are compared by 64-bit hashes
within a document.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from twinframe.llm.common import SPACE_WORDS, batches_by_bytes, mix, text_slices, word_bytes, word_hashes, word_spans
from twinframe.session import stored

cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: A run has at least LEAST words and POWER periods.
LEAST, POWER = 6, 4
#: Boundaries of a tile; words before its first and after its last boundary, all in units of the octave's first period.
SPAN, BEFORE, AFTER = 16, 2, 5
#: Pairs of blocks compared at once.
COMPARED = 1 << 20
TILE = "struct<octave:int,start:bigint,codes:array<int>,cuts:array<int>>"


def meeting(words: np.ndarray, bounds: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """(P, boundaries): where a block of 2P words equals the one that starts q later, P <= q < 2P, within a document.

    ``words``: hashes of the words of several documents, ``bounds``: where each document begins and ends among them.
    """
    octave, size = 1, np.diff(bounds)
    blocks = words  # hash of the 2P words from each place on, filled below
    while True:
        usable = np.flatnonzero(size >= max(LEAST, POWER * octave))
        if not len(usable):
            return
        # Blocks of twice the length: one after the other.
        with np.errstate(over="ignore"):
            blocks = mix(blocks[:-octave] * np.uint64(0x9E3779B97F4A7C15) + blocks[octave:] + np.uint64(octave)) if len(blocks) > octave else blocks[:0]
        first, last = bounds[usable], bounds[usable + 1] - 3 * octave
        counts = np.maximum(0, (last - first) // octave + 1)
        at = np.repeat(first - np.concatenate([[0], np.cumsum(counts)[:-1]]) * octave, counts) + np.arange(counts.sum()) * octave
        ends = np.repeat(bounds[usable + 1], counts)
        periods, hits = np.arange(octave, 2 * octave), []
        for k in range(0, len(at), max(1, COMPARED // octave)):
            cuts, stop = at[k : k + max(1, COMPARED // octave)], ends[k : k + max(1, COMPARED // octave)]
            other = cuts[:, None] + periods
            fits = other + 2 * octave <= stop[:, None]
            same = fits & (blocks[cuts][:, None] == blocks[np.minimum(other, len(blocks) - 1)])
            hits.append(cuts[same.any(axis=1)])
        yield octave, np.concatenate(hits) if hits else at[:0]
        octave *= 2


def tiles(rows: DataFrame) -> DataFrame:
    """``rows`` (id, t, text) with ``tiles``, where something repeats: octave, place of the first word, words as numbers, boundaries to solve."""
    kind = pa.list_(pa.struct([("octave", pa.int32()), ("start", pa.int64()), ("codes", pa.list_(pa.int32())), ("cuts", pa.list_(pa.int32()))]))

    def cut(text: pa.Array) -> Iterator[list[dict]]:
        for first, last, data, offsets in text_slices(text):
            starts, ends, bounds = word_spans(data, offsets, word_bytes(SPACE_WORDS))
            words, found = word_hashes(data, starts, ends), [[] for _ in range(last - first)]
            for octave, cuts in meeting(words, bounds):
                row = np.searchsorted(bounds, cuts, "right") - 1
                tile = (cuts - bounds[row]) // (SPAN * octave)
                edges = np.flatnonzero(np.diff(row, prepend=-1) | np.diff(tile, prepend=-1))
                for here in np.split(cuts, edges[1:]) if len(cuts) else []:
                    doc = int(np.searchsorted(bounds, here[0], "right")) - 1
                    low = max(int(bounds[doc]), int(here[0]) - BEFORE * octave)
                    high = min(int(bounds[doc + 1]), int(here[-1]) + AFTER * octave)
                    codes = np.unique(words[low:high], return_inverse=True)[1].astype(np.int32)
                    found[doc].append({"octave": octave, "start": low - int(bounds[doc]), "codes": codes, "cuts": (here - low).astype(np.int32)})
            yield from found

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = pa.array(list(cut(batch.column("text"))), kind)
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in ("id", "t", "text")], made], ["id", "t", "text", "tiles"])

    return rows.select("id", "t", "text").mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, t bigint, text string, tiles array<{TILE}>")


def z_function(s: list[int]) -> list[int]:
    """For each place how many elements from there on equal the beginning."""
    n = len(s)
    z = [n] + [0] * (n - 1)
    left = right = 0
    for i in range(1, n):
        k = min(right - i, z[i - left]) if i < right else 0
        while i + k < n and s[k] == s[i + k]:
            k += 1
        z[i] = k
        if i + k > right:
            left, right = i, i + k
    return z


@lru_cache(maxsize=1 << 14)
def prime_parts(q: int) -> tuple[int, ...]:
    """q divided by each of its prime factors."""
    parts, rest, p = [], q, 2
    while p * p <= rest:
        if rest % p == 0:
            parts.append(q // p)
            while rest % p == 0:
                rest //= p
        p += 1
    return (*parts, q // rest) if rest > 1 else tuple(parts)


def fragments(words: list[int], cuts: list[int], octave: int) -> list[tuple[int, int, int]]:
    """(q, from, to): places of a tile that equal the place q later, around its boundaries, joined where they touch."""
    found: dict[int, list[list[int]]] = {}
    for c in cuts:
        head = words[c : c + AFTER * octave]
        ahead = z_function(head)
        behind = words[max(0, c - BEFORE * octave) : c][::-1]
        around = words[max(0, c - BEFORE * octave) : c + 2 * octave][::-1]
        back = z_function([*behind, -1, *around])
        for q in range(octave, min(2 * octave, len(head))):
            forward = ahead[q]
            if not forward or forward + len(behind) < 2 * octave:
                continue
            place = 1 + len(around) - q  # of the element before c + q, counted from the end
            backward = min(back[place], len(behind)) if behind and place > len(behind) else 0
            if forward + backward < 2 * octave or any(ahead[p] >= q - p for p in prime_parts(q)):
                continue
            spans = found.setdefault(q, [])
            if spans and spans[-1][1] >= c - backward:
                spans[-1][1] = max(spans[-1][1], c + forward)
            else:
                spans.append([c - backward, c + forward])
    return [(q, low, high) for q, spans in found.items() for low, high in spans]


def solved(tiles: DataFrame) -> DataFrame:
    """(id, t, q, low, high) of the fragments in ``tiles`` (id, t, tile)."""
    kind = tiles.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            picked, rows = [], []
            for i, tile in enumerate(batch.column("tile").to_pylist()):
                for q, low, high in fragments(tile["codes"], tile["cuts"], tile["octave"]):
                    picked.append(i)
                    rows.append((q, tile["start"] + low, tile["start"] + high))
            ids = [batch.column(name).take(pa.array(picked, pa.int64())) for name in ("id", "t")]
            columns = list(zip(*rows, strict=True)) if rows else [[], [], []]
            yield pa.RecordBatch.from_arrays([*ids, *[pa.array(c, pa.int64()) for c in columns]], ["id", "t", "q", "low", "high"])

    return tiles.mapInArrow(run, f"id {kind}, t bigint, q bigint, low bigint, high bigint")


def stitched(found: DataFrame) -> DataFrame:
    """(id, t, start, period, length): the runs that fragments make up."""
    once = found.groupBy("id", "t", "q", "low").agg(F.max("high").alias("high"))
    order = Window.partitionBy("id", "t", "q").orderBy("low")
    reach = F.max("high").over(order.rowsBetween(Window.unboundedPreceding, -1))
    begun = once.withColumn("new", F.when(F.col("low") <= reach, 0).otherwise(1))
    whole = begun.withColumn("run", F.sum("new").over(order)).groupBy("id", "t", "q", "run").agg(F.min("low").alias("start"), F.max("high").alias("high"))
    sized = whole.select("id", "t", "q", "start", (F.col("high") - F.col("start") + F.col("q")).alias("length"))
    long = sized.where(f"length >= greatest({LEAST}, {POWER} * q)")
    return long.groupBy("id", "t", "start", "length").agg(F.min("q").alias("period")).select("id", "t", "start", "period", "length")


def collapsed(text: Column, runs: Column) -> Column:
    """The words of a text, joined by one space, without those that a run holds after its first period."""

    def run(text: pa.Array, runs: pa.Array) -> pa.Array:
        out = []
        for t, found in zip(text.to_pylist(), runs.to_pylist(), strict=True):
            words = (t or "").encode().split()
            gone = np.zeros(len(words) + 1, np.int64)
            for r in found or []:
                gone[r["start"] + r["period"]] += 1
                gone[r["start"] + r["length"]] -= 1
            kept = np.flatnonzero(np.cumsum(gone)[:-1] == 0)
            out.append(b" ".join([words[i] for i in kept] if found else words).decode())
        return pa.array(out, pa.string())

    return F.arrow_udf(run, "string")(text, runs)


def periodic_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of ``docs``: ``id``, ``n_words``, ``runs`` (array of start, period, length in this order) and ``collapsed``, the words joined by one space without the repeated ones.

    Texts without a tile, which are most, are not shuffled.
    """
    batches_by_bytes(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(text_col, F.lit("")).alias("text")).withColumn("t", F.xxhash64("text"))
    cut = tiles(rows)
    made = stored(cut.where(F.size("tiles") > 0).select("id", "t", "text", "tiles"), "tiles")
    each = made.dropDuplicates(["id", "t"]).select("id", "t", F.posexplode("tiles").alias("k", "tile"))
    found = stitched(solved(each.repartition("id", "t", "k").select("id", "t", "tile")))
    listed = found.groupBy("id", "t").agg(F.array_sort(F.collect_list(F.struct("start", "period", "length"))).alias("runs"))
    listed = listed.select(F.col("id").alias("i"), F.col("t").alias("u"), "runs")
    none = F.array().cast("array<struct<start:bigint,period:bigint,length:bigint>>")
    met = made.select("id", "t", "text").join(listed, F.col("id").eqNullSafe(F.col("i")) & (F.col("t") == F.col("u")), "left")
    plain = cut.where(F.size("tiles") == 0).select("id", "text", none.alias("runs"))
    every = plain.unionByName(met.select("id", "text", F.coalesce("runs", none).alias("runs")))
    words = F.array_remove(F.split("text", r"[\x20\x09-\x0D]+"), "")
    joined = F.when(F.size("runs") > 0, collapsed(F.col("text"), F.col("runs"))).otherwise(F.array_join(words, " "))
    return every.select("id", F.size(words).cast("bigint").alias("n_words"), "runs", joined.alias("collapsed"))
