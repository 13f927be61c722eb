"""Ranked lexical search of many items at once by a dual-tree walk.

An item's terms are weighed by their rarity, a document's by their frequency in it against its length, all in whole numbers;
a score is the sum of products over the terms of the item. Documents become sparse vectors over the items' terms in one pass
of the corpus, whose totals give weights and lengths. Then each task takes its vectors in blocks. In a block, documents are
ordered by their weightiest term and put into a tree whose nodes hold the largest value of every term below. Items form a
tree of the same kind. A pair of nodes is bounded by the sum of products of both; if that is below the weakest k-th score
among the items of the one, none of them can use any document of the other, and the whole batch goes at once. What is left
at the leaves is scored exactly. Bounds equal to the k-th score stay, so ties are decided by ids and nothing is lost.

K-th scores start from a search of about ``SEED_ROWS`` documents drawn at random: they are scores that items reach, so true
lower bounds, and affect the work only. Items are taken in blocks of about ``BLOCK_TERMS`` terms, each a pass over the
documents; only a block's items travel to the tasks, and a task returns k documents an item at most.

Terms are compared by 64-bit hashes. Null and empty texts have no terms: such documents count for nothing, such items find
nothing. Repeated documents are ranked each; equal scores go by ascending id, null first. Rows of one item id are one item
with all their terms. Extra columns are ignored; empty tables give an empty table. Ids of documents are integers.
"""

from __future__ import annotations

import math
import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from twinframe.llm.common import PLAIN_WORDS, batches_by_bytes, folded, lower_ascii, text_slices, word_bytes, word_hashes, word_spans
from twinframe.session import stored

cloudpickle.register_pickle_by_value(sys.modules[__name__])

TERMS = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: Terms of the items (each with its items) that are searched in one pass, and documents drawn for the first k-th scores.
BLOCK_TERMS, SEED_ROWS = 1 << 19, 4000
#: Documents and entries of a block, children of a node (a power of two).
BLOCK_ROWS, BLOCK_ENTRIES, FAN_BITS = 4096, 1 << 20, 3
LOWEST = np.iinfo(np.int64).min


def _ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The numbers of all given ranges, one after the other."""
    ends = np.cumsum(sizes)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - np.concatenate([[0], ends[:-1]]), sizes) if len(ends) else np.zeros(0, np.int64)


class Items:
    """The items of a block as a tree: level 0 holds the items, each further level the union of ``1 << FAN_BITS`` nodes below."""

    def __init__(self, terms: list[np.ndarray], weights: np.ndarray):
        self.weights = weights
        # Items of the same rarest term become neighbours.
        self.order = np.array(sorted(range(len(terms)), key=lambda i: (int(terms[i][np.argmax(weights[terms[i]])]), i)), np.int64)
        sets = [np.sort(terms[i]) for i in self.order]
        self.levels = []
        while True:
            sizes = np.array([len(s) for s in sets], np.int64)
            self.levels.append((np.concatenate(sets), np.cumsum(sizes) - sizes, sizes))
            if len(sets) == 1:
                break
            fan = 1 << FAN_BITS
            sets = [np.unique(np.concatenate(sets[i : i + fan])) for i in range(0, len(sets), fan)]

    def weakest(self, scores: np.ndarray) -> list[np.ndarray]:
        """By level the lowest of ``scores`` (of the items in order) below each node."""
        out = [scores]
        for _ in self.levels[1:]:
            out.append(np.minimum.reduceat(out[-1], np.arange(0, len(out[-1]), 1 << FAN_BITS)))
        return out

    def sums(self, values: np.ndarray, level: int, nodes: np.ndarray) -> np.ndarray:
        """The sum of ``values`` (last axis: terms) over the terms of each node."""
        terms, starts, sizes = self.levels[level]
        picked = values[..., terms[_ranges(starts[nodes], sizes[nodes])]]
        return np.add.reduceat(picked, np.cumsum(sizes[nodes]) - sizes[nodes], axis=-1)

    def reaching(self, values: np.ndarray, items: np.ndarray, weakest: list[np.ndarray]) -> np.ndarray:
        """Those of ``items`` (ascending) that a document within ``values`` may serve, by way of their nodes."""
        for level in range(len(self.levels) - 1, -1, -1):
            if not len(items):
                break
            above = items >> (FAN_BITS * level)
            first = np.flatnonzero(np.diff(above, prepend=-1))
            nodes = above[first]
            bound = self.sums(values, level, nodes)
            stays = (bound > 0) & (bound >= weakest[level][nodes])
            items = items[np.repeat(stays, np.diff(first, append=len(items)))]
        return items


class Search:
    """The best k documents of each item among those seen so far, in a task."""

    def __init__(self, items: Items, k: int, least: np.ndarray):
        self.items, self.k, self.least = items, k, least
        self.scores = np.zeros((len(least), k), np.int64)
        self.ids = np.full((len(least), k), np.iinfo(np.int64).max)

    def block(self, ids: np.ndarray, sizes: np.ndarray, terms: np.ndarray, values: np.ndarray) -> None:
        """Search documents given by their entries (term, value), ``sizes`` of them each, none empty."""
        space = len(self.items.weights)
        gains = values * self.items.weights[terms]
        starts = np.cumsum(sizes) - sizes
        # Terms that weigh nothing cannot lead; entries stand in the order of documents.
        leading = np.maximum.reduceat(gains * space + terms, starts) % space
        order = np.lexsort((ids, leading))
        picked = _ranges(starts[order], sizes[order])
        ids, sizes, terms, gains = ids[order], sizes[order], terms[picked], gains[picked]
        levels = [(terms, gains, np.cumsum(sizes) - sizes, sizes)]
        owner = np.repeat(np.arange(len(ids)), sizes)
        while len(levels[-1][2]) > 1 or len(levels) == 1:
            terms, gains, _, sizes = levels[-1]
            key = (owner >> FAN_BITS) * space + terms
            by = np.argsort(key, kind="stable")
            key = key[by]
            first = np.flatnonzero(np.diff(key, prepend=-1))
            most, key = np.maximum.reduceat(gains[by], first), key[first]
            owner = key // space
            sizes = np.bincount(owner)
            levels.append((key % space, most, np.cumsum(sizes) - sizes, sizes))
        weakest = self.items.weakest(np.maximum(self.least, self.scores[:, -1]))
        values = np.zeros(space, np.int64)
        waiting = [(len(levels) - 1, 0, np.arange(len(self.least)))]
        while waiting:
            level, node, items = waiting.pop()
            terms, gains, starts, sizes = levels[level]
            here = slice(starts[node], starts[node] + sizes[node])
            values[terms[here]] = gains[here]
            items = self.items.reaching(values, items, weakest)
            values[terms[here]] = 0
            if not len(items):
                continue
            below = range(node << FAN_BITS, min(len(levels[level - 1][2]), (node + 1) << FAN_BITS))
            if level > 1:
                waiting += [(level - 1, child, items) for child in below]
            else:
                self.score(ids[below.start : below.stop], levels[0], below, items)

    def score(self, ids: np.ndarray, documents: tuple, rows: range, items: np.ndarray) -> None:
        """Score the documents of a leaf exactly for the items that are left, and keep the best."""
        terms, gains, starts, sizes = documents
        exact = np.zeros((len(rows), len(self.items.weights)), np.int64)
        for i, row in enumerate(rows):
            here = slice(starts[row], starts[row] + sizes[row])
            exact[i, terms[here]] = gains[here]
        scores = self.items.sums(exact, 0, items).T
        scores = np.concatenate([self.scores[items], np.where(scores >= self.least[items][:, None], scores, 0)], axis=1)
        found = np.concatenate([self.ids[items], np.broadcast_to(ids, (len(items), len(ids)))], axis=1)
        best = np.lexsort((found, -scores), axis=1)[:, : self.k]
        self.scores[items] = np.take_along_axis(scores, best, 1)
        self.ids[items] = np.take_along_axis(found, best, 1)

    def results(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(number of the item, id, score)."""
        item, place = np.nonzero(self.scores > 0)
        return self.items.order[item], self.ids[item, place], self.scores[item, place]


def item_terms(items: DataFrame, item_col: str, text_col: str) -> DataFrame:
    """(item, terms): the distinct terms of each item that has any."""
    terms = F.regexp_extract_all(lower_ascii(F.coalesce(text_col, F.lit(""))), F.lit(TERMS), F.lit(0))
    grouped = items.select(F.col(item_col).alias("item"), terms.alias("terms")).groupBy("item")
    return grouped.agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("terms")))).alias("terms")).where(F.size("terms") > 0)


def vectors(docs: DataFrame, vocabulary: list[str], id_col: str, text_col: str) -> DataFrame:
    """(id, n, terms, counts): the number of a document's terms, and how often those of the vocabulary (by number) occur."""
    rows = docs.select(F.col(id_col).cast("bigint").alias("id"), F.coalesce(text_col, F.lit("")).alias("text"))
    data = np.frombuffer("\n".join(vocabulary).encode(), np.uint8)
    starts, ends, _ = word_spans(data, np.array([0, len(data)]), word_bytes(PLAIN_WORDS))
    hashes = word_hashes(data, starts, ends)
    by = np.argsort(hashes)
    known = hashes[by]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, last, data, offsets in text_slices(batch.column("text")):
                data = folded(data)
                starts, ends, bounds = word_spans(data, offsets, word_bytes(PLAIN_WORDS))
                words = word_hashes(data, starts, ends)
                place = np.minimum(np.searchsorted(known, words), len(known) - 1)
                hit = np.flatnonzero(known[place] == words)
                row = np.searchsorted(bounds, hit, "right") - 1
                key, counts = np.unique(row * len(known) + by[place[hit]], return_counts=True)
                ends_at = np.concatenate([[0], np.cumsum(np.bincount(key // len(known), minlength=last - first))]).astype(np.int32)
                lists = [pa.ListArray.from_arrays(pa.array(ends_at), pa.array(x.astype(np.int32))) for x in (key % len(known), counts)]
                yield pa.RecordBatch.from_arrays([batch.column("id").slice(first, last - first), pa.array(np.diff(bounds), pa.int64()), *lists], ["id", "n", "terms", "counts"])

    return rows.mapInArrow(run, "id bigint, n bigint, terms array<int>, counts array<int>")


def searched(rows: DataFrame, items: Items, k: int, least: np.ndarray, documents: int, length: int) -> DataFrame:
    """(item number, id, score): the best k of each task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search, held, entries = Search(items, k, least), [], 0

        def flush() -> None:
            if held:
                search.block(*[np.concatenate(part) for part in zip(*held, strict=True)])
                held.clear()

        for batch in batches:
            for first in range(0, batch.num_rows, BLOCK_ROWS // 4):
                part = batch.slice(first, BLOCK_ROWS // 4)
                terms, counts = (part.column(c).flatten().to_numpy(zero_copy_only=False).astype(np.int64) for c in ("terms", "counts"))
                sizes = part.column("terms").value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
                n = part.column("n").to_numpy(zero_copy_only=False).astype(np.int64)
                if len(n) and int(n.max()) * documents * 90 >= 1 << 63:
                    m = 10 + np.array([90 * int(x) * documents // length for x in n], np.int64)
                else:
                    m = 10 + 90 * n * documents // length
                values = 1_000_000_000 * counts // (1000 * counts + 8 * np.repeat(m, sizes))
                ids = part.column("id").fill_null(LOWEST).to_numpy(zero_copy_only=False)
                some = sizes > 0
                held.append((ids[some], sizes[some], terms, values))
                entries += len(terms)
                if sum(len(h[0]) for h in held) >= BLOCK_ROWS or entries >= BLOCK_ENTRIES:
                    flush()
                    entries = 0
        flush()
        number, ids, scores = search.results()
        ids = pa.array(ids, pa.int64(), mask=ids == LOWEST)
        yield pa.RecordBatch.from_arrays([pa.array(number, pa.int64()), ids, pa.array(scores, pa.int64())], ["number", "id", "score"])

    return rows.where(F.size("terms") > 0).select("id", "n", "terms", "counts").mapInArrow(run, "number bigint, id bigint, score bigint")


def best(found: DataFrame, by: str, k: int) -> DataFrame:
    """``found`` with ``rank``: the k of highest score of each ``by``, ties by id."""
    order = Window.partitionBy(by).orderBy(F.col("score").desc(), F.col("id").asc_nulls_first())
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def top_documents(docs: DataFrame, items: DataFrame, k: int = 10, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """Per item its ``k`` best documents: ``item``, ``rank`` from 1, ``id``, ``score``."""
    spark = docs.sparkSession
    batches_by_bytes(spark)
    asked = stored(item_terms(items, item_col, item_text), "items")
    blocks = max(1, -(-(asked.agg(F.sum(F.size("terms"))).first()[0] or 0) // BLOCK_TERMS))
    kind = f"item {asked.schema['item'].dataType.simpleString()}, rank int, id bigint, score bigint"
    out = spark.createDataFrame([], kind)
    for number in range(blocks):
        block = asked.where(F.pmod(F.xxhash64("item"), F.lit(blocks)) == number).collect()
        if block:
            out = out.unionByName(_searched_block(docs, block, k, id_col, text_col, kind))
    return out


def _searched_block(docs: DataFrame, block: list, k: int, id_col: str, text_col: str, kind: str) -> DataFrame:
    spark = docs.sparkSession
    vocabulary = sorted({t for row in block for t in row.terms})
    place = {t: i for i, t in enumerate(vocabulary)}
    rows = stored(vectors(docs, vocabulary, id_col, text_col), "vectors")
    totals = rows.agg(F.count_if(F.col("n") > 0).alias("documents"), F.sum("n").alias("length")).first()
    if not totals.documents:
        return spark.createDataFrame([], kind)
    held = {r.term: r.n for r in rows.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("n")).collect()}
    weights = np.array([math.floor(1000 * math.log((2 * totals.documents + 2) / (2 * held.get(i, 0) + 1))) for i in range(len(vocabulary))], np.int64)
    tree = Items([np.array([place[t] for t in row.terms], np.int64) for row in block], weights)
    least = np.zeros(len(block), np.int64)
    drawn = rows.where(F.rand(3) < min(1.0, SEED_ROWS / totals.documents))
    seeds = best(searched(drawn, tree, k, least, totals.documents, totals.length), "number", k).where(F.col("rank") == k)
    for row in seeds.select("number", "score").collect():
        least[row.number] = row.score
    found = best(searched(rows, tree, k, least[tree.order], totals.documents, totals.length), "number", k)
    named = spark.createDataFrame([(i, row["item"]) for i, row in enumerate(block)], f"number bigint, {kind.split(',')[0]}")
    return found.join(F.broadcast(named), "number").select("item", "rank", "id", "score")
