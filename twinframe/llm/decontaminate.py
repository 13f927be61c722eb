"""Benchmark passages in training texts, by spaced seeds.

Words are runs of letters, digits and non-ASCII characters, in lower case. At every place of every text a hash is taken of
the words that each mask looks at; the others may differ. A hash that a benchmark item has too is a hit, which names the
item and the shift between the two texts. Around each distinct shift the item is laid on the text and compared word by
word: the document contains the item if some ``WINDOW`` neighbouring words of it agree in at least four of five places.
The first mask meets every such window (a test tries all), so nothing is lost to hashing. A shorter item of n words must
agree in all but 2n/13 of them, rounded down: one from 7 words on, none below. Items of 7 to 10 words have a mask of three
words of their own, which one changed word cannot hide, and those of up to four words have one of their length. Masks that
no item needs are not looked for. Items without a word or an id are not searched.

Null and empty texts contain nothing. Repeated rows are answered alike; the same item at several places of a text counts
once, where it fits best, then first. Rows with a null id are answered as any other. Extra columns are ignored. An empty
benchmark or corpus gives an empty table.

Everything is built-in functions. Places are rows only between two operators of one compiled stage: they are made, hashed
and probed there, and hits alone leave it. That needs the benchmark's hashes in memory, so they are broadcast if counted
below ``BROADCAST_ROWS``; a larger benchmark is taken in parts of that size, one pass of the corpus each.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from twinframe.session import stored

#: Places looked at; the first finds any 13 words of which 11 agree, the second any 11 or 12 of which all but one do.
MASKS = ((0, 1, 3, 6, 7), (0, 1, 2, 3, 4))
WINDOW = 13
#: For shorter items: the least and most words that an item may have to need the mask.
SHORT_MASKS = (((0,), 1, 1), ((0, 1), 2, 2), ((0, 1, 2), 3, 3), ((0, 1, 2, 3), 4, 4), ((0, 1, 2), 7, 10))
#: Hashes or hits (24 bytes each) that may be broadcast at once.
BROADCAST_ROWS = 1_000_000
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words_of(text: str) -> Column:
    """The words of a text; a separator at an end leaves an empty word there, which no item has."""
    return F.split(F.lower(text), SEPARATORS)


def masks_for(items: DataFrame) -> list[tuple[tuple[int, ...], int, int]]:
    """The masks that some of the ``items`` need, with the least and most words of an item that they are for."""
    long = [(mask, len(MASKS[1]), 1 << 30) for mask in MASKS]
    needed = items.agg(*[F.coalesce(F.bool_or(F.size("asked").between(low, high)), F.lit(False)) for _, low, high in SHORT_MASKS]).first()
    return long + [short for short, some in zip(SHORT_MASKS, needed, strict=True) if some]


def seeds(rows: DataFrame, keep: list[str], masks: list[tuple[tuple[int, ...], int, int]], of_items: bool = False) -> DataFrame:
    """``keep``, place and hash for each mask at each place of ``words``; ``of_items`` only those masks that are for items of that size."""
    least = min(len(mask) for mask, _, _ in masks)
    size = F.size("words")
    placed = rows.select(*keep, "words", F.explode(F.when(size >= least, F.sequence(F.lit(0), size - least))).alias("place"))

    def seed(mask: tuple[int, ...], low: int, high: int) -> Column:
        looked = F.xxhash64(F.lit(str(mask)), *[F.get("words", F.col("place") + k) for k in mask])
        fits = F.col("place") + mask[-1] < size
        return F.when(fits & size.between(low, high) if of_items else fits, looked)

    hashed = F.array(*[seed(*mask) for mask in masks])
    return placed.select(*keep, "place", F.explode(hashed).alias("seed")).where("seed IS NOT NULL")


def _hits(docs: DataFrame, marks: DataFrame, masks: list[tuple[tuple[int, ...], int, int]]) -> DataFrame:
    """(id, t, item, shift): which item may lie at which shift of which text."""
    rows = docs.select("id", F.xxhash64("text").alias("t"), words_of("text").alias("words"))
    met = seeds(rows, ["id", "t"], masks).join(F.broadcast(marks), "seed")
    return met.select("id", "t", "item", (F.col("place") - F.col("at")).alias("shift")).distinct()


def contaminations(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """One row per document and item that it contains: ``id``, ``t`` (hash of the text), ``item``, ``first_word`` (place of the item's start in the text), ``n_words`` (of the item), ``n_equal`` (words that agree)."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    items = benchmark.select(F.col(item_col).alias("item"), F.array_remove(words_of(item_text), "").alias("asked")).where(F.col("item").isNotNull() & (F.size("asked") > 0))
    masks = masks_for(items)
    marks = stored(seeds(items.withColumnRenamed("asked", "words"), ["item"], masks, of_items=True).select("item", F.col("place").alias("at"), "seed").distinct(), "marks")
    parts = -(-marks.count() // BROADCAST_ROWS)
    if parts > 1:
        cut = F.pmod(F.xxhash64("item", "seed"), F.lit(parts))
        hits = reduce(DataFrame.union, [_hits(rows, marks.where(cut == k), masks) for k in range(parts)]).distinct()
    else:
        hits = _hits(rows, marks, masks)
    hits = stored(hits, "hits")
    few = hits.count() <= BROADCAST_ROWS

    asked = items.groupBy("item").agg(F.collect_set("asked").alias("asked")).select("item", F.explode("asked").alias("asked"))
    wanted = hits.join(asked, "item")
    texts = rows.withColumn("t", F.xxhash64("text"))
    keys = hits.select("id", "t").distinct()
    same = lambda a, b: F.col(f"{a}.id").eqNullSafe(F.col(f"{b}.id")) & (F.col(f"{a}.t") == F.col(f"{b}.t"))
    if few:
        keys = F.broadcast(keys)
    read = texts.alias("x").join(keys.alias("k"), same("x", "k"), "left_semi").dropDuplicates(["id", "t"]).select("id", "t", words_of("text").alias("words"))
    laid = read.alias("r").join(wanted.alias("w"), same("r", "w")).select("r.id", "r.t", "words", "item", "shift", "asked")
    equal = F.transform("asked", lambda word, k: F.when(F.get("words", k + F.col("shift")) == word, 1).otherwise(0))
    laid = laid.select("id", "t", "item", "shift", F.size("asked").alias("n_words"), equal.alias("equal"))
    reach = F.least("n_words", F.lit(WINDOW))
    best = F.array_max(F.transform(F.sequence(F.lit(1), F.col("n_words") - reach + 1), lambda at: F.aggregate(F.slice("equal", at, reach), F.lit(0), lambda a, b: a + b)))
    found = laid.withColumn("best", best).where(F.when(F.col("n_words") < WINDOW, F.col("best") >= F.col("n_words") - F.floor(2 * F.col("n_words") / WINDOW)).otherwise(5 * F.col("best") >= 4 * WINDOW))
    found = found.withColumn("n_equal", F.aggregate("equal", F.lit(0), lambda a, b: a + b))
    one = found.groupBy("id", "t", "item").agg(F.max(F.struct("n_equal", -F.col("shift"), "n_words")).alias("x"))
    return one.select("id", "t", "item", (-F.col("x.col2")).alias("first_word"), F.col("x.n_words").alias("n_words"), F.col("x.n_equal").alias("n_equal"))


def without_contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents that contain no item, with their columns."""
    found = stored(contaminations(docs, benchmark, id_col, text_col).select("id", "t").distinct(), "contaminated")
    if found.count() <= BROADCAST_ROWS:
        found = F.broadcast(found)
    return docs.join(found, docs[id_col].eqNullSafe(found["id"]) & (F.xxhash64(docs[text_col]) == found["t"]), "left_anti")
