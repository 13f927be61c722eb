"""Document fingerprints: invertible Bloom lookup sketches of paragraph digests.

A paragraph is a line, a longer line one paragraph per ``PIECE`` code points; blank paragraphs do not count. A text is the
set of its paragraphs' 64-bit digests. A sketch has three parts of equally many cells; a digest goes to one cell of each
part, and a cell holds how many digests it got, their exclusive or, and that of a second hash of each. Sketches subtract
cell by cell: what two texts share is gone, and peeling recovers the rest. A cell left with one digest gives it away, the
digest is taken out of its two other cells, which may leave one there, and so on. If cells are left over, the pair is
tried again with more cells.

A first sketch of fixed size is built, subtracted and peeled within the row. Pairs with cells left over are retried larger:
their digests are dealt by hash to groups with a sketch of that size each, groups that still do not peel to groups of
their own, and so on, until all do. Groups are rows of a plain grouping, so a book takes many tasks.

Null texts read as empty; texts without a paragraph have an empty sketch and are all alike (likeness 1). Texts with equal
paragraphs have equal sketches, whatever the order and number of them. Repeated rows are answered alike, extra columns
ignored, an empty table gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from twinframe.session import stored

#: Code points of a paragraph at most.
PIECE = 160
PARTS = 3
#: Cells of one part of a fingerprint, and how many times as many the next try has: so many at least, and so that a group
#: of 3 * CELLS cells has about GROUP digests.
CELLS, GROWTH, GROUP = 16, 4, 12
#: Rounds over the three parts in one try.
ROUNDS = 5
#: Rows of a stretch of the order, stretches at most, and sampled rows for each.
STRETCH_ROWS, STRETCHES, SAMPLED = 2000, 1 << 16, 64


def digests(text: Column) -> Column:
    """The distinct digests of a text's paragraphs, in order."""
    pieces = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(f"(?d).{{1,{PIECE}}}"), F.lit(0))
    solid = F.filter(pieces, lambda piece: F.length(F.btrim(piece, F.lit(" \t\r\f\x0b"))) > 0)
    return F.array_sort(F.array_distinct(F.transform(solid, lambda piece: F.xxhash64(piece))))


def _bound(value: Column, body) -> Column:
    """``body(value)`` with the value computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _entry(n: Column, key: Column, check: Column) -> Column:
    """A digest with the cell that it has in each part: bits of one more hash."""
    digest = F.xxhash64(key)
    at = [F.shiftright(digest, 8 * p).bitwiseAND(F.lit(CELLS - 1)).cast("int").alias(f"at{p}") for p in range(PARTS)]
    return F.struct(n.alias("n"), key.alias("key"), check.alias("check"), *at)


def _cell(n: Column, key: Column, check: Column) -> Column:
    return F.struct(n.cast("int").alias("n"), key.cast("bigint").alias("key"), check.cast("int").alias("check"))


def _less(cell: Column, other: Column) -> Column:
    return _cell(cell["n"] - other["n"], cell["key"].bitwiseXOR(other["key"]), cell["check"].bitwiseXOR(other["check"]))


def _cleared(cells: Column, entries: Column) -> Column:
    """``cells`` without the ``entries``."""

    def part(p: int) -> Column:
        cleared = lambda cell, i: F.aggregate(F.filter(entries, lambda x: x[f"at{p}"] == i), cell, _less)
        return F.transform(F.slice(cells, p * CELLS + 1, CELLS), cleared)

    return F.concat(*map(part, range(PARTS)))


def sketch(keys: Column) -> Column:
    """The cells of a set of digests: array of (n, key, check)."""
    empty = F.array_repeat(_cell(F.lit(0), F.lit(0), F.lit(0)), PARTS * CELLS)
    entries = F.transform(keys, lambda key: _entry(F.lit(-1), key, F.hash(key)))
    return _bound(entries, lambda bound: _cleared(empty, bound))


def subtracted(left: Column, right: Column) -> Column:
    return F.zip_with(left, right, _less)


def as_text(cells: Column) -> Column:
    """A sketch as hexadecimal text: per cell its number, 16 digits of keys and 8 of checks, parted by commas."""
    shown = lambda cell: F.concat(F.hex(cell["n"]), F.lit("."), F.lpad(F.hex(cell["key"]), 16, "0"), F.lpad(F.hex(cell["check"].cast("bigint").bitwiseAND(F.lit(0xFFFFFFFF))), 8, "0"))
    return F.array_join(F.transform(cells, shown), ",")


def peeled(cells: Column) -> Column:
    """The digests (key, n: 1 or -1) that a difference of sketches holds, null if cells are left over.

    The parts take turns: a digest has one cell in each, so none is found twice.
    """

    def step(state: Column, turn: Column) -> Column:
        part = turn % PARTS
        here = F.transform(F.slice(state["cells"], part * CELLS + 1, CELLS), lambda c, i: F.struct(c.alias("c"), i.alias("i")))
        alone = F.filter(here, lambda x: (F.abs(x["c"]["n"]) == 1) & (x["c"]["check"] == F.hash(x["c"]["key"])))
        placed = F.transform(alone, lambda x: F.struct(_entry(x["c"]["n"], x["c"]["key"], x["c"]["check"]).alias("e"), x["i"].alias("i")))
        own = lambda x: F.when(part == 0, x["e"]["at0"]).when(part == 1, x["e"]["at1"]).otherwise(x["e"]["at2"]) == x["i"]
        pure = F.transform(F.filter(placed, own), lambda x: x["e"])
        more = lambda bound: F.transform(bound, lambda c: F.struct(c["key"].alias("key"), c["n"].alias("n")))
        next_state = lambda bound: F.struct(_cleared(state["cells"], bound).alias("cells"), F.concat(state["found"], more(bound)).alias("found"))
        return _bound(pure, lambda bound: F.when(F.size(bound) == 0, state).otherwise(next_state(bound)))

    start = F.struct(cells.alias("cells"), F.array().cast("array<struct<key:bigint,n:int>>").alias("found"))
    over = lambda state: F.exists(state["cells"], lambda c: (c["n"] != 0) | (c["key"] != 0) | (c["check"] != 0))
    return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS * PARTS - 1)), start, step, lambda state: F.when(~over(state), state["found"]))


def differences(pairs: DataFrame, keys: list[str]) -> DataFrame:
    """Per pair: ``keys``, ``only_left`` and ``only_right``, the digests that one side alone has.

    ``pairs``: ``keys``, which tell pairs apart, and two arrays of distinct digests, ``left`` and ``right``.
    """
    found = []
    now = pairs.select(*keys, F.lit(0).cast("bigint").alias("part"), "left", "right")
    peel = peeled(subtracted(sketch(F.col("left")), sketch(F.col("right"))))
    signed = lambda side, sign: F.transform(side, lambda key: F.struct(key.alias("key"), F.lit(sign).alias("n")))
    side = lambda sign: F.collect_list(F.when(F.col("n") == sign, F.col("key")))
    groups = F.greatest(F.lit(GROWTH), F.ceil((F.size("left") + F.size("right")) / GROUP))
    while True:
        tried = stored(now.withColumn("found", peel), "peeled")
        found.append(tried.where("found IS NOT NULL").select(*keys, "found"))
        failed = tried.where("found IS NULL")
        if failed.isEmpty():
            break
        dealt = failed.select(*keys, "part", groups.alias("groups"), F.inline(F.concat(signed("left", 1), signed("right", -1))))
        dealt = dealt.withColumn("part", F.xxhash64("part", F.pmod(F.xxhash64("part", "key"), "groups")))
        now = dealt.groupBy(*keys, "part").agg(side(1).alias("left"), side(-1).alias("right"))
    united = found[0]
    for more in found[1:]:
        united = united.unionByName(more)
    of = lambda sign: F.transform(F.filter("found", lambda x: x["n"] == sign), lambda x: x["key"])
    return united.groupBy(*keys).agg(F.flatten(F.collect_list("found")).alias("found")).select(*keys, of(1).alias("only_left"), of(-1).alias("only_right"))


def likeness(size_left: Column, size_right: Column, differing: Column) -> Column:
    """The share of digests that both sets have, 1 if both are empty."""
    shared = (size_left + size_right - differing) / 2
    return F.when(size_left + size_right == 0, F.lit(1.0)).otherwise(shared / (size_left + size_right - shared))


def with_next(rows: DataFrame, order: list[str], columns: list[str]) -> DataFrame:
    """``rows`` with the ``columns`` of the next row in descending ``order`` as ``next_<column>`` (after the last: the first), ``stretch`` and ``place``, which number the rows.

    Rows are cut into stretches at bounds from a sample of the order (it decides on sizes only), so that each stretch is
    sorted in one task and none is much larger than its share; rows that tie over several bounds are spread over the
    stretches between. The first row of a stretch is dealt to the one that comes before it as well.
    """
    total = rows.count()
    count = max(1, min(STRETCHES, total // STRETCH_ROWS))
    keyed = rows.withColumn("at", F.struct(*order))
    sampled = keyed.where(F.rand(13) < min(1.0, SAMPLED * count / max(1, total))).select("at")
    ranked = stored(sampled.select("at", F.row_number().over(Window.orderBy("at")).alias("rank")), "sample")
    step = max(1, ranked.count() // count)
    bounds = stored(ranked.where(F.col("rank") % step == 0).agg(F.array_sort(F.collect_list("at")).alias("bounds")), "bounds")
    steps = F.array(*[F.lit(1 << k) for k in range(count.bit_length(), -1, -1)])

    def bounds_where(holds) -> Column:
        reached = lambda at, by: F.get(F.col("bounds"), at + by - 1)
        return F.aggregate(steps, F.lit(0), lambda at, by: F.when((at + by <= F.size("bounds")) & holds(reached(at, by)), at + by).otherwise(at))

    searched = keyed.withColumn("bounds", bounds.select("bounds").scalar())
    searched = searched.withColumns({"below": bounds_where(lambda x: x < F.col("at")), "upto": bounds_where(lambda x: x <= F.col("at"))})
    placed = searched.withColumn("stretch", F.col("below") + F.floor(F.rand(17) * (F.col("upto") - F.col("below") + 1)).cast("int")).drop("bounds", "below", "upto")
    heads = placed.groupBy("stretch").agg(F.max("at").alias("at"))
    following = Window.orderBy("stretch")
    lowest = F.first("stretch").over(following.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    heads = stored(heads.select("stretch", "at", F.coalesce(F.lead("stretch").over(following), lowest).alias("goes")), "heads")
    copies = placed.join(F.broadcast(heads), ["stretch", "at"], "left")
    kept = F.struct(F.col("stretch"), F.lit(False).alias("copy"))
    both = F.when(F.col("goes").isNull(), F.array(kept)).otherwise(F.array(kept, F.struct(F.col("goes").alias("stretch"), F.lit(True).alias("copy"))))
    dealt = copies.withColumn("dealt", F.explode(both)).select(*rows.columns, "at", "dealt.stretch", "dealt.copy")
    window = Window.partitionBy("stretch").orderBy("copy", F.col("at").desc())
    led = dealt.withColumns({**{f"next_{c}": F.lead(c).over(window) for c in columns}, "place": F.row_number().over(window)})
    return led.where("NOT copy").drop("at", "copy")


def edited(text: Column, following: Column) -> Column:
    """``text`` with the last half of its code points replaced by as many of the start of the following text (or all)."""
    half = F.floor(F.length(text) / 2).cast("int")
    return F.concat(F.left(text, F.length(text) - half), F.left(following, half))


def compared(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document ``id``, ``n_chars``, ``edited_sha256``, ``fingerprint``, ``edited_fingerprint``, ``near_edited``, ``near_next``: likeness to its edited text and to the next document in descending order of ids (then of text hashes), both from recovered differences."""
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(text_col, F.lit("")).alias("text"))
    rows = rows.withColumns({"t": F.xxhash64("text"), "a": digests(F.col("text"))})
    led = with_next(rows, ["id", "t"], ["text", "a"]).withColumn("edited", edited(F.col("text"), F.col("next_text")))
    versions = led.select("stretch", "place", "id", F.length("text").cast("bigint").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"), "a", digests(F.col("edited")).alias("e"), F.col("next_a").alias("x"))
    sketches = versions.withColumns({f"s_{c}": sketch(F.col(c)) for c in "aex"})
    first = {f"d_{c}": F.coalesce(F.size(peeled(subtracted(F.col("s_a"), F.col(f"s_{c}")))), F.lit(-1)) for c in "ex"}
    first = stored(sketches.withColumns(first).drop("s_a", "s_e", "s_x"), "versions")

    retried = F.filter(F.array(*[F.struct(F.lit(c).alias("which"), F.col(f"d_{c}").alias("d"), F.col("a").alias("left"), F.col(c).alias("right")) for c in "ex"]), lambda x: x["d"] < 0)
    open_rows = F.least("d_e", "d_x") < 0
    pairs = first.where(open_rows).select("stretch", "place", F.inline(retried))
    found = differences(pairs, ["stretch", "place", "which"]).select("stretch", "place", "which", (F.size("only_left") + F.size("only_right")).alias("d"))
    apart = found.groupBy("stretch", "place").agg(*[F.max(F.when(F.col("which") == c, F.col("d"))).alias(f"r_{c}") for c in "ex"])
    late = first.where(open_rows).join(apart, ["stretch", "place"]).withColumns({f"d_{c}": F.coalesce(f"r_{c}", f"d_{c}") for c in "ex"}).drop("r_e", "r_x")
    done = first.where(~open_rows).unionByName(late)
    near = [likeness(F.size("a"), F.size(c), F.col(f"d_{c}")).alias(name) for c, name in (("e", "near_edited"), ("x", "near_next"))]
    shown = [as_text(sketch(F.col(c))).alias(name) for c, name in (("a", "fingerprint"), ("e", "edited_fingerprint"))]
    return done.select("id", "n_chars", "edited_sha256", *shown, *near)
