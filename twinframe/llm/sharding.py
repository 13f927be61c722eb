"""Shards by a hierarchical weighted hash tree: region, rack, shard.

A row descends from the root. At each level every child draws a number from the hash of the row's key and the child's
path, exponentially distributed with the weight below that child as its rate; the smallest draw wins, so a child gets
rows in proportion to its weight. A draw depends on nothing but key, path and weight: if weights change, rows move only
between the changed subtrees and from or to them, and within unchanged subtrees nothing moves.

``tree(n, base)`` puts the first ``base`` shards into regions of two racks of four. Each later shard opens a region of its
own, so that it takes rows into itself and no others move, until the tree is laid out anew with a larger base.

Slots number the rows of a shard from 0 without gaps. Equal rows are counted and numbered as one group; groups are summed
in chunks of a shard, and chunks along the shard, so no task sees a whole shard and a hot key is one row.

The key decides, so all rows of one id, null ids among them, share a shard. Null texts have no bytes and the checksum of
an empty text. Extra columns are ignored. An empty table gives an empty table.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

REGION, RACK = 8, 4
#: Rows of a chunk of a shard.
CHUNK_ROWS = 16_384

Tree = dict[str, dict[str, dict[int, float]]]


def tree(shards: int, base: int = 24, weights: dict[int, float] | None = None) -> Tree:
    """Regions of racks of shards with their weights, 1 unless given."""
    out: Tree = {}
    for s in range(shards):
        region, rack = (f"region{s // REGION}", f"rack{s % REGION // RACK}") if s < base else (f"later{s}", "rack0")
        out.setdefault(region, {}).setdefault(rack, {})[s] = (weights or {}).get(s, 1.0)
    return out


def draw(key: list[Column], path: str, weight: float) -> Column:
    """-ln(u) / weight, u uniform in (0, 1)."""
    u = (F.shiftrightunsigned(F.xxhash64(*key, F.lit(path)), 11) + F.lit(0.5)) / F.lit(float(1 << 53))
    return -F.log(u) / F.lit(float(weight))


def _winner(key: list[Column], children: dict[str, tuple[object, float]]) -> Column:
    """The value of the child with the smallest draw; children: path to (value, weight)."""
    draws = [F.struct(draw(key, path, w).alias("d"), F.lit(value).alias("v")) for path, (value, w) in children.items() if w > 0]
    return F.array_min(F.array(*draws))["v"] if len(draws) > 1 else F.lit(next(v for v, w in children.values() if w > 0))


def shard_of(key: list[Column], cluster: Tree) -> Column:
    """The shard of a row."""
    total = lambda racks: sum(sum(r.values()) for r in racks.values())
    region = _winner(key, {r: (r, total(racks)) for r, racks in cluster.items()})
    pick = lambda chosen, cases: reduce(lambda rest, kv: F.when(chosen == kv[0], kv[1]).otherwise(rest), list(cases.items())[1:], next(iter(cases.values())))

    def within(name: str, racks: dict[str, dict[int, float]]) -> Column:
        rack = _winner(key, {f"{name}/{k}": (k, sum(s.values())) for k, s in racks.items()})
        return pick(rack, {k: _winner(key, {f"{name}/{k}/{s}": (s, w) for s, w in shards.items()}) for k, shards in racks.items() if sum(shards.values()) > 0})

    return pick(region, {name: within(name, racks) for name, racks in cluster.items() if total(racks) > 0}).cast("int")


def sharded(docs: DataFrame, cluster: Tree, grown: Tree | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: ``id``, ``size``, ``text_crc32``, ``shard``, ``slot`` and ``grown_shard`` (null unless a grown tree is given)."""
    key = [F.col(id_col)]
    rows = docs.select(
        F.col(id_col).alias("id"),
        (F.coalesce(F.octet_length(text_col), F.lit(0)) + 8).cast("bigint").alias("size"),
        F.crc32(F.coalesce(text_col, F.lit(""))).alias("text_crc32"),
        shard_of(key, cluster).alias("shard"),
        (shard_of(key, grown) if grown else F.lit(None).cast("int")).alias("grown_shard"),
    )
    n_shards = sum(len(s) for racks in cluster.values() for s in racks.values())
    chunks = max(1, -(-docs.count() // (n_shards * CHUNK_ROWS)))
    groups = rows.groupBy(*rows.columns).agg(F.count("*").alias("rows"))
    groups = groups.withColumn("chunk", F.pmod(F.xxhash64("id", "size", "text_crc32"), F.lit(chunks)))
    inside = Window.partitionBy("shard", "chunk").orderBy("id", "size", "text_crc32").rowsBetween(Window.unboundedPreceding, -1)
    begun = groups.withColumn("inside", F.coalesce(F.sum("rows").over(inside), F.lit(0)))
    totals = groups.groupBy("shard", "chunk").agg(F.sum("rows").alias("all"))
    before = Window.partitionBy("shard").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select("shard", "chunk", F.coalesce(F.sum("all").over(before), F.lit(0)).alias("start"))
    placed = begun.join(starts, ["shard", "chunk"]).withColumn("first", F.col("start") + F.col("inside"))
    slots = placed.withColumn("slot", F.explode(F.sequence(F.col("first"), F.col("first") + F.col("rows") - 1)))
    return slots.select("id", "size", "text_crc32", "shard", "slot", "grown_shard")
