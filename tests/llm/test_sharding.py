from __future__ import annotations

import collections
import zlib

from pyspark.sql import functions as F

from twinframe.llm import sharding
from twinframe.llm.queries import op8_sharding

SF = "/root/testdata/sf0.01"


def shards(spark, cluster, rows=20_000) -> dict[int, int]:
    return {r.id: r.s for r in spark.range(rows).select("id", sharding.shard_of([F.col("id")], cluster).alias("s")).collect()}


def region(s: int) -> int:
    return s // sharding.REGION


def test_rows_follow_weights_and_moves_stay_in_changed_subtrees(spark):
    even = shards(spark, sharding.tree(24))
    counts = collections.Counter(even.values())
    assert set(counts) == set(range(24))
    assert all(abs(n - 20_000 / 24) < 5 * (20_000 / 24) ** 0.5 for n in counts.values())
    heavy = shards(spark, sharding.tree(24, weights={5: 3.0}))
    assert 2.5 < collections.Counter(heavy.values())[5] / (20_000 * 1 / 26) < 3.5
    for i, s in even.items():
        # Region 0 and its second rack became heavier: rows come in, none leave for elsewhere.
        assert s == heavy[i] or region(heavy[i]) == 0
        if region(s) == 0:
            assert s == heavy[i] or heavy[i] in range(4, 8)
        if s in range(4, 8):
            assert heavy[i] in (s, 5)


def test_one_more_shard_takes_rows_only_into_itself(spark):
    before = shards(spark, sharding.tree(24))
    for n in (25, 26, 27):
        after = shards(spark, sharding.tree(n))
        moved = [i for i in before if before[i] != after[i]]
        assert all(after[i] == n - 1 for i in moved)
        assert abs(len(moved) - 20_000 / n) < 5 * (20_000 / n) ** 0.5
        before = after


def test_weightless_children_get_nothing(spark):
    found = shards(spark, sharding.tree(24, weights={s: 0.0 for s in range(9)}), 4000)
    assert set(found.values()) == set(range(9, 24))


def test_slots_and_edges(frame, monkeypatch):
    monkeypatch.setattr(sharding, "CHUNK_ROWS", 2)
    rows = [(i % 50, "text" * (i % 3), "", "") for i in range(400)] + [(None, None, "", ""), (None, "é", "", ""), (7, "x" * 300_000, "", "")]
    docs = frame("doc_id bigint, text string, shard string, size string", *rows)
    found = sharding.sharded(docs, sharding.tree(24), sharding.tree(25)).collect()
    assert sorted((r.id or -1, r.size, r.text_crc32) for r in found) == sorted((i if i else -1 if i is None else i or -1, 8 + len((t or "").encode()), zlib.crc32((t or "").encode())) for i, t, *_ in rows)
    by_shard = collections.defaultdict(list)
    for r in found:
        by_shard[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in by_shard.values())
    assert sharding.sharded(docs.limit(0), sharding.tree(24)).count() == 0


def test_query(spark):
    rows = op8_sharding(spark, SF).collect()
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    assert sorted(r.doc_id for r in rows) == sorted(texts)
    by_shard = collections.defaultdict(list)
    for r in rows:
        data = texts[r.doc_id].encode()
        assert (r.size, r.text_crc32, r.law) == (len(data) + 8, zlib.crc32(data), "key")
        assert r.grown_shard in (r.shard, 24)
        by_shard[r.shard].append(r.slot)
    assert set(by_shard) <= set(range(24))
    assert all(sorted(s) == list(range(len(s))) for s in by_shard.values())
