from __future__ import annotations

import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from twinframe.llm import ranked

UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def terms(text: str | None) -> list[str]:
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", (text or "").translate(UPPER))


def brute(docs: list[tuple], items: list[tuple], k: int = 10) -> list[tuple]:
    counts = [(d, Counter(terms(t))) for d, t in docs]
    counts = [(d, c) for d, c in counts if c]
    total, length = len(counts), sum(sum(c.values()) for _, c in counts)
    df = Counter(t for _, c in counts for t in c)
    asked: dict = {}
    for i, t in items:
        asked.setdefault(i, set()).update(terms(t))
    out = []
    for i, wanted in asked.items():
        scored = []
        for d, c in counts:
            m = 10 + 90 * sum(c.values()) * total // length
            score = sum(math.floor(1000 * math.log((2 * total + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 8 * m)) for t in wanted if c[t])
            if score > 0:
                scored.append((-score, d is not None, d or 0, d))
        out += [(i, rank, s[3], -s[0]) for rank, s in enumerate(sorted(scored)[:k], 1)]
    return sorted(out, key=str)


def check(spark, docs: list[tuple], items: list[tuple], k: int = 10) -> list[tuple]:
    d = spark.createDataFrame([(*r, 1) for r in docs], "doc_id bigint, text string, n int").repartition(3)
    i = spark.createDataFrame([(*r, "x") for r in items], "item_id bigint, text string, terms string")
    out = sorted([tuple(r) for r in ranked.top_documents(d, i, k).select("item", "rank", "id", "score").collect()], key=str)
    assert out == brute(docs, items, k)
    return out


def texts(draw: random.Random, n: int, most: int) -> list[str]:
    """Words of very uneven frequency, some texts copied."""
    words = [f"w{i}" for i in range(300)]
    made = [" ".join(words[min(299, int(draw.paretovariate(0.6)))] for _ in range(draw.randint(0, most))) for _ in range(n)]
    return [draw.choice(made) if draw.random() < 0.3 else t for t in made]


def test_random_tables(spark, monkeypatch):
    """Small blocks and fans, so that nodes of all levels are pruned and opened; many ties between copies."""
    draw = random.Random(3)
    monkeypatch.setattr(ranked, "BLOCK_ROWS", 64)
    monkeypatch.setattr(ranked, "SEED_ROWS", 50)
    docs = list(enumerate(texts(draw, 600, 60)))
    draw.shuffle(docs)
    assert len(check(spark, docs, list(enumerate(texts(draw, 70, 12))))) > 500


def test_blocks_of_items_make_no_difference(spark, monkeypatch):
    draw = random.Random(4)
    monkeypatch.setattr(ranked, "BLOCK_TERMS", 40)
    check(spark, list(enumerate(texts(draw, 80, 30))), list(enumerate(texts(draw, 20, 9))), 3)


@pytest.mark.parametrize(
    ("docs", "items"),
    [
        ([], [(1, "a")]),
        ([(1, "a b")], []),
        ([(1, None), (2, "")], [(1, "a"), (2, None)]),
        ([(None, "A1 b"), (5, "a1 B"), (5, "a1 b"), (4, "a1 b")], [(1, "a1"), (1, "b"), (None, "A1-b"), (2, "zz"), (3, "")]),
        ([(1, "É é Ab " * 30_000), (2, "é ab"), (3, "x")], [(1, "É"), (2, "é AB _ x")]),
    ],
)
def test_odd_rows(spark, docs, items):
    check(spark, docs, items)


def test_bounds_hold_at_every_pair_of_nodes():
    """The bound of a node of items is no less than the score of any item below, and a high k-th score prunes all."""
    draw = np.random.default_rng(1)
    weights = draw.integers(1, 1000, 50)
    sets = [draw.choice(50, draw.integers(1, 9), replace=False) for _ in range(100)]
    tree = ranked.Items(sets, weights)
    values = draw.integers(0, 100, 50)
    exact = tree.sums(values, 0, np.arange(100))
    assert [int(values[sets[i]].sum()) for i in tree.order] == exact.tolist()
    for level in range(len(tree.levels)):
        bound = tree.sums(values, level, np.arange(len(tree.levels[level][1])))
        assert all(bound[i >> (3 * level)] >= exact[i] for i in range(100))
    assert not len(tree.reaching(values, np.arange(100), tree.weakest(exact + 1)))
    assert tree.reaching(values, np.arange(100), tree.weakest(exact)).tolist() == np.flatnonzero(exact > 0).tolist()
