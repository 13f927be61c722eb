from __future__ import annotations

import random
import re

import numpy as np
import pytest

from twinframe.llm import jaccard
from twinframe.llm.components import components
from twinframe.llm.queries import op2_ngram_join

SF = "/root/testdata/sf0.001"


def grams(text: str | None, n: int) -> frozenset:
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return frozenset(tuple(words[i : i + n]) for i in range(len(words) - n + 1)) if len(words) >= n else frozenset([tuple(words)] if words else [])


def brute(rows: list[tuple], n: int, percent: int) -> dict:
    """id -> (size, smallest id of the component), by comparing all pairs."""
    sets = {i: grams(t, n) for i, t in rows}
    parent = {i: i for i in sets}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    ids = sorted(sets)
    for k, i in enumerate(ids):
        for j in ids[k + 1 :]:
            a, b = sets[i], sets[j]
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                x, y = root(i), root(j)
                parent[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), root(i)) for i in ids}


def corpus(rng: random.Random, n_docs: int) -> list[tuple]:
    """Groups of texts of many lengths with a few words changed, cut or added, and unrelated ones."""
    rows, words = [], [f"w{i}" for i in range(400)]
    while len(rows) < n_docs:
        base = rng.choices(words, k=rng.choice([1, 2, 3, 4, 8, 12, 13, 20, 30, 60, 150, 400]))
        for _ in range(rng.choice([1, 1, 2, 6, 15])):
            copy = list(base)
            for _ in range(rng.choice([0, 0, 1, 1, 2, 4])):
                at = rng.randrange(len(copy))
                copy[at : at + rng.choice([0, 1, 1])] = rng.choices(words, k=rng.choice([0, 1, 1]))
                copy = copy or ["w"]
            rows.append((len(rows), " ".join(copy)))
    return rows


@pytest.mark.parametrize(("seed", "n", "percent", "crowd"), [(1, 3, 90, 1), (2, 5, 80, 1), (3, 3, 90, 10**9), (4, 1, 80, 10**7)])
def test_against_all_pairs(spark, monkeypatch, seed, n, percent, crowd):
    # With as many classes as that in each band, deletions are worth their cost.
    plan = jaccard.allocate
    monkeypatch.setattr(jaccard, "allocate", lambda bounds, counts, p: plan(bounds, {b: c * crowd for b, c in counts.items()}, p))
    monkeypatch.setattr(jaccard, "BLOCK", 300)
    rows = corpus(random.Random(seed), 250)
    monkeypatch.setattr(jaccard, "SKETCHES", 7)
    found = jaccard.jaccard_components(spark.createDataFrame(rows, "doc_id bigint, text string"), n, percent).collect()
    assert {r.id: (r.n, r.component) for r in found} == brute(rows, n, percent)
    sets = {grams(t, n) for _, t in rows} - {frozenset()}
    links = {a: sum(a is not b and 100 * len(a & b) >= percent * len(a | b) for b in sets) for a in sets}
    assert {r.id: r.n_links for r in found} == {i: links.get(grams(t, n), 0) for i, t in rows}


def test_signatures_meet_whenever_the_threshold_is_reached():
    rng = np.random.default_rng(5)
    for percent in (80, 90):
        bounds = jaccard.bounds_up_to(600, percent)
        for double_up in (False, True):
            apart = [jaccard.most_apart(bounds, b, percent) for b in range(len(bounds) - 1)]
            doubles = [(a + 1) // 2 if double_up else 0 for a in apart]
            for k in range(400):
                spare = k % 4
                schemes = [jaccard.Scheme(a + 1 - d + spare, d, spare) for a, d in zip(apart, doubles, strict=True)]
                x = np.unique(rng.integers(0, 1 << 63, rng.integers(1, 400)).astype(np.uint64))
                lost = rng.random(len(x)) < rng.choice([0, 0.03, 0.05, 0.1])
                y = np.unique(np.concatenate([x[~lost], rng.integers(0, 1 << 63, rng.integers(0, 1 + len(x) // 12)).astype(np.uint64)]))
                if not len(y) or 100 * len(np.intersect1d(x, y)) < percent * len(np.union1d(x, y)):
                    continue
                low = min(int(np.searchsorted(bounds, len(s), "right")) - 1 for s in (x, y))
                sides = [jaccard.signatures(s, low, schemes[low]) for s in (x, y)]
                assert len(np.intersect1d(*sides))


def test_left_out_signatures_lose_no_partners():
    """Whatever the order of elements, so also one known from a sample only."""
    rng = np.random.default_rng(6)
    bounds = jaccard.bounds_up_to(600, 80)
    schemes = jaccard.allocate(bounds, {b: 5000 for b in range(len(bounds))}, 80)
    met = 0
    for _ in range(300):
        passage = rng.integers(0, 1 << 63, rng.integers(0, 80)).astype(np.uint64)
        x = np.unique(np.concatenate([passage, rng.integers(0, 1 << 63, rng.integers(1, 200)).astype(np.uint64)]))
        y = np.unique(np.concatenate([x[rng.random(len(x)) >= rng.choice([0, 0.03, 0.08, 0.1])], rng.integers(0, 1 << 63, rng.integers(0, 1 + len(x) // 12)).astype(np.uint64)]))
        if not len(y) or 100 * len(np.intersect1d(x, y)) < 80 * len(np.union1d(x, y)):
            continue
        known = np.sort(rng.choice(np.union1d(x, y), rng.integers(0, len(x) + 1)))
        often = rng.integers(2, 9, len(known))
        low = min(int(np.searchsorted(bounds, len(s), "right")) - 1 for s in (x, y))
        sides = [jaccard.signatures(s, low, schemes[low], jaccard.how_common(s, known, often)) for s in (x, y)]
        assert len(np.intersect1d(*sides))
        met += 1
    assert met > 100


def test_a_passage_of_many_texts_makes_no_cluster(spark, monkeypatch):
    """Sketches are dealt once or so, though a third of each text is the same passage; the copies among them are found."""
    rng = random.Random(4)
    passage = " ".join(f"p{i}" for i in range(40))
    rows = [(i, f"{passage} {' '.join(rng.choices([f'w{k}' for k in range(5000)], k=80))}") for i in range(400)]
    rows += [(1000 + i, t + " more") for i, t in rows[:40]]
    monkeypatch.setattr(jaccard, "SKETCHES", 16)
    dealt, made = jaccard._dealt, {}

    def counted(sets, payload):
        made[payload] = dealt(sets, payload).count()
        return dealt(sets, payload)

    monkeypatch.setattr(jaccard, "_dealt", counted)
    found = {r.id: r.component for r in jaccard.jaccard_components(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert found == {i: i % 1000 if i < 1040 else i for i, _ in rows}
    assert made["sketch"] <= 4 * len(rows)


def test_a_signature_takes_few_bytes_and_meets_its_likes(spark, monkeypatch):
    """Over several flushes and buckets, and with a signature that a third of all classes have."""
    rng = random.Random(8)
    words = [f"w{k}" for k in range(5000)]
    texts = [" ".join(rng.choices(words, k=60)) for _ in range(300)]
    texts += [t + f" more{i}" for i, t in enumerate(texts[:80])] + [f"{texts[299]} z{i}" for i in range(150)]
    docs = spark.createDataFrame([(t,) for t in texts], "text string").repartition(5)
    monkeypatch.setattr(jaccard, "FLUSH", 1000)
    bounds = jaccard.bounds_up_to(70, 80)
    schemes = jaccard.allocate(bounds, {b: 300 for b in range(len(bounds))}, 80)
    none = (np.zeros(0, np.uint64), np.zeros(0, np.int64))
    classes, having = {}, {}
    for t in texts:
        items = jaccard.ngram_sets(np.frombuffer(t.encode(), np.uint8), np.array([0, len(t)]), 3)[0]
        band = int(np.searchsorted(bounds, len(items), "right")) - 1
        owner = jaccard.digest(items)[0] % (1 << 48)
        classes[owner] = np.concatenate([jaccard.signatures(items, b, schemes[b]) for b in range(max(0, band - 1), band + 1)])
        for s in classes[owner]:
            having.setdefault(int(s), []).append(owner)
    signed = jaccard._signed(docs, 3, bounds, schemes, none, 50)
    assert signed.toArrow().nbytes < 14 * sum(map(len, classes.values()))
    wanted = spark.createDataFrame([(max(o, c[0]), min(o, c[0])) for c in having.values() for o in c if o != c[0]], "a bigint, b bigint")
    found = [{tuple(r) for r in components(x).collect()} for x in (jaccard._ties(signed), wanted)]
    assert found[0] == found[1] and len(found[0]) > 200


def test_sets_of_a_large_family_are_copied_to_few_blocks(spark, monkeypatch):
    """Copies of a set stay within a bound as the family grows; the links are those of all pairs."""
    rng = random.Random(9)
    base = [f"w{k}" for k in range(120)]
    monkeypatch.setattr(jaccard, "BLOCK", 1000)
    monkeypatch.setattr(jaccard, "SKETCHES", 6)
    rows = []
    for i in range(240):
        text = list(base)
        for _ in range(i % 7):
            text[rng.randrange(120)] = f"x{i}"
        rows.append((i, " ".join(text)))
    dealt, made = jaccard._dealt, {}

    def counted(sets, payload):
        made[payload] = dealt(sets, payload).groupBy("node", "cluster").count().agg({"count": "max"}).first()[0]
        return dealt(sets, payload)

    monkeypatch.setattr(jaccard, "_dealt", counted)
    found = {r.id: (r.n, r.component) for r in jaccard.jaccard_components(spark.createDataFrame(rows, "doc_id bigint, text string"), 3, 90).collect()}
    assert found == brute(rows, 3, 90)
    assert made["sketch"] <= 8 and made["items"] <= 8
    assert len({c for _, c in found.values()}) < 150


def test_edges(frame):
    docs = frame("doc_id bigint, text string, a string, n string, node string", (1, None, "", "", ""), (2, "", "", "", ""), (3, " \t ", "", "", ""), (4, "one two", "", "", ""), (5, "ONE  two", "", "", ""), (6, "one two", "", "", ""), (6, "one two", "", "", ""), (None, "one two", "", "", ""), (None, "alone here", "", "", ""))
    found = sorted((r.id or 0, r.n, r.component or 0) for r in jaccard.jaccard_components(docs, 3, 90).collect())
    assert found == [(0, 1, 0), (0, 1, 4), (1, 0, 1), (2, 0, 2), (3, 0, 3), (4, 1, 4), (5, 1, 4), (6, 1, 4), (6, 1, 4)]
    assert jaccard.jaccard_components(docs.limit(0)).count() == 0


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 140)] + [(7, 7), (200, 201), (201, 200)]
    found = {r.node: r.label for r in components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert found == {**{i: 0 for i in range(41)}, **{i: 100 for i in range(100, 140)}, 200: 200, 201: 200}


def test_query(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in op2_ngram_join(spark, SF).collect()} == brute(rows, 3, 90)


def test_one_of_each_group_stays(frame, spark):
    rows = corpus(random.Random(9), 150)
    wanted = {i for i, (_, c) in brute(rows, 5, 80).items() if i == c}
    docs = spark.createDataFrame([(*r, "x") for r in rows], "doc_id bigint, text string, label string")
    kept = jaccard.without_near_duplicates(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(wanted)
    docs = frame("doc_id bigint, text string, t string", (1, "", ""), (1, "", ""), (2, None, ""), (3, "a b", ""), (3, "a b", ""), (None, "a b", ""), (None, "c d", ""), (None, "c d", ""), (4, "A b", ""))
    assert sorted((r.doc_id or 0, r.text or "") for r in jaccard.without_near_duplicates(docs).collect()) == [(0, "c d"), (1, ""), (1, ""), (2, ""), (3, "a b")]
    assert jaccard.without_near_duplicates(docs.limit(0)).count() == 0
