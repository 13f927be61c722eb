from __future__ import annotations

import itertools
import random
import re

import pytest

from twinframe.llm import decontaminate
from twinframe.llm.queries import op5_decontamination

SF = "/root/testdata/sf0.001"


def words(text: str | None) -> list[str]:
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").lower())


def brute(docs, items) -> set:
    """(doc, item) with a window that agrees in four of five places, at any shift; short items in all but 2n/13 words."""
    out = set()
    for (d, text), (i, asked) in itertools.product(docs, items):
        w, q = words(text), words(asked)
        if not q:
            continue
        reach = min(len(q), 13)
        for shift in range(-len(q) + 1, len(w)):
            same = [0 <= k + shift < len(w) and w[k + shift] == x for k, x in enumerate(q)]
            best = max(sum(same[a : a + reach]) for a in range(len(q) - reach + 1))
            if best >= reach - 2 * len(q) // 13 if len(q) < 13 else 5 * best >= 4 * 13:
                out.add((d, i))
                break
    return out


def test_first_mask_meets_any_two_substitutions():
    mask = decontaminate.MASKS[0]
    for changed in itertools.combinations(range(decontaminate.WINDOW), 2):
        assert any(not any(at + k in changed for k in mask) for at in range(decontaminate.WINDOW - mask[-1]))


@pytest.mark.parametrize("parts", [1_000_000, 50])
def test_against_every_shift(spark, monkeypatch, parts):
    monkeypatch.setattr(decontaminate, "BROADCAST_ROWS", parts)
    rng = random.Random(4)
    vocabulary = [f"w{i}" for i in range(60)] + ["é", "Ünd", "x1"]
    items = [(i, " ".join(rng.choices(vocabulary, k=rng.choice([2, 5, 8, 13, 14, 25, 40])))) for i in range(25)]
    docs = [(900, None), (901, ""), (902, "..."), (903, items[0][1].upper())]
    for d in range(120):
        text = rng.choices(vocabulary, k=rng.choice([0, 5, 30, 200]))
        q = words(rng.choice(items)[1])
        cut = rng.randrange(max(1, len(q) // 2))
        q = q[cut if len(q) > 12 else 0 :][: rng.choice([11, 13, 20, 99])]
        for _ in range(rng.choice([0, 0, 1, 1, 2, 3, 5])):
            q[rng.randrange(len(q))] = "changed"
        docs.append((d, rng.choice([", ", "\n", " "]).join(text[: len(text) // 2] + q + text[len(text) // 2 :])))
    found = decontaminate.contaminations(spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, text string")).collect()
    assert sorted((r.id, r.item) for r in found) == sorted(brute(docs, items))


def test_own_masks_meet_short_items_with_one_changed_word():
    """Whatever word of an item of 7 to 12 words changes, a mask for its size lies beside it."""
    masks = [(m, 5, 99) for m in decontaminate.MASKS] + list(decontaminate.SHORT_MASKS)
    for n in range(1, 13):
        for changed in range(n) if n > 6 else [n]:
            assert any(low <= n <= high and any(all(at + k != changed for k in mask) for at in range(n - mask[-1])) for mask, low, high in masks)


def test_edges(frame):
    item = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen"
    items = frame("item_id bigint, text string, doc_id string", (1, item, ""), (2, None, ""), (3, "", ""), (None, item, ""), (4, item, ""))
    docs = frame("doc_id bigint, text string, id string, t string, item string", (1, item, "", "", ""), (1, item, "", "", ""), (2, "x " + item.replace("six", "6") + " " + item, "", "", ""), (None, item, "", "", ""), (3, "alpha " * 50_000, "", "", ""))
    found = sorted((r.id or 0, r.item, r.first_word, r.n_words, r.n_equal) for r in decontaminate.contaminations(docs, items).collect())
    assert found == [(0, 1, 0, 14, 14), (0, 4, 0, 14, 14), (1, 1, 0, 14, 14), (1, 4, 0, 14, 14), (2, 1, 15, 14, 14), (2, 4, 15, 14, 14)]
    assert decontaminate.contaminations(docs.limit(0), items).count() == 0
    assert decontaminate.contaminations(docs, items.limit(0)).count() == 0
    kept = decontaminate.without_contaminated(docs, items)
    assert kept.columns == docs.columns
    assert [r.doc_id for r in kept.collect()] == [3]


def test_query(spark):
    rows = {t: [tuple(r) for r in spark.read.parquet(f"{SF}/{t}.parquet").select(k, "text").collect()] for t, k in (("documents", "doc_id"), ("benchmark", "item_id"))}
    # Texts without five words of an item in a row, or nearly, need no comparison at every shift.
    items = rows["benchmark"]
    pairs = {(w, x) for _, q in items for w, x in itertools.pairwise(words(q))}
    docs = [(d, t) for d, t in rows["documents"] if sum(p in pairs for p in itertools.pairwise(words(t))) >= 4]
    docs = [(d, t) for d, t in docs if len(t) < 3000]
    found = {(r.doc_id, r.item_id) for r in op5_decontamination(spark, SF).collect()}
    assert found
    assert {(d, i) for d, i in found if d in dict(docs)} == brute(docs[:40], items) | {(d, i) for d, i in found if d in dict(docs[40:])}
