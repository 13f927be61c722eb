from __future__ import annotations

import random
import re

import pytest

from twinframe.llm import licenses
from twinframe.llm.queries import op4_license_scan

SF = "/root/testdata/sf0.01"


def words(text: str | None) -> list[str]:
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def places(text: str | None) -> list[tuple[int, str]]:
    w, out = words(text), []
    for phrase, label in licenses.BASE.items():
        p = phrase.split()
        out += [(i, label) for i in range(len(w) - len(p) + 1) if w[i : i + len(p)] == p]
    return sorted(out)


def edits(a: str, b: str) -> int:
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def scanned(frame, texts):
    docs = frame("doc_id bigint, text string, n_words string, spans string", *[(i, t, "", "") for i, t in enumerate(texts)])
    return {r.doc_id: r.x for r in docs.select("doc_id", licenses.scan("text").alias("x")).collect()}


def test_exact_places_and_words(frame):
    texts = [None, "", "...", "Under the MIT license", "xunder the mit license", "under the mit licenses", "UNDER--THE\nMIT (License) under the mit license", "cc by nc by nc cc by nc", "Licensed under the Apache License, Version 2.0.", "apache license version 20", "é cc by nc", "a " * 100_000 + "CC BY-NC 4.0", "under the mit", "license under the mit license"]
    found = scanned(frame, texts)
    for i, t in enumerate(texts):
        assert found[i].n_words == len(words(t))
        assert sorted((s.first_word, s.label) for s in found[i].spans if s.base) == places(t), t


@pytest.mark.parametrize("phrase", list(licenses.BASE) + list(licenses.OWN))
def test_changed_notices_are_found(frame, phrase):
    rng, label = random.Random(phrase), {**licenses.OWN, **licenses.BASE}[phrase]
    texts, near = [], []
    for k in range(40):
        changed = list(phrase)
        for _ in range(k % (licenses.allowed(phrase) + 2)):
            at = rng.randrange(len(changed) - 1)
            changed[at : at + 1] = rng.choice([[], ["q"], ["q", changed[at]]])
        changed = "".join(changed)
        texts.append(f"some {rng.choice(['words', 'w'])} before {changed} and after")
        near.append(edits(phrase, " ".join(changed.split())))
    found = scanned(frame, texts)
    for i, d in enumerate(near):
        labels = {s.label for s in found[i].spans}
        if d <= licenses.allowed(phrase):
            assert label in labels, texts[i]
        for s in found[i].spans:
            assert s.score == pytest.approx(1 - s.errors / len(next(p for p in [*licenses.BASE, *licenses.OWN] if {**licenses.OWN, **licenses.BASE}[p] == s.label and abs(1 - s.errors / len(p) - s.score) < 1e-9)))


def test_versions_are_not_confused(frame):
    found = scanned(frame, ["gnu general public license version 3", "gnu general public license version 2", "apache license version 3", "gnu genral public licence version 3"])
    assert [sorted({s.label for s in found[i].spans}) for i in range(4)] == [["gpl-3"], ["gpl-2"], [], ["gpl-3"]]


def test_query(spark):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = op4_license_scan(spark, SF).collect()
    assert sorted(r.doc_id for r in rows) == sorted(texts)
    for r in rows:
        base = places(texts[r.doc_id])
        assert (r.n_words, r.n_base, r.base_labels) == (len(words(texts[r.doc_id])), len(base), ",".join(sorted({x for _, x in base})))
        assert (r.first_word, r.last_word) == ((base[0][0], base[-1][0]) if base else (None, None))
        assert set(r.base_labels.split(",")) <= set(r.labels.split(",")) or not base
        assert 0 <= r.score <= 1


def nearest(text: str, phrase: str) -> list[tuple[int, int]]:
    """(first word, errors) of all matches in one text, by edit distances of all runs of words."""
    w, fixed = words(text), re.search("[0-9]*$", phrase).group()
    loose, spans = phrase[: len(phrase) - len(fixed)], []
    for i in range(len(w)):
        for j in range(i + 1, len(w) + 1):
            run = " ".join(w[i:j])
            if abs(len(run) - len(phrase)) <= licenses.allowed(phrase) and run.endswith(fixed):
                d = edits(loose, run[: len(run) - len(fixed)])
                if d <= licenses.allowed(phrase):
                    spans.append((d, i, j))
    kept = []
    for d, i, j in sorted(spans):
        if all(j <= a or i >= b for _, a, b in kept):
            kept.append((d, i, j))
    return sorted((i, d) for d, i, _ in kept)


def test_better_notices_nearby_hide_none(frame):
    found = scanned(frame, ["foo relesed under the bsd license", "bar baz released under the bsd license", "relesed under the bsd license released under the bsd license relased under the bsd licence"])
    assert [[(s.first_word, s.label, s.errors) for s in found[i].spans] for i in range(3)] == [[(1, "bsd", 1)], [(2, "bsd", 0)], [(0, "bsd", 1), (5, "bsd", 0), (10, "bsd", 2)]]


@pytest.mark.parametrize("phrase", list(licenses.BASE) + list(licenses.OWN))
def test_neighbours_against_all_runs(frame, phrase):
    rng, texts = random.Random(phrase), []
    for _ in range(60):
        parts = []
        for _ in range(rng.randrange(1, 4)):
            changed = list(phrase)
            for _ in range(rng.randrange(licenses.allowed(phrase) + 2)):
                at = rng.randrange(len(changed))
                changed[at : at + 1] = rng.choice([[], ["q"], ["q", changed[at]], [" "]])
            parts.append("".join(changed) + rng.choice(["", " w", " " + phrase.split()[-1]]))
        texts.append(" ".join(parts))
    found = scanned(frame, texts)
    label = {**licenses.OWN, **licenses.BASE}[phrase]
    others = [p for p, x in [*licenses.BASE.items(), *licenses.OWN.items()] if x == label]
    for i, t in enumerate(texts):
        wanted = sorted(x for p in others for x in nearest(t, p))
        assert sorted((s.first_word, s.errors) for s in found[i].spans if s.label == label) == wanted, t
