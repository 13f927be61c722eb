from __future__ import annotations

import hashlib
import random
import re
import zlib

import pytest

from twinframe.llm import runs
from twinframe.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"


def brute(words: list[str]) -> list[tuple[int, int, int]]:
    """(start, period, length) of all runs: every period in turn, the smallest of a stretch."""
    found = {}
    for q in range(1, len(words) // 4 + 1):
        i = 0
        while i + q < len(words):
            j = i
            while j + q < len(words) and words[j] == words[j + q]:
                j += 1
            if j - i + q >= max(6, 4 * q):
                found.setdefault((i, j - i + q), q)
            i = max(j, i) + 1
    return sorted((s, q, n) for (s, n), q in found.items())


def kept(words: list[str], found: list[tuple[int, int, int]]) -> str:
    gone = {i for s, q, n in found for i in range(s + q, s + n)}
    return " ".join(w for i, w in enumerate(words) if i not in gone)


def split(text: str | None) -> list[str]:
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def check(spark, texts: list[tuple]) -> None:
    docs = spark.createDataFrame([(*r, 0) for r in texts], "doc_id bigint, text string, t int")
    got = sorted(((r.id, r.n_words, [tuple(x) for x in r.runs], r.collapsed) for r in runs.periodic_runs(docs).collect()), key=str)
    wanted = []
    for i, text in texts:
        words = split(text)
        found = brute(words)
        wanted.append((i, len(words), found, kept(words, found)))
    assert got == sorted(wanted, key=str)


def test_random_texts(spark):
    """Few different words, so that runs of many periods overlap, begin anywhere and end at both ends."""
    draw = random.Random(5)
    texts = []
    for i in range(400):
        letters = "abc"[: draw.randint(1, 3)]
        parts = []
        for _ in range(draw.randint(1, 5)):
            block = [draw.choice(letters) for _ in range(draw.randint(1, 23))]
            parts += block * draw.randint(1, 9) + block[: draw.randint(0, len(block))]
        texts.append((i, " ".join(parts)))
    check(spark, texts)


def test_long_periods_over_many_tiles(spark):
    draw = random.Random(6)
    texts = []
    for i, (p, k) in enumerate([(100, 4), (127, 5), (128, 4), (129, 30), (255, 11), (700, 4), (1, 3000), (2, 1500), (64, 60)]):
        block = [f"w{draw.randint(0, 40)}" for _ in range(p)]
        noise = [f"n{draw.randint(0, 9)}" for _ in range(draw.randint(0, 50))]
        texts.append((i, " ".join([*noise, *block * k, *block[: p // 3], *noise[::-1]])))
    check(spark, texts)


@pytest.mark.parametrize("rows", [[], [(1, None)], [(None, ""), (None, " \n\t ")], [(None, "a a a a a a"), (1, "a a a a a"), (1, "a a a a a a"), (1, "a a a a a a"), (2, "é é é\x0bé é\x0cé")], [(3, "a b " * 1_000), (4, "x")]])
def test_odd_rows(spark, rows):
    check(spark, rows)


def test_query_is_the_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    wanted = []
    for d, text in docs:
        words = split(text)
        n, h = len(words), zlib.crc32(str(d).encode())
        g = h // 10
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
        found = brute(words)
        best = min(found, key=lambda r: (-r[2], r[0], r[1])) if found else None
        facts = (best[0], best[2], best[1], 1000 * best[2] // best[1]) if best else (None,) * 4
        shown = "".join(f"{s},{length},{q}\n" for s, q, length in found)
        wanted.append((d, len(found), *facts, *[hashlib.sha256(x.encode()).hexdigest() for x in (shown, kept(words, found))]))
    out = QUERIES["op13_periodic_runs"](spark, SF)
    assert out.columns == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    assert sorted(map(tuple, out.collect())) == sorted(wanted)
    assert sum(w[1] for w in wanted) > 10


def test_very_long_text(spark):
    """One run over a hundred thousand words, found over many tiles of every octave."""
    docs = spark.createDataFrame([(1, "x " + "a b c " * 40_000 + "y")], "doc_id bigint, text string")
    row = runs.periodic_runs(docs).first()
    assert (row.n_words, [tuple(r) for r in row.runs], row.collapsed) == (120_002, [(1, 3, 120_000)], "x a b c y")
