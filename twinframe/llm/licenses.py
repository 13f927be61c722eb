"""Short licence notices in texts, exact and with a few characters changed.

A text is its words (runs of letters, digits and non-ASCII characters, A-Z in lower case) with one blank between. A notice
of length L may differ in L // 10 characters. It is cut into one piece more than that: by the pigeonhole principle a match
holds at least one piece unchanged, so pieces are sought exactly, by substring search over many texts at once, and
at each word from which a match could hold the piece found the ``regex`` library matches the notice with bounded errors,
never beyond the text of that word. A match begins and ends at word
boundaries, and digits at the end of a notice must agree, so that versions are not confused.

Exact places of the base phrases are all reported, overlapping ones too; of inexact matches of one notice that overlap,
the one with fewest errors, then the first. Null and empty texts have no words and no spans. Repeated rows are answered
alike, extra columns stay, an empty table gives an empty table.
"""

from __future__ import annotations

import sys
from bisect import bisect
from functools import cache
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
import regex
from pyspark import cloudpickle
from pyspark.sql import Column
from pyspark.sql import functions as F

from twinframe.llm.common import PLAIN_WORDS, folded, text_slices, word_bytes, word_spans

cloudpickle.register_pickle_by_value(sys.modules[__name__])

BASE = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}
#: Notices whose labels the search adds to those of the base phrases.
OWN = {
    "permission is hereby granted free of charge": "mit",
    "licensed under the apache license": "apache",
    "gnu general public license version 2": "gpl-2",
    "gnu general public license version 3": "gpl-3",
    "gnu lesser general public license": "lgpl",
    "gnu affero general public license": "agpl",
    "mozilla public license": "mpl",
    "eclipse public license": "epl",
    "redistribution and use in source and binary forms": "bsd",
    "released under the bsd license": "bsd",
    "released into the public domain": "public-domain",
    "creative commons attribution": "cc-by",
    "cc by sa": "cc-by-sa",
    "cc by nd": "cc-by-nd",
}
SPAN = "struct<label: string, base: boolean, first_word: bigint, last_word: bigint, errors: int, score: double>"


def allowed(phrase: str) -> int:
    return len(phrase) // 10


def pieces(phrase: str) -> list[bytes]:
    """One more than the errors allowed, of nearly equal length."""
    n = allowed(phrase) + 1
    cuts = [len(phrase) * k // n for k in range(n + 1)]
    return [phrase[a:b].encode() for a, b in zip(cuts[:-1], cuts[1:], strict=True)]


@cache
def pattern(phrase: str):
    """Matches the phrase, between blanks or line ends, with its allowed errors outside trailing digits."""
    fixed = regex.search(r"[0-9]*$", phrase).group()
    loose = phrase[: len(phrase) - len(fixed)]
    errors = allowed(phrase)
    body = f"(?:{regex.escape(loose)}){{e<={errors}:[^\\n]}}" if errors else regex.escape(loose)
    return regex.compile(f"(?<![^ \\n])(?=[^ \\n])(?:{body}{fixed})(?<=[^ \\n])(?![^ \\n])".encode(), regex.BESTMATCH)


def match(plain: bytes, phrase: str, start: int, stop: int) -> tuple[int, int, int] | None:
    """(errors, start, end) of the best match that begins at ``start`` and ends before ``stop`` and the end of its line."""
    stop = min(stop, start + len(phrase) + allowed(phrase) + 1)
    line = plain.find(b"\n", start, stop)
    m = pattern(phrase).match(plain, start, stop if line < 0 else line)
    return m and (sum(m.fuzzy_counts), start, m.end())


def inexact(plain: bytes, phrase: str) -> list[tuple[int, int, int]]:
    """(start, end, errors) of the matches of one phrase: of those that overlap the one with fewest errors, then the first."""
    # A match holds a piece unchanged, at most the allowed errors away from the piece's place in the phrase.
    starts, errors, offset = set(), allowed(phrase), 0
    for piece in pieces(phrase):
        at = plain.find(piece)
        while at >= 0:
            for start in range(max(0, at - offset - errors), min(at, at - offset + errors) + 1):
                if plain[start] not in b" \n" and (not start or plain[start - 1] in b" \n"):
                    starts.add(start)
            at = plain.find(piece, at + 1)
        offset += len(piece)
    best = [m for start in starts if (m := match(plain, phrase, start, len(plain)))]
    heapify(best)
    begun, ended, counts = [], [], {}
    while best:
        e, start, end = heappop(best)
        k = bisect(begun, start)
        if k and ended[k - 1] > start:
            continue
        if k < len(begun) and begun[k] < end:
            # What is left of the better match may still hold a shorter one.
            if m := match(plain, phrase, start, begun[k]):
                heappush(best, m)
            continue
        begun.insert(k, start)
        ended.insert(k, end)
        counts[start] = e
    return [(a, b, counts[a]) for a, b in zip(begun, ended, strict=True)]


def search(plain: bytes) -> list[tuple[int, int, str, bool, int, float]]:
    """(start, end, label, is base, errors, score) in texts of single blanks between words, one text per line."""
    found = []
    for phrase, label in BASE.items():
        at = plain.find(phrase.encode())
        while at >= 0:
            end = at + len(phrase)
            if (not at or plain[at - 1] in b" \n") and (end == len(plain) or plain[end] in b" \n"):
                found.append((at, end, label, True, 0, 1.0))
            at = plain.find(phrase.encode(), at + 1)
    for phrase, label in [*BASE.items(), *OWN.items()]:
        kept = inexact(plain, phrase)
        found += [(a, b, label, False, e, 1 - e / len(phrase)) for a, b, e in kept if e or phrase not in BASE]
    return found


def scan(text: str | Column) -> Column:
    """A struct of ``n_words`` and ``spans``: label, whether it is an exact base place, first and last word, errors, score."""

    def run(text: pa.Array) -> pa.Array:
        counts, spans = [], []
        member = word_bytes(PLAIN_WORDS)
        for first, last, data, offsets in text_slices(text):
            data = folded(data)
            starts, ends, bounds = word_spans(data, offsets, member)
            counts.append(np.diff(bounds))
            rows: list[list[dict]] = [[] for _ in range(last - first)]
            spans += rows
            if not len(starts):
                continue
            # Words with one blank after each, a line end after the last of a text.
            sizes = ends - starts
            begins = np.cumsum(sizes + 1) - (sizes + 1)
            plain = np.full(int((sizes + 1).sum()), 32, np.uint8)
            inside = np.zeros(len(data) + 1, np.int64)
            inside[starts] += 1
            np.subtract.at(inside, ends, 1)
            chosen = data[np.cumsum(inside[:-1]) > 0]
            plain[np.arange(len(chosen)) + np.repeat(np.arange(len(sizes)), sizes)] = chosen
            stops = bounds[1:][np.diff(bounds) > 0] - 1
            plain[begins[stops] + sizes[stops]] = 10
            for a, b, label, base, errors, score in search(plain.tobytes()):
                word = int(np.searchsorted(begins, a, "right")) - 1
                stop = int(np.searchsorted(begins, b - 1, "right")) - 1
                row = int(np.searchsorted(bounds, word, "right")) - 1
                rows[row].append({"label": label, "base": base, "first_word": word - int(bounds[row]), "last_word": stop - int(bounds[row]), "errors": errors, "score": score})
            for row in rows:
                row.sort(key=lambda s: (s["first_word"], s["last_word"], s["label"], not s["base"]))
        kind = pa.struct([("label", pa.string()), ("base", pa.bool_()), ("first_word", pa.int64()), ("last_word", pa.int64()), ("errors", pa.int32()), ("score", pa.float64())])
        return pa.StructArray.from_arrays([pa.array(np.concatenate(counts) if counts else [], pa.int64()), pa.array(spans, pa.list_(kind))], ["n_words", "spans"])

    return F.arrow_udf(run, f"struct<n_words: bigint, spans: array<{SPAN}>>")(text)
