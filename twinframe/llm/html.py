"""Main text of HTML pages by the maximum-scoring run of tokens.

A page is tags and words. Comments, the head, and whole elements that never are main text (menus, footers, asides, forms,
scripts, styles and the like, or with such a word in their class, id or role) are left out. An element around marked
content stays: around a main element always, around an article if no marked content is left elsewhere; modifiers (has-,
with-, no-, block--modifier) are no such words; and if what remains has fewer than one in ``WRAPPED`` of the words left out
for their class, id or role only, these are scored like the rest. In what remains every word scores +1 and every tag a
negative weight; inline tags cost ``INLINE`` words at most, and together, spread over the words of their block, no more
than two for each. One linear scan finds the run with the largest sum, and its words, in blocks, are the text.

Weights of tags come from labelled pages: those that mark their content by one <article>, <main> or role=main. A tag
(with its class, where the pages know it) costs ``TAG`` and the more the rarer it is inside the marked content; one seen
outside only costs as much as the words of an average page. The marking elements, <html> and <body> have no weight. The sample
of labelled pages is bounded by ``sample_rows``, taken by hash; extraction covers every row and whole pages. Unknown tags
cost ``UNKNOWN``, and so does everything if no page is labelled.

Null, empty and tag-only pages give an empty text; text without tags is one block. Of runs with equal sums the first and
then the longest counts. Repeated rows give equal texts, extra columns stay, an empty table gives an empty table. Elements left open
end with the element around them; broken markup is text only where no tag can be read.
"""

from __future__ import annotations

import html as references
import sys
from collections import Counter
from collections.abc import Collection, Iterator
from math import log2

import pyarrow as pa
import regex
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

cloudpickle.register_pickle_by_value(sys.modules[__name__])

SAMPLE_ROWS = 1000
TAG, UNKNOWN = 0.05, 0.1
#: The most words that one inline tag costs.
INLINE = 5.0
WRAPPED = 20

#: Inside a tag: quoted values, which may hold a ">", and the rest. What is never closed reaches to the end of the page.
_INSIDE = r"""((?>=\s*"[^"]*(?:"|\Z)|=\s*'[^']*(?:'|\Z)|=|[^>=]+)*+)(?:>|\Z)"""
TOKEN = regex.compile(rf"<!--.*?(?:-->|\Z)|<(script|style|textarea|title|noscript|template|iframe|svg)\b{_INSIDE}.*?(?:</\1\s*>|\Z)|<(/?)([a-z][a-z0-9:-]*){_INSIDE}|<[!?/][^>]*(?:>|\Z)", regex.I | regex.S)
ATTRIBUTE = regex.compile(r"""\b(class|id|role|hidden|aria-hidden|style)\b(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""", regex.I)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements that never hold main text; a header does within the marked content only.
APART = frozenset("head nav footer aside form button select option dialog menu object canvas audio video map fieldset".split())
BLOCKS = frozenset("address article blockquote body center caption dd details div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html li main nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
#: Words in class, id or role that mark such elements.
ASIDE = regex.compile(r"(?:^|[\s_-])(?:ads?|advert\w*|adsense|banner|breadcrumbs?|comments?|respond|disqus|cookies?|consent|copyright|footer|header|masthead|menu|menus|modal|nav|navbar|navigation|newsletter|notices?|popup|promo\w*|recommend\w*|related|share|sharing|sidebar|side|social|sponsor\w*|subscribe|toolbar|widget|contentinfo|complementary|search|login|signup)(?:$|[\s_-])", regex.I)
#: Classes that say what is beside an element or how it is laid out.
MODIFIER = regex.compile(r"(?<!\S)(?:has|have|with|without|no|not|hide|show)[_-]\S*|--\S*", regex.I)
#: A new paragraph or item ends an open one.
ENDS = {"p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
MARKS, FRAME = ("article", "main"), ("html", "body")


class Piece:
    """A stretch of text (``tag`` None) or a tag that remains; ``inside``: within the marked content."""

    __slots__ = ("tag", "text", "block", "inside")

    def __init__(self, tag: str | None, text: str, block: bool, inside: bool):
        self.tag, self.text, self.block, self.inside = tag, text, block, inside


def attributes(raw: str) -> dict[str, str]:
    return {m[1].lower(): (m[2] or "").strip("\"'").lower() for m in ATTRIBUTE.finditer(raw)} if raw else {}


def pieces(page: str) -> tuple[list[Piece], int]:
    """What remains of a page in order, and how many elements mark content."""
    out, marks, around, doubted = walk(page)
    spared = around["main"] or (not marks and around["article"])
    if spared:
        out, marks, _, doubted = walk(page, spared)
    if doubted and sum(len(p.text.split()) for p in out if p.tag is None) * WRAPPED < doubted:
        out, marks, _, _ = walk(page, spared or set(), True)
    return out, marks


def walk(page: str, spared: Collection[int] = (), lenient: bool = False) -> tuple[list[Piece], int, dict[str, set[int]], int]:
    """What remains and how many elements mark content; the places of left-out elements around marks that are left out with
    them, by kind of mark; and the words left out for a class, id or role only. Elements at ``spared`` stay, ``lenient`` those with such words."""
    out: list[Piece] = []
    stack: list[tuple[str, str, bool, bool]] = []  # name, feature, left out, marks content
    opened: Counter = Counter()
    apart = marks = depth = at = doubted = 0
    outs: list[tuple[int, str]] = []  # place of each open element that is left out, and why: word, name, hidden
    whys: Counter = Counter()
    around: dict[str, set[int]] = {"main": set(), "article": set()}

    def pop() -> None:
        nonlocal apart, depth
        name, feature, left_out, marked = stack.pop()
        opened[name] -= 1
        apart -= left_out
        if left_out:
            whys[outs.pop()[1]] -= 1
        if not apart and not left_out:
            out.append(Piece("" if marked or name in FRAME else f"/{feature}", "", name in BLOCKS, depth > 0))
        depth -= marked

    def text(upto: int) -> None:
        nonlocal doubted
        if upto > at and not apart:
            out.append(Piece(None, references.unescape(page[at:upto]), False, depth > 0))
        elif upto > at and whys["word"] == apart:
            doubted += len(page[at:upto].split())

    for m in TOKEN.finditer(page):
        text(m.start())
        at = m.end()
        name = (m[4] or "").lower()
        if not name:
            if not apart and (m[1] or "").lower() in ("textarea", "iframe", "svg"):
                out.append(Piece(None, " ", False, depth > 0))
            continue
        if m[3]:
            if opened[name]:
                while stack[-1][0] != name:
                    pop()
                pop()
            elif name in ("p", "br") and not apart:
                out.append(Piece("", "", name == "p", depth > 0))
            continue
        if name in VOID:
            if not apart:
                out.append(Piece(name, " " if name == "br" else "", name == "hr", depth > 0))
            continue
        while stack and stack[-1][0] in ENDS.get(name, ()) or (stack and stack[-1][0] == "p" and name in BLOCKS and name != "p"):
            pop()
        if name == "p" and opened["p"]:
            # A paragraph also ends one that inline elements left open hide, up to the block around it.
            k = len(stack) - 1
            while k >= 0 and stack[k][0] not in BLOCKS:
                k -= 1
            if k >= 0 and stack[k][0] == "p":
                while len(stack) > k:
                    pop()
        known = attributes(m[5])
        role = known.get("role", "")
        marked = name in MARKS or role == "main"
        words = " ".join((known.get("class", ""), known.get("id", ""), role))
        hidden = "hidden" in known or known.get("aria-hidden") == "true" or "display:none" in known.get("style", "").replace(" ", "")
        why = "hidden" if hidden or name == "head" else "name" if name in APART or (name == "header" and not depth) else ""
        if not why and not lenient and not marked and name not in FRAME and ASIDE.search(words) and ASIDE.search(MODIFIER.sub("", words)):
            why = "word"
        left_out = bool(why) and (why == "hidden" or m.start() not in spared)
        feature = f"{name}.{known['class'].split()[0]}" if known.get("class", "").split() else name
        if m[5].rstrip().endswith("/") and name not in BLOCKS:
            continue
        stack.append((name, feature, left_out, marked))
        opened[name] += 1
        depth += marked
        marks += marked and not apart and not left_out
        if marked and apart and not left_out and not whys["hidden"]:
            kind = around["article" if name == "article" and role != "main" else "main"]
            for place, _ in reversed(outs):
                if place in kind:
                    break
                kind.add(place)
        if left_out:
            outs.append((m.start(), why))
            whys[why] += 1
        apart += left_out
        if not apart:
            out.append(Piece("" if marked or name in FRAME else feature, "", name in BLOCKS, depth > 0))
    text(len(page))
    return out, marks, around, doubted


def scores(kept: list[Piece], weights: dict[str, float]) -> list[float]:
    """What each piece adds to a run; inline tags lower the words of their block."""
    out, first, words, cost = [], 0, 0, 0.0
    for k, piece in enumerate([*kept, None]):
        if piece is None or piece.block:
            if cost and words:
                share = max(-1.0, 1 - cost / words)
                out[first:] = [x * share for x in out[first:]]
            words, cost = 0, 0.0
        if piece is None:
            break
        charge = weights.get(piece.tag, weights.get(piece.tag.split(".")[0], UNKNOWN)) if piece.tag else 0.0
        if piece.block:
            out.append(-charge)
            first = k + 1
        else:
            out.append(float(len(piece.text.split())) if piece.tag is None else 0.0)
            words += int(out[-1])
            cost += min(charge, INLINE)
    return out


def main_text(page: str, weights: dict[str, float]) -> str:
    """The blocks of the best run, one per line."""
    kept, _ = pieces(page)
    best = total = 0.0
    start, span = 0, None
    for k, (piece, score) in enumerate(zip(kept, scores(kept, weights), strict=True)):
        total += score
        if piece.tag is None and (total > best or (span and total == best and start == span[0])):
            best, span = total, (start, k + 1)
        if total <= 0:
            total, start = 0.0, k + 1
    if span is None:
        return ""
    blocks, line = [], []
    for piece in kept[span[0] : span[1]]:
        if piece.block:
            blocks.append("".join(line))
            line = []
        else:
            line.append(piece.text)
    blocks.append("".join(line))
    return "\n".join(b for b in (" ".join(x.split()) for x in blocks) if b)


def learn(counts: dict[tuple[str, bool], int], words: float) -> dict[str, float]:
    """Weights (positive costs) of tags from how often they stand inside and outside marked content, and its mean words."""
    out = {}
    for tag in {t for t, _ in counts}:
        inside, outside = counts.get((tag, True), 0), counts.get((tag, False), 0)
        share = (inside + 0.5) / (inside + outside + 1)
        # The cost passes words / 2 where a tag is as rare inside as one in a thousand.
        out[tag] = TAG + (words * max(0.0, -log2(share) - 1) / 20 if share < 0.5 else 0.0)
    return out


def fit(pages: DataFrame, html_col: str = "html", id_col: str = "page_id", sample_rows: int = SAMPLE_ROWS) -> dict[str, float]:
    """Tag weights of the labelled pages in a bounded sample; tags are counted in tasks and summed by Spark."""
    marked = pages.where(F.col(html_col).rlike(r"(?i)<(?:article|main)\b|role=.?main"))
    sample = marked.select(F.col(id_col).alias("id"), F.xxhash64(F.col(id_col), F.lit(11)).alias("order")).distinct().orderBy("order").limit(sample_rows)
    chosen = marked.join(F.broadcast(sample), F.col(id_col) == F.col("id"), "left_semi").select(F.col(html_col).alias("html"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: Counter = Counter()
        for batch in batches:
            for page in batch.column("html"):
                kept, marks = pieces(page.as_py())
                if marks != 1:
                    continue
                found["", True] += 1
                for piece in kept:
                    if piece.tag is None:
                        found["#words", piece.inside] += len(piece.text.split())
                    elif piece.tag:
                        found[piece.tag, piece.inside] += 1
                        if "." in piece.tag:
                            found[piece.tag.split(".")[0], piece.inside] += 1
        yield pa.RecordBatch.from_arrays([pa.array([t for t, _ in found], pa.string()), pa.array([i for _, i in found], pa.bool_()), pa.array(list(found.values()), pa.int64())], ["tag", "inside", "n"])

    rows = chosen.mapInArrow(count, "tag string, inside boolean, n bigint").groupBy("tag", "inside").agg(F.sum("n").alias("n")).collect()
    counts = {(r.tag, r.inside): r.n for r in rows}
    labelled, words = counts.pop(("", True), 0), counts.pop(("#words", True), 0)
    counts.pop(("#words", False), None)
    return learn(counts, words / labelled) if labelled else {}


def extract(page: str | Column, weights: dict[str, float]) -> Column:
    """The main text of pages, empty where there is none."""

    def run(page: pa.Array) -> pa.Array:
        return pa.array(["" if not x.is_valid else main_text(x.as_py(), weights) for x in page], pa.string())

    return F.arrow_udf(run, "string")(page)
