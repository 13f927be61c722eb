"""Quality rules as a short-circuit cascade: rules are ordered by rejections per cost, estimated on a sample.

A rule looks at counts of the text. ``ordered`` tries every rule alone over a sample of about ``SAMPLE_ROWS`` rows (each
picked on its own, so that copies of one text do not come together) and notes the share it rejects and the time it takes: nanoseconds
between two readings of the clock around it in the task, the least of ``REPEATS`` for each row, summed over the rows.
``verdict`` tries the rules in that order and stops at the first that rejects; a count is made when the first rule that
needs it is reached, words are split once, and what is known is handed on. ``judged`` gives all counts along with the
verdict: those not yet made when a row is rejected are made then. The order decides how much is computed, never which rows
are kept.

Words are runs of other characters than the six ASCII white-space ones. Null texts count as empty: no words, and rejected by the rule
on few words if it is among the rules. Repeated rows are treated alike, ties in the order of rules go to the earlier one,
extra columns stay (in ``measured``, ``cascade`` and ``judged`` one named like a result is replaced; ``filtered`` gives
all as they are). An empty table keeps the order of rules as given.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from twinframe.session import stored

SAMPLE_ROWS = 2000
#: How often each rule is timed on each row of the sample.
REPEATS = 5
#: Rejections per second that lie this near to each other count as equal, as timings are no better than that.
ALIKE = 2
COUNTS = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words")
#: Counts made from the words of a text, and from its lines.
OF_WORDS, OF_LINES = ("n_words", "word_chars", "n_repeat_words"), ("n_lines", "n_dup_lines")

Known = dict[str, Column]


class Rule(NamedTuple):
    """A name, the counts it needs, and the condition over them under which a row goes."""

    name: str
    counts: tuple[str, ...]
    condition: Callable[..., Column]

    def over(self, known: Known) -> Column:
        return self.condition(*[known[c] for c in self.counts])

    @property
    def rejects(self) -> Column:
        """The condition over the columns of ``measured``."""
        return self.over({c: F.col(c) for c in self.counts})


def base_rules() -> list[Rule]:
    return [
        Rule("few_words", ("n_words",), lambda words: words < 50),
        Rule("repeated_words", ("n_repeat_words", "n_words"), lambda repeated, words: 100 * repeated > 50 * words),
    ]


def own_rules() -> list[Rule]:
    return [
        Rule("symbols", ("n_symbols", "n_words"), lambda symbols, words: 10 * symbols > words),
        Rule("word_length", ("word_chars", "n_words"), lambda chars, words: (chars < 2 * words) | (chars > 12 * words)),
        Rule("repeated_lines", ("n_dup_lines", "n_lines"), lambda repeated, lines: 10 * repeated > 6 * lines),
    ]


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` over ``value``, which is computed once however often the body names it, and only when it is reached."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _repeat_words(words: Column) -> Column:
    """Words in three-word windows that occur twice or more."""

    def covered(placed: Column) -> Column:
        following = F.slice(placed, F.lit(2), F.size(placed))
        pair = F.zip_with(placed, following, lambda a, b: F.when(a["w"] == b["w"], F.array(a["at"], b["at"])).otherwise(F.array().cast("array<int>")))
        return F.size(F.array_distinct(F.flatten(F.transform(F.flatten(pair), lambda at: F.array(at, at + 1, at + 2)))))

    def repeated(windows: Column) -> Column:
        # Only texts with a repeated window pay for finding where the repeated ones stand.
        placed = F.array_sort(F.transform(windows, lambda window, at: F.struct(window.alias("w"), at.alias("at"))))
        return F.when(F.size(windows) > F.size(F.array_distinct(windows)), _let(placed, covered)).otherwise(0)

    windows = F.transform(F.sequence(F.lit(0), F.size(words) - 3), lambda at: F.xxhash64(*[F.get(words, at + k) for k in range(3)]))
    return F.when(F.size(words) >= 3, _let(windows, repeated)).otherwise(0)


def _counting(text: Column, known: Known, counts: tuple[str, ...], body: Callable[[Known], Column]) -> Column:
    """``body`` over what is known and ``counts``, of which those not known yet are made here."""
    missing = [c for c in counts if c not in known]
    if not missing:
        return body(known)
    if any(c in OF_WORDS for c in missing) and "words" not in known:
        words = F.array_remove(F.split(text, r"[\x20\x09-\x0D]+"), "")
        return _let(words, lambda w: _counting(text, known | {"words": w, "n_words": F.size(w)}, counts, body))
    if any(c in OF_LINES for c in missing):
        lines = F.filter(F.split(text, "\n"), lambda line: line.rlike(r"[^\x20\x09-\x0D]"))
        sizes = _let(lines, lambda x: F.struct(F.size(x).alias("all"), F.size(F.array_distinct(x)).alias("distinct")))
        return _let(sizes, lambda x: _counting(text, known | {"n_lines": x["all"], "n_dup_lines": x["all"] - x["distinct"]}, counts, body))
    if missing[0] == "n_symbols":
        value = F.length(text) - F.length(F.regexp_replace(text, r"[#*$%&|<>]+", ""))
    elif missing[0] == "word_chars":
        value = F.length(F.array_join(known["words"], ""))
    else:
        value = _repeat_words(known["words"])
    return _let(value, lambda x: _counting(text, known | {missing[0]: x}, counts, body))


def _tried(text: Column, rules: list[Rule], known: Known, result: Callable[[str | None, Known], Column]) -> Column:
    """``result`` of the name of the first rule that rejects, or None, and of the counts made so far."""
    if not rules:
        return result(None, known)

    def decided(known: Known) -> Column:
        return F.when(rules[0].over(known), result(rules[0].name, known)).otherwise(_tried(text, rules[1:], known, result))

    return _counting(text, known, rules[0].counts, decided)


def _text(column: str) -> Column:
    return F.coalesce(F.col(f"`{column}`"), F.lit(""))


def verdict(text_col: str, rules: list[Rule]) -> Column:
    """The name of the first rule that rejects the text, null if it is kept."""
    return _tried(_text(text_col), rules, {}, lambda name, _: F.lit(name).cast("string"))


def judged(docs: DataFrame, rules: list[Rule], text_col: str = "text") -> DataFrame:
    """``docs`` with the counts of ``COUNTS`` (all long) and ``rejected_by``, the verdict."""
    text = _text(text_col)

    def all_counts(name: str | None, known: Known) -> Column:
        named = lambda k: F.struct(F.lit(name).cast("string").alias("rejected_by"), *[k[c].cast("bigint").alias(c) for c in COUNTS])
        return _counting(text, known, COUNTS, named)

    results = (*COUNTS, "rejected_by")
    others = [f"`{c}`" for c in docs.columns if c.lower() not in results]
    found = docs.select(F.struct(*others).alias("row"), _tried(text, rules, {}, all_counts).alias("found"))
    return found.select("row.*", *[f"found.{c}" for c in results])


def measured(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with the counts of ``COUNTS`` (all long), whatever the rules."""
    others = [f"`{c}`" for c in docs.columns if c.lower() not in COUNTS]
    counts = _counting(_text(text_col), {}, COUNTS, lambda known: F.struct(*[known[c].cast("bigint").alias(c) for c in COUNTS]))
    return docs.select(F.struct(*others).alias("row"), counts.alias("found")).select("row.*", "found.*")


def ordered(docs: DataFrame, rules: list[Rule], text_col: str = "text") -> list[tuple[Rule, float, float]]:
    """(rule, share rejected, seconds) in the order of rejections per second, all taken from the sample.

    Among rules that are ``ALIKE``, the one that rejects more comes first, then the one given first.
    """
    rows = docs.count()
    if not rows or not rules:
        return [(r, 0.0, 0.0) for r in rules]
    picked = docs.where(F.rand(31) * rows < SAMPLE_ROWS).select(F.col(f"`{text_col}`").alias("text"))
    sample = stored(picked, "sample")
    nanos = lambda: F.reflect(F.lit("java.lang.System"), F.lit("nanoTime")).cast("bigint")
    timed = [F.struct(F.lit(i).alias("rule"), nanos().alias("began"), verdict("text", [r]).alias("by"), nanos().alias("ended")) for i, r in enumerate(rules)]
    tries = sample.select("text", F.monotonically_increasing_id().alias("row"), F.explode(F.sequence(F.lit(1), F.lit(REPEATS))).alias("again"))
    took = tries.select("row", F.inline(F.array(*timed))).groupBy("row", "rule")
    least = took.agg(F.min(F.col("ended") - F.col("began")).alias("nanos"), F.max(F.col("by").isNotNull()).alias("goes"))
    sums = {r.rule: r for r in least.groupBy("rule").agg(F.sum("nanos").alias("nanos"), F.count_if("goes").alias("gone"), F.count("*").alias("n")).collect()}
    if not sums:
        return [(r, 0.0, 0.0) for r in rules]
    found = [(rule, sums[i].gone / sums[i].n, max(sums[i].nanos, 1) / 1e9) for i, rule in enumerate(rules)]
    return in_order(found)


def in_order(found: list[tuple[Rule, float, float]]) -> list[tuple[Rule, float, float]]:
    out = []
    while rest := [x for x in found if x not in out]:
        best = max(share / seconds for _, share, seconds in rest)
        alike = [x for x in rest if ALIKE * x[1] / x[2] >= best]
        out += sorted(alike, key=lambda x: -x[1])
    return out


def cascade(measures: DataFrame, rules: list[Rule]) -> DataFrame:
    """``measures`` with ``rejected_by``: the first of the rules that rejects the row, null if it is kept."""
    found = F.lit(None).cast("string")
    for rule in reversed(rules):
        found = F.when(rule.rejects, F.lit(rule.name)).otherwise(found)
    return measures.withColumn("rejected_by", found)


def filtered(docs: DataFrame, rules: list[Rule] | None = None, text_col: str = "text") -> DataFrame:
    """The rows that every rule keeps, as they are; nothing beyond the rule that rejects a row is computed for it."""
    rules = [r for r, _, _ in ordered(docs, rules or [*base_rules(), *own_rules()], text_col)]
    return docs.where(verdict(text_col, rules).isNull())
