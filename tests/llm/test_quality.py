from __future__ import annotations

import collections
import re

import pytest
from pyspark.sql import functions as F

from twinframe.llm import quality


def plain(text: str | None) -> dict:
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    often = collections.Counter(windows)
    covered = {i + k for i, w in enumerate(windows) if often[w] > 1 for k in range(3)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return {
        "n_words": len(words), "word_chars": sum(map(len, words)), "n_symbols": len(re.findall(r"[#*$%&|<>]", text)), "n_lines": len(lines),
        "n_dup_lines": len(lines) - len(set(lines)), "n_repeat_words": len(covered),
    }


TEXTS = [None, "", " \n\t ", "one", "a b", "a b c", "a a a a a", "a b c d a b c", "x\ny\nx\n\n x\nx", "é ## $a |b| <c>", "one two three " * 30_000, "\u00a0 a\u2003b \x1c c", " lead and trail \r\n"]


def test_counts(frame):
    docs = frame("doc_id bigint, text string, n_words string, words string", *[(i, t, "x", "y") for i, t in enumerate(TEXTS)])
    found = {r.doc_id: r.asDict() for r in quality.measured(docs).collect()}
    for i, t in enumerate(TEXTS):
        assert {k: found[i][k] for k in plain(t)} == plain(t), i
        assert found[i]["words"] == "y"


def test_order_changes_no_verdict(frame):
    good = " ".join(f"word{i} with{i % 7}" for i in range(40))
    docs = frame("doc_id bigint, text string, rejected_by string", (1, good, ""), (2, good + " ###" * 60, ""), (3, "same line here\n" * 40, ""), (4, None, ""), (4, None, ""), (5, "", ""), (None, good, ""))
    rules = [*quality.base_rules(), *quality.own_rules()]
    verdicts = []
    for order in (rules, rules[::-1], [r for r, _, _ in quality.ordered(docs, rules)]):
        rows = quality.cascade(quality.measured(docs), order).collect()
        verdicts.append(sorted((r.doc_id or 0, r.rejected_by is None) for r in rows))
    assert verdicts[0] == verdicts[1] == verdicts[2] == [(0, True), (1, True), (2, False), (3, False), (4, False), (4, False), (5, False)]
    kept = quality.filtered(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id or 0 for r in kept.collect()) == [0, 1]
    assert quality.filtered(docs.limit(0)).count() == 0


def test_rules_that_reject_more_per_second_come_first(frame):
    docs = frame("doc_id bigint, text string", *[(i, f"few words {i}" + " of text that goes on" * (i % 5)) for i in range(300)])
    rules = [*quality.own_rules(), *quality.base_rules()]
    found = quality.ordered(docs, rules)
    assert [share / cost for _, share, cost in found] == sorted((share / cost for _, share, cost in found), reverse=True)
    assert found[0][0].name in ("few_words", "repeated_words")
    assert {r.name: share for r, share, _ in found}["few_words"] == pytest.approx(1.0)


def test_copies_of_one_text_do_not_fill_the_sample(spark, monkeypatch):
    rows, sizes, keep = 20_000, [], quality.stored
    hot = spark.range(100).selectExpr("concat('hot text ', id) AS text").where(F.pmod(F.xxhash64("text"), F.lit(rows)) < quality.SAMPLE_ROWS).first().text
    docs = spark.range(rows).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, hot).otherwise(F.concat(F.lit("own "), "id")).alias("text"))

    def counted(frame, name):
        out = keep(frame, name)
        sizes.append((out.count(), out.where(F.col("text") == hot).count()))
        return out

    monkeypatch.setattr(quality, "stored", counted)
    quality.ordered(docs, quality.base_rules())
    total, copies = sizes[0]
    assert 0.85 * quality.SAMPLE_ROWS < total < 1.15 * quality.SAMPLE_ROWS
    assert 0.2 < copies / total < 0.45


def test_judged_gives_all_counts_and_the_verdict(frame):
    docs = frame("doc_id bigint, text string, rejected_by int, `_words` string, rows string", *[(i, t, 7, "w", "r") for i, t in enumerate(TEXTS)])
    rules = [*quality.own_rules(), *quality.base_rules()]
    expected = {r.doc_id: r for r in quality.cascade(quality.measured(docs.drop("rejected_by")), rules).collect()}
    for order in (rules, []):
        for r in quality.judged(docs, order).collect():
            assert {k: r[k] for k in plain(TEXTS[r.doc_id])} == plain(TEXTS[r.doc_id])
            assert r.rejected_by == (expected[r.doc_id].rejected_by if order else None)
            assert (r["_words"], r["rows"]) == ("w", "r")
    assert [f.name for f in quality.measured(docs).schema if f.name == "rejected_by"] == ["rejected_by"]


def test_given_columns_pass_the_filter_unchanged(frame):
    good = " ".join(f"word{i} with{i % 7}" for i in range(40))
    docs = frame("`_words` int, text string, rejected_by string, n_words int, `_lines` int, row int", (1, good, "me", 5, 2, 3), (4, "few", "x", 1, 1, 1))
    kept = quality.filtered(docs)
    assert kept.schema == docs.schema
    assert [tuple(r) for r in kept.collect()] == [(1, good, "me", 5, 2, 3)]


def test_a_rejected_row_skips_later_counts(spark, frame):
    # A later rule that fails wherever it is evaluated shows which rows reach it.
    docs = frame("text string", ("few words",), (None,))
    failing = quality.Rule("failing", ("n_repeat_words",), lambda n: F.raise_error(F.concat(F.lit("reached "), n.cast("string"))).isNotNull())
    few = quality.base_rules()[0]
    assert [r.by for r in docs.select(quality.verdict("text", [few, failing]).alias("by")).collect()] == ["few_words"] * 2
    assert [r.rejected_by for r in quality.judged(docs, [few, failing]).collect()] == ["few_words"] * 2
    assert docs.where(quality.verdict("text", [few, failing]).isNull()).count() == 0
    with pytest.raises(Exception, match="reached"):
        docs.select(quality.verdict("text", [failing, few])).collect()
    plan = docs.where(quality.verdict("text", [quality.base_rules()[1], *quality.own_rules(), few]).isNull())
    plan = plan._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("split(") == 2  # words once, lines once


def test_timings_that_are_alike_do_not_change_the_order():
    rules = [quality.Rule(name, (), None) for name in "abcd"]
    for a, b in ((0.24, 0.5), (0.26, 0.42), (0.22, 0.45)):
        found = [(rules[0], 0.04, a), (rules[1], 0.07, b), (rules[2], 0.06, 9.0), (rules[3], 0.0, 0.01)]
        assert [r.name for r, _, _ in quality.in_order(found)] == ["b", "a", "c", "d"]
    assert [r.name for r, _, _ in quality.in_order([(rules[0], 0.07, 1.0), (rules[1], 0.04, 0.1)])] == ["b", "a"]


def test_order_is_the_same_in_repeated_runs(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rules = [*quality.own_rules(), *quality.base_rules()]
    first = quality.ordered(docs, rules)
    assert sum(share > 0 for _, share, _ in first) >= 3
    for _ in range(2):
        again = quality.ordered(docs, rules)
        assert [r.name for r, _, _ in again] == [r.name for r, _, _ in first]
