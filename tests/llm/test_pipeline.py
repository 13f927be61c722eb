from __future__ import annotations

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from . import test_decontaminate, test_jaccard, test_lines

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def steps(spark, tmp_path_factory):
    """The rows before and after each stage."""
    docs, out = spark.read.parquet(f"{SF}/documents.parquet"), []
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES:
        before = docs.collect()
        path = str(tmp_path_factory.mktemp("stage") / name)
        stage(spark, docs, SF).write.parquet(path)
        docs = spark.read.parquet(path)
        assert name == "bpe" or docs.columns == columns
        out.append((before, docs.collect()))
    return out


def test_toxic_documents_go(spark, steps):
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    before, after = steps[0]
    gone = {r.doc_id for r in before} - {r.doc_id for r in after}
    assert gone
    assert all(labels.get(d, 1) for d in gone)


def test_repeated_lines_go(steps):
    before, after = steps[1]
    wanted = test_lines.brute([(r.doc_id, r.text) for r in before])
    texts = {r.doc_id: r.text for r in before}
    wanted = {d: t for d, t in wanted.items() if t or t == texts[d]}
    assert {r.doc_id: r.text for r in after} == wanted
    assert all(r.n_chars == len(r.text) for r in after)


def test_one_of_each_group_stays(steps):
    before, after = steps[2]
    groups = test_jaccard.brute([(r.doc_id, r.text) for r in before], 5, 80)
    assert {r.doc_id for r in after} == {d for d, (_, c) in groups.items() if d == c}


def test_benchmark_passages_go(spark, steps):
    before, after = steps[3]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    gone = {r.doc_id for r in before} - {r.doc_id for r in after}
    holding = {r.doc_id for r in before if any(i[1].lower() in r.text.lower() for i in items)}
    assert holding <= gone
    assert test_decontaminate.brute([(r.doc_id, r.text) for r in before if r.doc_id in gone], items).__len__() >= len(gone)


def test_encoding_is_the_library_s(steps):
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    before, after = steps[4]
    texts = {r.doc_id: r.text for r in before}
    assert len(after) == len(texts)
    for r in after:
        ids = library.encode(texts[r.doc_id], add_special_tokens=False).ids
        assert r.ids == np.array(ids, "<u4").tobytes()
        assert (r.n_tokens, r.text) == (len(ids), texts[r.doc_id])


def test_run_is_all_stages(spark, steps):
    assert sorted((r.doc_id, r.n_tokens) for r in corpus_pipeline.run(spark, SF).collect()) == sorted((r.doc_id, r.n_tokens) for r in steps[-1][1])


@pytest.mark.parametrize("rows", [[], [(None, None, None), (None, None, None), (1, "", "x"), (1, "", "x"), (2, "a b c " * 40_000, "y"), (2, "a b c " * 40_000, "y"), (3, None, "z")]])
def test_odd_rows_pass_every_stage(spark, frame, tmp_path, rows):
    docs = frame("doc_id bigint, text string, n_removed string", *rows) if rows else spark.createDataFrame([], "doc_id bigint, text string, n_removed string")
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, SF).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
    found = sorted((r.doc_id or 0, r.n_tokens > 0) for r in docs.collect())
    assert found == ([(0, False), (0, False), (1, False), (1, False), (2, True), (3, False)] if rows else [])
