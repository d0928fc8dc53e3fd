"""Operators and stages on tables whose other columns are named as their helpers are."""

import time

import corpus_pipeline
import pytest

from telar.llm.jaccard_join import jaccard_pairs
from telar.llm.line_dedup import dedup_chunks
from telar.llm.mixing import poisson_mix
from telar.llm.packing import best_fit_pack
from telar.llm.search import top_k
from telar.llm.exact_dedup import exact_owners
from telar.llm.word_katz import word_katz_scores

EXTRA = ["row", "_source", "_steps", "_n", "_u", "_gone", "_id", "_fh", "_h", "h", "id", "gone", "lines", "key", "low", "steps", "copy_", "n_removed_lines", "copy", "mix_key", "partition", "a.b", "_"]
ROWS = [(1, None, None), (None, "a b\nc d\n", "s"), (2, "", None), (2, "", None), (3, "x\ny\nz\n" * 30, "s"), (4, "x\ny\nz\n" * 30, "s")]


@pytest.fixture
def docs(spark):
    schema = "doc_id long, text string, source string, n_chars long, " + ", ".join(f"`{c}` string" for c in EXTRA)
    return spark.createDataFrame([(*r, len(r[1] or "")) + tuple(f"{c}{i}" for c in EXTRA) for i, r in enumerate(ROWS)], schema)


def test_other_columns_stay(docs):
    before = {r["a.b"]: r for r in docs.collect()}
    cut = dedup_chunks(docs)
    assert cut.columns == [c for c in docs.columns if c != "n_removed_lines"] + ["n_removed_lines"]
    mixed = poisson_mix(docs)
    assert mixed.columns == [c for c in docs.columns if c not in ("copy", "mix_key")] + ["copy", "mix_key"]
    for out in (cut, mixed):
        for r in out.collect():
            for c in set(EXTRA) - {"copy", "mix_key", "n_removed_lines"}:
                assert r[c] == before[r["a.b"]][c]


@pytest.mark.parametrize("name", [k for k, _ in corpus_pipeline.STAGES[1:]])
def test_stages_keep_other_columns(spark, docs, sf_dir, name):
    before = {r["a.b"]: r for r in docs.collect()}
    out = dict(corpus_pipeline.STAGES)[name](spark, docs, sf_dir)
    rows = out.collect()
    if name == "packing":
        assert {r["doc_id"] for r in rows} == {r[0] for r in ROWS}
        return
    assert out.columns == docs.columns
    for r in rows:
        for c in EXTRA:
            assert r[c] == before[r["a.b"]][c]


def test_toxicity_stage_keeps_other_columns(spark, docs, sf_dir):
    out = corpus_pipeline.toxicity(spark, docs, sf_dir)
    assert out.columns == docs.columns and sorted(map(str, out.collect())) == sorted(map(str, docs.collect()))


def test_text_identifiers(spark):
    df = spark.createDataFrame([("x", "a b c d"), ("7", "a b c d"), ("8", "a b c d"), (str(2**63 - 1), "q r s")], "doc_id string, text string")
    assert [(r[0], r[1]) for r in jaccard_pairs(df).collect()] == [(7, 8)]
    assert sorted((str(r[0]), r[1], r[2]) for r in exact_owners(df).collect()) == sorted([("None", 7, 3), ("7", 7, 3), ("8", 7, 3), (str(2**63 - 1), 2**63 - 1, 1)])
    asked = spark.createDataFrame([(1, "q"), (2, "a")], "item_id long, text string")
    assert sorted((r["item_id"], r["rank"], r["doc_id"] or 0) for r in top_k(df, asked).collect()) == [(1, 1, 2**63 - 1), (2, 1, 7), (2, 2, 8), (2, 3, 0)]
    assert len(word_katz_scores(df).collect()) == len(best_fit_pack(df, 8).collect()) == 4


def test_lines_in_proportion(spark):
    """Work on a text grows with its lines, not with their square."""
    took = []
    for n in (4_000, 4_000, 64_000):
        text = "\n".join(f"line {i}" for i in range(n))
        began = time.time()
        out = dedup_chunks(spark.createDataFrame([(1, text), (2, text)], "doc_id long, text string")).collect()
        took.append(time.time() - began)
        assert sorted(r["n_removed_lines"] > n / 2 for r in out) == [False, True]
    assert took[2] < 10 * took[1] + 10
