from collections import Counter
from math import log

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from telar.llm.exact_dedup import Patricia, exact_owners
from telar.llm.queries import ORACLE_SQL, QUERIES
from telar.llm.search import ImpactIndex, top_k
from telar.llm.substring_dedup import dedup_units
from tests.oracle import connect, rows


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_against_sql(spark, sf_dir, name):
    assert rows(QUERIES[name](spark, sf_dir).toPandas()) == rows(connect(sf_dir).sql(ORACLE_SQL[name]).df())


@settings(max_examples=150, deadline=None)
@given(st.lists(st.tuples(st.binary(max_size=6), st.integers(0, 99)), max_size=40), st.sampled_from([1, 600, 1 << 30]))
def test_trie(items, limit):
    import tempfile

    trie = Patricia(limit, tempfile.mkdtemp())
    want: dict[bytes, list[int]] = {}
    for k, i in items:
        trie.add(k, i, [i])
        want.setdefault(k, []).append(i)
    got = sorted((o, sorted(m)) for o, m in trie.items())
    assert got == sorted((min(v), sorted(v)) for v in want.values())


@pytest.mark.parametrize("limit", [1, 64 << 20])
@pytest.mark.parametrize("data", [[], [(1, None), (2, None), (5, ""), (4, ""), (9, "ab"), (8, "ab"), (8, "ab"), (None, "ab"), (None, "q"), (7, "ab" * 100_000), (3, "ab" * 100_000)]])
def test_owners(spark, data, limit):
    df = spark.createDataFrame([(*r, 1) for r in data], "doc_id long, text string, owner_id int").repartition(3)
    got = Counter((r["doc_id"], r["owner_id"], r["n_copies"]) for r in exact_owners(df, limit).collect())
    by: dict[str, list] = {}
    for d, t in data:
        by.setdefault(t, []).append(d)
    want = Counter()
    for d, t in data:
        ids = [x for x in by[t] if x is not None]
        want[(d, d, 1) if t is None else (d, min(ids) if ids else None, len(by[t]))] += 1
    assert got == want


def test_units(spark):
    line = "one two three four five"
    data = [(3, f"{line}\nx y"), (1, f"  ONE two  three four five\n\nx y\nx y"), (2, line), (2, line), (4, None), (5, ""), (None, "z " * 90_000)]
    out = [tuple(r) for r in dedup_units(spark.createDataFrame([(*r, 0) for r in data], "doc_id long, text string, n_removed int")).collect()]
    assert sorted(out, key=str) == sorted([(1, data[1][1], 0, "0,27,28,32"), (2, "", 1, ""), (2, "", 1, ""), (3, "x y", 1, "24"), (4, None, 0, None), (5, "", 0, "0"), (None, "z " * 90_000, 0, "0")], key=str)
    assert dedup_units(spark.createDataFrame([], "doc_id long, text string")).collect() == []
    paragraphs = spark.createDataFrame([(1, f"{line}\n{line}\n\nb"), (2, f"{line}\n{line}\n\nc")], "doc_id long, text string")
    assert {r["text"] for r in dedup_units(paragraphs, "\n\n").collect()} == {f"{line}\n{line}\n\nb", "c"}


@settings(max_examples=100, deadline=None)
@given(st.integers(0, 2**32), st.integers(1, 60), st.integers(1, 8), st.integers(1, 12))
def test_index_stops_only_on_proof(seed, documents, terms, k):
    rng = np.random.default_rng(seed)
    there = rng.random((terms, documents)) < 0.5
    term, doc = np.nonzero(there)
    score = np.round(rng.random(len(term)) * rng.choice([1, 5, 20]), rng.integers(1, 6)) + 0.01
    query = [(t, int(rng.integers(1, 3))) for t in range(terms) if rng.random() < 0.8]
    ids = rng.permutation(documents)
    found, scores, _ = ImpactIndex(terms, term, doc, score, documents).search(query, k, ids)
    full = np.zeros(documents)
    for t, n in query:
        full[doc[term == t]] += n * score[term == t]
    full = np.round(full, 6)
    want = [d for d in np.lexsort((ids, -full)) if full[d] > 0][:k]
    assert ids[found].tolist() == ids[want].tolist() and np.allclose(scores, full[want])


def test_search_edges(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, "a b"), (3, None), (4, ""), (None, "a b"), (5, "b " * 90_000)], "doc_id long, text string")
    asked = spark.createDataFrame([(7, "A"), (7, "A"), (8, None), (9, "zzz"), (10, "b b")], "item_id long, text string")
    got = sorted((r["item_id"], r["rank"], str(r["doc_id"])) for r in top_k(docs, asked, k=3, limit=1).collect())
    assert got == sorted([(7, 1, "1"), (7, 1, "1"), (7, 2, "2"), (7, 2, "2"), (7, 3, "None"), (7, 3, "None")] + [x for x in got if x[0] == 10])
    assert len([x for x in got if x[0] == 10]) == 3
    assert top_k(docs.filter("false"), asked).collect() == [] == top_k(docs, asked.filter("false")).collect()


def test_search_brute(spark):
    texts = ["red fox", "red red dog", "fox fox fox den", "blue", "red fox dog"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {(r["doc_id"]): r["score"] for r in top_k(docs, spark.createDataFrame([(1, "red fox")], "item_id long, text string")).collect()}
    words = [t.split() for t in texts]
    mean = sum(map(len, words)) / len(words)
    want = {}
    for i, w in enumerate(words):
        s = sum(log(1 + (5 - df + 0.5) / (df + 0.5)) * w.count(q) * 2.2 / (w.count(q) + 1.2 * (0.25 + 0.75 * len(w) / mean)) for q in ("red", "fox") for df in [sum(q in x for x in words)])
        if s:
            want[i] = round(s, 6)
    assert got == want
