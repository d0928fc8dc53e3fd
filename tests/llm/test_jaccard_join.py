import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from telar.llm import jaccard_join
from telar.llm.components import components, forest
from telar.llm.jaccard_join import _similar, jaccard_classes, jaccard_pairs, near_duplicates


def words(text):
    import re

    return re.findall("[0-9a-z\x80-\U0010ffff]+", text.lower())


def brute(rows, n=3, t=0.5):
    sets = []
    for d, text in rows:
        w = words(text or "")
        g = {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set())
        if d is not None and g:
            sets.append((d, g))
    out = {}
    for i, (a, x) in enumerate(sets):
        for b, y in sets[i + 1 :]:
            j = len(x & y) / len(x | y)
            if a != b and j >= t - 1e-12:
                k = (min(a, b), max(a, b))
                out[k] = max(out.get(k, 0), j)
    return out


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sets(st.integers(0, 30), min_size=1, max_size=12), max_size=14), st.sampled_from([0.3, 0.5, 0.6, 0.8, 1.0]), st.integers(0, 14))
def test_similar(sets, t, split):
    arrays = [np.array(sorted(s), np.uint64) for s in sets]
    for cut in (None, split if split < len(sets) else None):
        got = {}
        for x, ys, js in _similar(arrays, t, cut):
            for y, j in zip(ys.tolist(), js.tolist()):
                k = (min(x, y), max(x, y))
                assert k not in got
                got[k] = j
        want = {(i, k): len(a & b) / len(a | b) for i, a in enumerate(sets) for k, b in enumerate(sets) if i < k and len(a & b) / len(a | b) >= t - 1e-12 and (cut is None or (i < cut) != (k < cut))}
        assert got.keys() == want.keys()


@settings(max_examples=100, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 20), st.integers(0, 20)), max_size=30))
def test_forest(edges):
    a, b = (np.array([e[i] for e in edges], np.int64) for i in (0, 1))
    least = {v: v for e in edges for v in e}
    for _ in least:
        for x, y in edges:
            least[x] = least[y] = min(least[x], least[y])
    p, q = forest(a, b)
    assert dict(zip(p.tolist(), q.tolist())) == {v: m for v, m in least.items() if v != m}


def test_components(spark):
    edges = [(i, i + 1) for i in range(100, 140)] + [(5, 3), (3, 5), (9, 5), (7, 7), (None, 1)]
    got = {r[0]: r[1] for r in components(spark.createDataFrame(edges, "a long, b long").repartition(7)).collect()}
    assert got == {**{i: 100 for i in range(100, 141)}, 3: 3, 5: 3, 9: 3}
    assert components(spark.createDataFrame([], "a long, b long")).collect() == []


@pytest.fixture
def rows():
    base = [f"w{i} x{i % 7}" for i in range(60)]
    out = [(i, " ".join(base[:30] + [f"n{i}"] + base[30:])) for i in range(20)]
    out += [(100 + i, "copy " * 3 + " ".join(base[:20])) for i in range(15)]
    out += [(200, None), (201, ""), (202, "..."), (203, "one"), (204, "One!"), (None, "one"), (203, "one"), (205, " ".join(base) * 300)]
    return out


@pytest.mark.parametrize("block", [jaccard_join.BLOCK, 500])
def test_pairs(spark, rows, block, monkeypatch):
    monkeypatch.setattr(jaccard_join, "BLOCK", block)
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, sig string, comp int").repartition(3)
    got = {(r[0], r[1]): r[2] for r in jaccard_pairs(df).collect()}
    want = brute(rows)
    assert got.keys() == want.keys()
    assert all(abs(got[k] - v) < 1e-12 for k, v in want.items())
    owners = {r[0]: r[1] for r in near_duplicates(df).collect()}
    least = {d: d for k in want for d in k}
    for _ in range(4):
        for a, b in want:
            least[a] = least[b] = min(least[a], least[b])
    assert owners == {d: m for d, m in least.items() if d != m}


def test_documents(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    want = brute([(r[0], r[1]) for r in docs.select("doc_id", "text").collect()])
    assert {(r[0], r[1]) for r in jaccard_pairs(docs).collect()} == set(want)


def test_without_filter(spark, rows, monkeypatch):
    monkeypatch.setattr(jaccard_join, "BLOOM_LIMIT", -1)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert {(r[0], r[1]) for r in jaccard_pairs(df).collect()} == set(brute(rows))


def test_empty(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert jaccard_pairs(df).collect() == [] and near_duplicates(df).collect() == []


@pytest.mark.parametrize("block", [jaccard_join.BLOCK, 500])
def test_classes(spark, rows, block, monkeypatch):
    """A row for each row, with its class and the number of all its links, copies among them."""
    monkeypatch.setattr(jaccard_join, "BLOCK", block)
    rows = rows + [(300 + i, rows[3][1]) for i in range(70)]
    links = {i: set() for i in range(len(rows))}
    numbered = [(i if d is not None else None, text) for i, (d, text) in enumerate(rows)]
    for a, b in brute(numbered):
        links[a].add(b)
        links[b].add(a)
    least = {i: rows[i][0] for i in links}
    for _ in range(6):
        for a, bs in links.items():
            least[a] = min([least[a], *(least[b] for b in bs)]) if bs else least[a]
    got = sorted((tuple(r) for r in jaccard_classes(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()), key=str)
    assert got == sorted(((rows[i][0], least[i], len(v)) for i, v in links.items()), key=str)


def test_classes_of_documents(spark, sf_dir):
    from telar.llm.queries import ORACLE_SQL, QUERIES
    from tests.oracle import connect

    got = sorted(tuple(r) for r in QUERIES["op4_ngram_jaccard_join"](spark, sf_dir).collect())
    assert got == sorted(connect(sf_dir).sql(ORACLE_SQL["op4_ngram_jaccard_join"]).fetchall())
    assert len(got) == spark.read.parquet(f"{sf_dir}/documents.parquet").count()


def test_order_follows_counts(spark):
    """What more texts share than LEAST comes after all that fewer share, however its words are spread."""
    texts = [f"all rights reserved a{i} b{i} c{i}" for i in range(jaccard_join.LEAST + 1)] + [f"some more words d{i} e{i} f{i}" for i in range(jaccard_join.LEAST)]
    order = jaccard_join._order(spark.createDataFrame([(t,) for t in texts], "text string").repartition(3), 3)
    keys = list(order.keys(pa.array(["all rights reserved", "some more words", *texts])))
    often, seldom = (int(k[0]) for k in keys[:2])
    assert all(int(k[-1]) == often for k in keys[2 : 3 + jaccard_join.LEAST])
    assert all(int(v) >> 56 < often >> 56 for k in [*keys[3 + jaccard_join.LEAST :], keys[1]] for v in k) and seldom >> 56 < often >> 56


def test_copies_are_compared_once(spark):
    """The sets of a class of copies meet others once, not once a copy."""
    base = [f"w{i}" for i in range(100)]
    rows = [(i, " ".join(base)) for i in range(50)] + [(100 + i, " ".join(base[: 90 + i % 2])) for i in range(50)]
    sets, comps = jaccard_join._gathered(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1), 3, 0.5)
    assert sets.count() == 100 and sets.filter("keys is not null").count() == 3
    assert {tuple(r)[1:] for r in jaccard_classes(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)).collect()} == {(0, 99)}


def test_near_duplicates_of_several_texts(spark):
    """The pipeline's stage takes documents: one with two texts connects what is like either; copies make one row each."""
    a, b = (" ".join(f"{x}{i}" for i in range(40)) for x in "ab")
    rows = [(5, a), (5, b), (7, a), (7, a), (3, b), (9, "else"), (None, a)]
    got = near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    assert sorted(map(tuple, got)) == [(5, 3), (7, 3)]


def test_groups_pass_on_trees(spark, monkeypatch):
    """A group of near copies passes on fewer links than it has pairs, and stays whole."""
    passed, old = [], jaccard_join.grouped

    def grouped(df, keys, fn, schema):
        out = old(df, keys, fn, schema)
        if schema.endswith("counts binary, sizes binary"):
            passed.extend(int.from_bytes(r[0][:8], "little") for r in out.select("a").collect())
        return out

    monkeypatch.setattr(jaccard_join, "grouped", grouped)
    base = [f"w{i}" for i in range(400)]
    rows = [(i, " ".join(base[: 6 * i] + [f"n{i}"] + base[6 * i + 1 :])) for i in range(60)] + [(100, "another text"), (101, "another text")]
    got = {r[0]: r[1] for r in near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()}
    assert got == {**{i: 0 for i in range(1, 60)}, 101: 100}
    assert 59 <= sum(passed) < 60 * 59 / 2
