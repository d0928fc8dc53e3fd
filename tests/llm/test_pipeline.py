from collections import Counter

import corpus_pipeline

from telar.llm._common import read_table
from telar.llm.packing import TOKEN
from telar.llm.toxicity import toxicity


def stages(spark, docs, sf_dir):
    out = [docs]
    for _, f in corpus_pipeline.STAGES:
        out.append(f(spark, out[-1], sf_dir).persist())
    return out


def test_stages(spark, sf_dir):
    import re

    docs = read_table(spark, "/root/testdata/sf0.01", "documents").filter("doc_id < 400")
    sf_dir = "/root/testdata/sf0.01"
    got = stages(spark, docs, sf_dir)
    for x in got[1:-1]:
        assert x.columns == docs.columns
    rows = [[r.asDict() for r in x.collect()] for x in got]
    # 1: the verdicts take effect, nothing else goes
    verdict = {r["doc_id"]: r["toxic"] for r in toxicity(docs, read_table(spark, sf_dir, "labels")).collect()}
    assert {r["doc_id"] for r in rows[1]} == {d for d, t in verdict.items() if not t} and any(verdict.values())
    # 2: brute force over chunks
    from tests.llm.test_line_dedup import brute as brute_chunks

    assert {r["doc_id"]: r["text"] for r in rows[2]} == brute_chunks([(r["doc_id"], r["text"]) for r in rows[1]])
    assert all(r["n_chars"] == len(r["text"]) for r in rows[2])
    # 3: one of each connected group
    from tests.llm.test_jaccard_join import brute as brute_pairs

    least = {r["doc_id"]: r["doc_id"] for r in rows[2]}
    pairs = brute_pairs([(r["doc_id"], r["text"]) for r in rows[2]])
    for _ in range(8):
        for a, b in pairs:
            least[a] = least[b] = min(least[a], least[b])
    assert {r["doc_id"] for r in rows[3]} == {d for d, m in least.items() if d == m}
    # 4: copies of whole documents
    kept = {r["doc_id"]: r for r in rows[3]}
    assert all(r == kept[r["doc_id"]] for r in rows[4])
    from tests.llm.test_mixing import brute as brute_counts

    assert Counter(r["doc_id"] for r in rows[4]) == Counter(brute_counts(rows[3]))
    # 5: every token of every copy has its place
    size = {r["doc_id"]: len(re.findall(r"[^\W_]+|[^\w\s]|_", r["text"] or "")) for r in rows[4]}
    copies = Counter(r["doc_id"] for r in rows[4])
    total = Counter()
    for r in rows[5]:
        total[r["doc_id"]] += r["n_tokens"]
    assert sum(total.values()) == sum(size[d] * n for d, n in copies.items()) or abs(sum(total.values()) / sum(size[d] * n for d, n in copies.items()) - 1) < 1e-3


def test_nulls_and_empty(spark, sf_dir):
    schema = read_table(spark, sf_dir, "documents").schema
    docs = spark.createDataFrame([(1, None, None, None, None), (None, "a b\nc d\n", "en", "s", 8), (2, "", "en", None, 0), (2, "", "en", None, 0), (3, "x " * 200_000, "en", "s", 4)], schema)
    got = stages(spark, docs, sf_dir)
    assert got[3].count() == 5
    assert {r["doc_id"] for r in got[-1].collect()} == {r["doc_id"] for r in got[-2].collect()}
    for x in stages(spark, docs.filter("false"), sf_dir)[1:]:
        assert x.count() == 0


def test_order():
    assert [k for k, _ in corpus_pipeline.STAGES] == ["toxicity", "line_dedup", "near_duplicates", "mixing", "packing"]
