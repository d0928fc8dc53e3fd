from collections import Counter
from hashlib import md5
from math import exp, log, sqrt

import pytest
from pyspark.sql import functions as F

from telar.llm.mixing import poisson_mix


def brute(rows, alpha=0.5):
    """The doc_ids of the copies, in no order."""
    mass = Counter()
    for r in rows:
        mass[r["source"]] += len(r["text"] or "")
    total = sum(mass.values())
    weight = {s: (m / total) ** alpha if total else 0 for s, m in mass.items()}
    out = []
    for r in rows:
        m = mass[r["source"]]
        rate = weight[r["source"]] / sum(w for s, w in weight.items() if mass[s]) * total / m if m else 1.0
        u = int(md5(f"mix|{'' if r['doc_id'] is None else r['doc_id']}".encode()).hexdigest()[:12], 16) / 2**48
        k, cdf, lf = 0, exp(-rate), 0.0
        while cdf <= u and k <= rate + 12 * sqrt(rate) + 20:
            k += 1
            lf += log(k)
            cdf += exp(k * log(rate) - rate - lf)
        out += [r["doc_id"]] * k
    return out


def test_documents(spark, sf_dir):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    out = poisson_mix(docs)
    assert Counter(r["doc_id"] for r in out.collect()) == Counter(brute([r.asDict() for r in docs.collect()]))
    keys = [r["mix_key"] for r in out.select("mix_key").collect()]
    assert keys == sorted(keys) and abs(sum(keys) / len(keys) - 0.5) < 0.05


def test_target_weights(spark):
    docs = spark.range(40_000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 20 == 0, "rare").otherwise("common").alias("source"), F.repeat(F.lit("x"), (F.col("id") % 50).cast("int")).alias("text"))
    goal = spark.createDataFrame([("rare", 3.0), ("common", 1.0), ("other", 9.0)], "source string, weight double")
    mass = {r[0]: r[1] for r in poisson_mix(docs, goal).groupBy("source").agg(F.sum(F.length("text"))).collect()}
    assert abs(mass["rare"] / sum(mass.values()) - 0.75) < 0.03
    assert {r[0] for r in poisson_mix(docs, goal.filter("source = 'rare'")).select("source").distinct().collect()} == {"rare"}


@pytest.mark.parametrize("rows", [[], [(1, None, None), (2, "", None), (3, "a", "s"), (3, "a", "s"), (None, "abc", "s"), (5, "", "void"), (6, None, "void")]])
def test_edges(spark, rows):
    df = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, source string, copy string")
    out = poisson_mix(df)
    assert out.columns == ["doc_id", "text", "source", "copy", "mix_key"]
    assert Counter(r["doc_id"] for r in out.collect()) == Counter(brute([r.asDict() for r in df.collect()]))
