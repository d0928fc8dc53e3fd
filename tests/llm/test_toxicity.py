from itertools import combinations

import numpy as np
import pytest

from telar.llm.toxicity import DECAY, Kernel, toxicity, train, units


def brute_kernel(a, b):
    def weights(x):
        out = {}
        for i in combinations(range(len(x)), 3):
            k = "".join(x[j] for j in i)
            out[k] = out.get(k, 0) + float(DECAY) ** (i[-1] - i[0] + 1)
        return out

    p, q = weights(a), weights(b)
    return sum(v * q.get(k, 0) for k, v in p.items()) / np.sqrt(sum(v * v for v in p.values()) * sum(v * v for v in q.values()))


def test_kernel():
    marks, words = ["^idiot$", "^scu", "moron"], ["^idiot$", "^i*diot$", "^scum$", "^moroon$", "^the$", "^éclair$"]
    got = Kernel(marks)(words)
    for i, w in enumerate(words):
        for j, m in enumerate(marks):
            assert got[i, j] == pytest.approx(brute_kernel(w, m), abs=1e-4)


def test_units():
    texts = ["Of%%% (idiot), a.b", "", "i d i o t é x", "--", "z"]
    data = np.frombuffer("".join(texts).encode(), np.uint8)
    s, e, owner = units(data, np.cumsum([0] + [len(t.encode()) for t in texts]))
    got = sorted((int(o), bytes(data[i:j]).decode()) for i, j, o in zip(s, e, owner))
    want = [(0, "Of"), (0, "idiot"), (0, "a.b"), (2, "i d i o t é x"), (4, "z")] + [(2, x) for x in "idiotéx"]
    assert got == sorted(want)


def data(spark):
    base = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{base}/documents.parquet"), spark.read.parquet(f"{base}/labels.parquet")
    return docs, labels


@pytest.fixture(scope="module")
def judged(spark):
    docs, labels = data(spark)
    return {r["doc_id"]: r for r in toxicity(docs, labels.filter("doc_id % 3 <> 0"), sample=1500).collect()}


def test_held_out(spark, judged):
    docs, labels = data(spark)
    rows = docs.join(labels, "doc_id").filter("doc_id % 3 = 0").collect()
    said = np.array([judged[r["doc_id"]]["toxic"] for r in rows])
    label = np.array([r["toxic"] for r in rows])
    insults = ("idiot", "moron", "clown", "loser", "worthless", "pathetic", "scum", "trash", "stupid", "disgusting")
    sure = np.array([sum(r["text"].lower().count(x) for x in insults) >= 3 for r in rows])
    assert (said & label).sum() / label.sum() > 0.85
    assert said[sure].mean() > 0.97
    assert (said & ~label.astype(bool)).sum() / (label == 0).sum() < 0.01


def test_bent_insults(spark):
    docs, labels = data(spark)
    rows = docs.join(labels.filter("doc_id % 3 <> 0"), "doc_id").orderBy("doc_id").limit(1500).collect()
    model = train([r["text"].lower() for r in rows], [r["toxic"] for r in rows])
    bent = ["idiot", "i*diot", "iddiot", "i-d-i-o-t", "i d i o t", "trassh", "worthlless", "stu-pid", "s.c.u.m", "loooser", "clo_wn"]
    plain = ["the", "thing", "other", "and", "station", "idea", "running", "class", "that"]
    assert (model.scores([x.encode() for x in bent]) > 0).mean() > 0.8
    assert (model.scores([x.encode() for x in plain]) < 0).all()


def test_edges(spark):
    docs = spark.createDataFrame([(1, None, 0), (2, "", 0), (2, "", 0), (None, "idiot moron scum", 0), (3, "idiot " * 90_000, 0)], "doc_id long, text string, toxic int")
    _, labels = data(spark)
    assert {r["toxic"] for r in toxicity(docs, labels).collect()} == {0}
    out = toxicity(docs.filter("false"), labels)
    assert out.collect() == [] and out.columns == ["doc_id", "n_units", "n_toxic", "toxic"]
    full, _ = data(spark)
    union = full.select("doc_id", "text").limit(1200).union(spark.createDataFrame([(-1, None), (-2, ""), (-3, "idiot " * 9000), (None, "idiot moron scum")], "doc_id long, text string"))
    got = {r["doc_id"]: r["toxic"] for r in toxicity(union, labels.union(spark.createDataFrame([(None, 1, 1), (5, None, None)], labels.schema))).collect()}
    assert got[-1] == got[-2] == 0 and got[-3] == got[None] == 1
