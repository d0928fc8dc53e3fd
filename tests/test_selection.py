import hashlib
from collections import Counter

import duckdb
import pytest
from pyspark.sql import functions as F

from telar.operators import metrics, sampling
from telar.sources import readers, sinks


def plain_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        left, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            left, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, left + (x != y))
    return row[-1]


def test_distance_by_bits():
    import random

    rng = random.Random(5)
    for _ in range(300):
        a, b = ([rng.choice("abcd") for _ in range(rng.randrange(0, 70))] for _ in range(2))
        assert metrics._Distance(b).states(a)[-1][2] == plain_distance(a, b)


def test_fractional_weights(spark):
    pool = spark.createDataFrame([(1, 0.4), (2, 0.9), (3, 2.7), (4, None), (5, -1.0), (6, float("nan"))], "k int, w double")
    n = {r[0]: r[1] for r in sampling.weighted_pick(spark.range(4000).withColumnRenamed("id", "draw"), pool, "w", "k", "s").groupBy("k").count().collect()}
    assert sum(n.values()) == 4000 and set(n) == {1, 2, 3}
    assert all(abs(n[k] / 4000 - w / 4.0) < 0.04 for k, w in ((1, 0.4), (2, 0.9), (3, 2.7)))


@pytest.mark.parametrize("weights,kind", [([0, 0], "int"), ([1 << 40, 1 << 41], "long"), ([0.0, 0.0], "double")])
def test_each_draw_has_one_row(spark, weights, kind):
    pool = spark.createDataFrame(list(enumerate(weights)), f"k int, w {kind}")
    got = sampling.weighted_pick(spark.range(500).withColumnRenamed("id", "draw"), pool, "w", "k", "s")
    assert got.count() == got.select("draw").distinct().count() == 500 and got.select("k").distinct().count() == 2


def test_missing_files_and_limit(spark, tmp_path):
    assert readers.bitext(spark, str(tmp_path / "none.jsonl")).collect() == []
    row = '{"translation": {"src_lang_code": "kek_Latn", "tgt_lang_code": "eng_Latn", "src_text": "%d", "tgt_text": "x"}}\n'
    (tmp_path / "val_a.jsonl").write_text("".join(row % i for i in range(50)))
    got = readers.bitext(spark, [str(tmp_path / "val_a.jsonl"), str(tmp_path / "gone.jsonl")], limit=7).collect()
    assert [r["translation"]["src_text"] for r in got] == [str(i) for i in range(7)]


def test_log_and_predictions(spark, tmp_path):
    rows = spark.createDataFrame([(2, 0.5, 9.0), (1, 0.7, 9.0)], "step int, loss double, total_flos double")
    for _ in range(2):
        sinks.append_log(rows, str(tmp_path / "log"), "step", {"rate": 3})
    assert [r[0] for r in spark.read.text(str(tmp_path / "log/head")).collect()] == ["# rate: 3", "# step,loss"]
    assert sorted(r[0] for r in spark.read.text(str(tmp_path / "log/rows")).collect()) == ["1,0.7", "1,0.7", "2,0.5", "2,0.5"]
    spark.range(3).select(*[F.col("id").cast("string").alias(c) for c in ("Prompt", "Target", "Prediction", "Match")]).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("Prompt string, Target string, Prediction string, Match string").parquet(str(tmp_path / "in"))
    sinks.flush_predictions(stream, str(tmp_path / "out"), str(tmp_path / "state"))
    assert spark.read.option("header", True).csv(str(tmp_path / "out")).count() == 3


def test_entry_points_without_operators(monkeypatch):
    import __spark_entry__ as entry

    monkeypatch.setattr(entry, "_there", lambda name: False)
    assert "pipeline" not in entry.queries() and not any(k.startswith("op") and k[2:3].isdigit() for k in entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())


def most_read(spark, df):
    """Bytes that any one task of the query takes from exchanges."""
    sc, name = spark.sparkContext, f"read-{id(df)}"
    sc.setJobGroup(name, name)
    df.write.format("noop").mode("overwrite").save()
    sc._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    store, most = sc._jsc.sc().statusStore(), 0
    for job in sc.statusTracker().getJobIdsForGroup(name):
        for stage in sc.statusTracker().getJobInfo(job).stageIds:
            tasks = store.taskList(stage, 0, 1000)
            for metrics in (tasks.apply(i).taskMetrics() for i in range(tasks.size())):
                if metrics.isDefined():
                    read = metrics.get().shuffleReadMetrics()
                    most = max(most, read.localBytesRead() + read.remoteBytesRead())
    sc.setJobGroup("", "")
    return most


def test_split_has_no_task_that_reads_a_group(spark):
    text = F.concat(*[F.md5(F.concat_ws("|", "id", F.lit(i))) for i in range(10)])
    rows = spark.range(20_000).select("id", F.lit("en").alias("g"), text.alias("text"))  # 6.4 MB of one group
    assert most_read(spark, sampling.split(rows, "g", ["text"], "split")) < 1_500_000


def test_split_ranks_nulls_last_and_small_groups(spark):
    rows = [(g, t) for g, n in (("a", 1), ("b", 2), ("c", 9), ("d", 10), ("e", 37)) for t in [*map(str, range(n)), None, "0"]] + [("f", None), (None, "x"), ("h", "y")]
    want = {}
    for g in "abcdefh":
        at = {t: int(hashlib.md5(f"split|{t}".encode()).hexdigest()[:8], 16) for h, t in rows if h == g and t is not None}
        n = len(at) + any(t is None for h, t in rows if h == g)
        want |= {(g, t): "train" if i < n * 9 // 10 else "val" for i, t in enumerate(sorted(at, key=lambda t: (at[t], t)))}
    got = sampling.split(spark.createDataFrame(rows, "g string, text string"), "g", ["text"], "split").collect()
    assert {(r["g"], r["text"]): r["side"] for r in got} == want
    assert len(got) == sum(g is not None and t is not None for g, t in rows)


def test_matches_by_brute_force():
    import random

    import numpy as np

    rng = random.Random(7)
    for last, letters, rows, longest in ((6, 3, 40, 30), (4, 5000, 30, 400), (4, 9, 1, 50), (6, 30_000, 4, 3000), (1, 4, 9, 12), (6, 2, 300, 9)):
        texts = [(i, s, [rng.randrange(1, letters + 1) for _ in range(rng.randrange(longest))]) for s in (0, 1) for i in range(rows) for _ in range(rng.randrange(3))]
        texts += [(0, 1, [*range(40_000)] * 2)] if letters == 30_000 else []
        codes = np.array([c for *_, t in texts for c in t], np.int64)
        got = metrics._clipped(codes, np.array([len(t) for *_, t in texts]), np.array([i for i, *_ in texts]), np.array([s for _, s, _ in texts]), rows, last)
        for n in range(1, last + 1):
            counts = [[Counter(g for j, s, t in texts if j == i and s == side for g in zip(*[t[k:] for k in range(n)])) for side in (0, 1)] for i in range(rows)]
            assert got[:, n - 1].tolist() == [sum((a & b).values()) for a, b in counts]


@pytest.mark.parametrize("name", ["chrf_corpus", "bleu_corpus", "bleu_by_group"])
def test_scores_of_odd_texts(spark, tmp_path, name):
    """Null, empty and blank texts, control characters, wide characters, repeated ids and null turns, as the SQL has them."""
    from telar.plans.catalogue import ORACLE_SQL, QUERIES
    from tests.oracle import rows

    odd = [None, "", " \t\n", "a\x0bb \x00", "ab\xa0ab 😀😀 中文中", "the cat, the cat", "The cat. the cat the", "x", "x" * 3000, "".join(map(chr, range(0x4e00, 0x5600))) * 2]
    roles = ("user", "assistant")
    table = [(c, 2 * t + k, role, odd[(c * (k + 1) + t) % len(odd)]) for c in range(40) for t in range(3) for k, role in enumerate(roles)]
    table += [(50, 10 + k, role, x) for k, (role, x) in enumerate(zip(roles, ("a b c d e", "a b d e f")))] + [(49, 1010 + k, role, "a b c d") for k, role in enumerate(roles)]  # one id
    table += [(None, k, role, "p q r s") for k, role in enumerate(roles)]
    spark.createDataFrame(table, "conv_id long, turn long, role string, text string").coalesce(1).write.parquet(str(tmp_path / "conversations.parquet"))
    con = duckdb.connect()
    con.sql(f"CREATE VIEW conversations AS SELECT * FROM '{tmp_path}/conversations.parquet/*.parquet'")
    assert rows(QUERIES[name](spark, str(tmp_path)).toPandas()) == rows(con.sql(ORACLE_SQL[name]).df())


@pytest.mark.parametrize("score", [metrics.bleu, metrics.chrf])
def test_scores_exchange_texts_not_grams(spark, score):
    text = [F.concat_ws(" ", *[F.substring(F.md5(F.concat_ws("|", "id", F.lit(i * k))), 1, 3) for i in range(40)]) for k in (1, 2)]
    rows = spark.range(4000).repartition(4).select("id", text[0].alias("h"), text[1].alias("r"))  # 1.3 MB
    assert most_read(spark, score(rows, "h", "r", "id")) < 3_000_000
