import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from telar.llm.packing import best_fit_pack, plan


def brute(counts):
    """Best-fit decreasing, one piece at a time."""
    cap, bins = len(counts), []
    for x in [i for i in range(cap - 1, 0, -1) for _ in range(int(counts[i]))]:
        fits = [b for b in bins if cap - sum(b) >= x]
        (min(fits, key=lambda b: cap - sum(b)) if fits else bins.append([]) or bins[-1]).append(x)
    return bins


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 23), max_size=80))
def test_plan_places_every_piece(lengths):
    counts = np.bincount(np.array(lengths, int), minlength=24)
    bins = plan(counts)
    used = np.zeros(24, int)
    for xs, k in bins:
        assert k > 0 and sum(xs) <= 24
        for x in xs:
            used[x] += k
    assert used.tolist() == counts.tolist()
    assert sum(k for _, k in bins) <= len(brute(counts)) * 1.25 + 1


def test_exact_complements_first():
    counts = np.zeros(10, int)
    counts[[7, 3, 5, 4, 1]] = [2, 2, 1, 1, 1]
    assert sorted(plan(counts)) == [((5, 4, 1), 1), ((7, 3), 2)]
    counts = np.zeros(10, int)
    counts[[4, 3, 2, 1]] = 1
    assert plan(counts) == [((4, 3, 2, 1), 1)]


def check(out, sizes, cap):
    got, bins = {}, {}
    for r in out:
        if r["bin_id"] is None:
            assert r["n_tokens"] == 0
            continue
        got.setdefault(r["doc_id"], []).append((r["token_start"], r["n_tokens"]))
        bins.setdefault(r["bin_id"], []).append((r["bin_offset"], r["n_tokens"]))
    for d, n in sizes.items():
        at = 0
        for s, k in sorted(got.get(d, [])):
            assert s == at
            at += k
        assert at == n
    assert sorted(bins) == list(range(len(bins)))
    for xs in bins.values():
        at = 0
        for s, k in sorted(xs):
            assert s == at and k > 0
            at += k
        assert at <= cap
    return len(bins)


def test_documents(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    from telar.llm.packing import TOKEN

    sizes = {r[0]: r[1] for r in docs.select("doc_id", F.regexp_count("text", F.lit(TOKEN))).collect()}
    n = check(best_fit_pack(docs, 512).collect(), sizes, 512)
    assert n <= -(-sum(sizes.values()) // 512) * 1.05 + 1


@pytest.mark.parametrize("texts", [[], [None, ""], [None, "", "a b c", "a b c", "x " * 50]])
def test_edges(spark, texts):
    df = spark.createDataFrame([(i, t, 9) for i, t in enumerate(texts)], "doc_id long, text string, bin_id int")
    out = best_fit_pack(df, 8).collect()
    check(out, {i: len((t or "").split()) for i, t in enumerate(texts)}, 8)
    assert {r["doc_id"] for r in out} == set(range(len(texts)))


def test_repeated_rows(spark):
    df = spark.createDataFrame([(1, "a b c")] * 4 + [(None, "a b c d e")], "doc_id long, text string")
    out = best_fit_pack(df, 8).collect()
    assert len(out) == 5 and len({(r["bin_id"], r["bin_offset"]) for r in out}) == 5


def brute_plan(counts):
    """The method one bin at a time, by trying all lengths: a single one that fills the gap, then pairs, then triples, the longest first."""
    left, cap = [int(x) for x in counts], len(counts)
    bins, rest = [], []
    for length in range(cap - 1, 0, -1):
        while left[length]:
            left[length] -= 1
            gap, found = cap - length, None
            if left[gap]:
                found = (gap,)
            for a in range(gap - 1, 0, -1):
                if not found and 2 * a >= gap and left[a] and left[gap - a] > (2 * a == gap):
                    found = (a, gap - a)
            for x in range(gap - 2, 0, -1):
                if not found and left[x]:
                    left[x] -= 1
                    for a in range(gap - x - 1, 0, -1):
                        if not found and 2 * a >= gap - x and left[a] and left[gap - x - a] > (2 * a == gap - x):
                            found = (x, a, gap - x - a)
                    left[x] += 1
            if not found:
                rest += [length] * (left[length] + 1)
                left[length] = 0
                break
            for y in found:
                left[y] -= 1
            bins.append((length, *found))
    open_ = []
    for x in rest:
        fits = [b for b in open_ if cap - sum(b) >= x]
        (min(fits, key=lambda b: cap - sum(b)) if fits else open_.append([]) or open_[-1]).append(x)
    return sorted(tuple(sorted(b)) for b in [*bins, *open_])


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(1, 15), max_size=60))
def test_plan_by_brute_force(lengths):
    counts = np.bincount(np.array(lengths, int), minlength=16)
    got, want = [tuple(sorted(b)) for b, k in plan(counts) for _ in range(k)], brute_plan(counts)
    assert len(got) == len(want) and sorted(b for b in got if sum(b) == 16) == sorted(b for b in want if sum(b) == 16)


def test_query_by_brute_force(spark, sf_dir):
    """The bins of the registered query hold the lengths that the brute-force plan puts together."""
    from telar.llm.packing import TOKEN
    from telar.llm.queries import QUERIES

    sizes = [r[0] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.regexp_count("text", F.lit(TOKEN))).collect()]
    want = brute_plan(np.bincount([n % 2048 for n in sizes if n % 2048], minlength=2048))
    bins = {}
    for r in QUERIES["op1_best_fit_packing"](spark, sf_dir).collect():
        if r["bin_id"] is not None:
            bins.setdefault(r["bin_id"], []).append(r["n_tokens"])
    full = sum(n // 2048 for n in sizes)
    got = sorted(tuple(sorted(b)) for b in bins.values())
    assert len(got) == len(want) + full
    assert [b for b in got if sum(b) == 2048 and len(b) > 1] == [b for b in want if sum(b) == 2048]
