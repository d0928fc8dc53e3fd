import random
import re
from itertools import groupby

import numpy as np
import pyarrow as pa
import pytest

from telar.llm import passages
from telar.llm.passages import anchors, dedup_passages, word_hashes

WORD = r"[^ \t\r\n\f]+"


def brute(data, length):
    """As the docstring says, run by run."""
    rows = sorted(set(data), key=lambda r: (r[0] is not None, r[0] or 0))
    first, out = {}, {}
    for r in rows:
        if r[1] is None:
            out[r] = (None, 0, None)
            continue
        words, spans = re.findall(WORD, r[1].lower()), [m.span() for m in re.finditer(WORD + r"[ \t\r\n\f]*", r[1])]
        gone = set()
        for s in range(len(words) - length + 1):
            there = first.setdefault(tuple(words[s:s + length]), (r, s))
            if there[0] != r or s >= there[1] + length:
                gone |= set(range(s, s + length))
        cuts = [[i for _, i in g] for _, g in groupby(enumerate(sorted(gone)), lambda x: x[1] - x[0])]
        lead = re.match(r"[ \t\r\n\f]*", r[1])[0]
        kept = lead + "".join(r[1][a:b] for i, (a, b) in enumerate(spans) if i not in gone)
        out[r] = (kept, len(gone), ",".join(f"{spans[c[0]][0]}-{spans[c[-1]][1]}" for c in cuts))
    return sorted((str((r[0], *out[r])) for r in data))


def got(spark, data, length):
    return sorted(str(tuple(r)) for r in dedup_passages(spark.createDataFrame(data, "doc_id long, text string"), length).collect())


def test_passages_inside_lines(spark):
    """A passage of 60 words that begins and ends inside of lines goes but where it stands first; short lines stay."""
    passage = [f"w{i}" for i in range(60)]
    line = "one two three four five"
    a, b = f"intro {' '.join(passage)} outro\n{line}", f"{line}\nother {' '.join(passage[:30])}\n{'  '.join(passage[30:]).upper()} end"
    out = {r["doc_id"]: r for r in dedup_passages(spark.createDataFrame([(1, a), (2, b), (3, line)], "doc_id long, text string")).collect()}
    assert [out[i]["n_removed"] for i in (1, 2, 3)] == [0, 60, 0]
    assert (out[1]["text"], out[2]["text"], out[3]["text"]) == (a, f"{line}\nother end", line)


@pytest.mark.parametrize("length", [1, 2, 5, 8])
@pytest.mark.parametrize("seed", range(3))
def test_brute(spark, monkeypatch, seed, length):
    monkeypatch.setattr(passages, "SLICE", 1 << 20 if seed else 1)
    rng = random.Random(seed)
    blanks = [" ", "  ", "\n", "\t ", "\r\n"]
    made = lambda n, k: "".join(rng.choice("aBcdEé漢"[:k]) * rng.randint(1, 2) + rng.choice(blanks) for _ in range(n))
    shared = [made(rng.randint(4, 20), 7) for _ in range(4)]
    data = [(i, rng.choice(["", " \n"]) + "".join(rng.choice([made(rng.randint(0, 12), 7), rng.choice(shared), rng.choice(shared).upper()]) for _ in range(rng.randint(0, 5)))) for i in range(40)]
    data += [(50, None), (51, ""), (52, " \n "), (53, "a " * 60), (54, "A b " * 40), (None, "x " * 30 + data[3][1]), data[7], data[7]]
    assert got(spark, data, length) == brute(data, length)


def test_empty(spark):
    assert got(spark, [], 50) == []
    assert got(spark, [(1, None), (2, "")], 50) == brute([(1, None), (2, "")], 50)


def test_anchors_are_shared():
    """A run of 50 words has one anchor, wherever it stands."""
    rng = np.random.default_rng(1)
    run = " ".join(f"w{x}" for x in rng.integers(0, 300, 50))
    seen = set()
    for n in range(0, 90, 3):
        around = [" ".join(f"{c}{x}" for x in rng.integers(0, 300, n)) for c in "vu"]
        text, words, _ = word_hashes(pa.array([f"{around[0]} {run} {around[1]}"]))
        runs, at, hashes = anchors(words, text, 50)
        assert runs.tolist() == list(range(2 * n + 1))
        seen.add((int(at[n]) - n, int(hashes[n])))
    assert len(seen) == 1
