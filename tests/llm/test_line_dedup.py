from hashlib import md5

import pytest

from telar.llm.line_dedup import dedup_chunks


def chunk_bounds(lines):
    h = [int(md5(x.encode()).hexdigest()[:11], 16) for x in lines]
    ends = [i for i in range(len(lines)) if (h[i] + 31 * (h[i - 1] if i else 0)) % 4 == 0 or i == len(lines) - 1]
    return list(zip([0] + [e + 1 for e in ends[:-1]], ends))


def brute(rows):
    """{doc_id: text} after the earlier of equal multi-line chunks is kept, for distinct doc_ids."""
    seen, out = set(), {}
    for d, text in sorted(rows, key=lambda r: (r[0] is not None, r[0])):
        if text is None:
            out[d] = None
            continue
        lines, kept = text.split("\n"), []
        for a, b in chunk_bounds(lines):
            chunk = "\n".join(lines[a : b + 1])
            if b > a and chunk in seen:
                continue
            if b > a:
                seen.add(chunk)
            kept += lines[a : b + 1]
        out[d] = "\n".join(kept)
    return out


def test_documents(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    got = {r["doc_id"]: r["text"] for r in dedup_chunks(docs).collect()}
    assert got == brute([(r["doc_id"], r["text"]) for r in docs.collect()])


@pytest.mark.parametrize("rows", [[], [(1, None), (2, ""), (3, "one line"), (4, "one line"), (5, "\n" * 40), (6, "a\n" * 2000 + "b"), (7, "a\n" * 2000 + "b"), (8, "x\n" + "\n".join(f"line {i}" for i in range(40))), (9, "new\nlines\n" + "\n".join(f"line {i}" for i in range(40))), (None, "p\nq\nr\ns")]])
def test_edges(spark, rows):
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, _k string, n_removed_lines int")
    out = dedup_chunks(df)
    assert out.columns == ["doc_id", "text", "_k", "n_removed_lines"]
    got = {r["doc_id"]: r["text"] for r in out.collect()}
    assert got == brute(rows)
    if rows:
        assert got[9] != rows[8][1] and got[9].startswith("new")


def test_repeated_rows_are_alike(spark):
    text = "\n".join(f"line {i}" for i in range(30))
    out = dedup_chunks(spark.createDataFrame([(1, text), (1, text), (2, text)], "doc_id long, text string")).collect()
    assert [r["text"] for r in out if r["doc_id"] == 1] == [text, text]
    assert all(r["n_removed_lines"] > 20 for r in out if r["doc_id"] == 2)
