import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from telar.llm.token_ids import PATTERN, Chunker, pack, packed_tokens, token_at, token_ids, tokenizer_file, unpack, width

CHUNKER = Chunker(tokenizer_file(), PATTERN)


@settings(max_examples=80, deadline=None)
@given(st.integers(1, 32), st.lists(st.integers(0, 2**32 - 1), max_size=400))
def test_round_trip(bits, values):
    ids = np.array([v % (1 << bits) for v in values], np.uint32)
    data = pack(ids, bits, 64)
    assert len(data) == (len(ids) * bits + 7) // 8
    assert unpack(data, bits, len(ids)).tolist() == ids.tolist()
    offsets = list(range(0, -(-len(ids) // 64) * 8 * bits, 8 * bits))
    for i in range(0, len(ids), 17):
        assert token_at(data, offsets, bits, 64, i) == ids[i]


def test_width():
    assert [width(n) for n in (1, 2, 3, 32_000, 50_257, 65_537)] == [1, 1, 2, 15, 16, 17]


@settings(max_examples=300, deadline=None)
@given(st.text(st.sampled_from("ab'sdétll1 ,.\n\t\xa0 \x1c\x85 漢🙂"), max_size=30))
def test_chunks_are_independent(text):
    c = CHUNKER
    assert c(text).tolist() == c.tokenizer.encode_ordinary(text) == c(text).tolist()


def test_documents(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").limit(60)
    texts = {r[0]: r[1] for r in docs.select("doc_id", "text").collect()}
    c = Chunker(tokenizer_file(), PATTERN)
    packed = packed_tokens(docs, tokenizer_file())
    for r in token_ids(packed).collect():
        assert r["ids"] == c.tokenizer.encode_ordinary(texts[r["doc_id"]])
        assert c.tokenizer.decode(r["ids"]) == texts[r["doc_id"]]
    # another vocabulary size, another width
    for r in token_ids(packed_tokens(docs, tokenizer_file(), vocabulary=100_000, block=64)).collect():
        assert c.tokenizer.decode(r["ids"]) == texts[r["doc_id"]]


@pytest.mark.parametrize("rows", [[], [(1, None, "p"), (2, "", "p"), (2, "", "p"), (None, "x y", "p")]])
def test_edges(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string, payload string")
    out = packed_tokens(df, tokenizer_file()).collect()
    assert len(out) == len(rows)
    for r in out:
        if r["doc_id"] == 1:
            assert r["payload"] is None and r["n_tokens"] is None and r["block_offsets"] == []
        if r["doc_id"] == 2:
            assert r["payload"] == b"" and r["n_tokens"] == 0
