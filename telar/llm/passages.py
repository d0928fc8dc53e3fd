"""Passages of many words that stand earlier in the table, removed wherever in a text they begin and end."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from telar.llm._common import forget, materialize, sent

#: Words between white space, each with the white space after it; as elsewhere, white space is that of ASCII.
PIECE = re.compile(r"[^ \t\r\n\f]+[ \t\r\n\f]*")
#: Bytes of text whose hashes a worker holds at once, unless one text is longer.
SLICE = 1 << 20
_SPACE = np.isin(np.arange(256), list(b" \t\r\n\f"))
_BASES = (0x9E3779B97F4A7C15, 0xD1342543DE82EF95)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


def _slices(batches: Iterator[pa.RecordBatch], column: str) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        size = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        part = np.cumsum(size) // SLICE
        cuts = [0, *(np.flatnonzero(part[1:] != part[:-1]) + 1).tolist(), batch.num_rows]
        for a, b in zip(cuts, cuts[1:]):
            if b > a:
                yield batch.slice(a, b - a)


def word_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The words of all texts in a row: the text each is of, and two hashes of 64 bits."""
    texts = texts.cast(pa.large_string())
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset:texts.offset + len(texts) + 1]
    if len(texts) == 0 or offsets[-1] == offsets[0]:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    data = np.frombuffer(texts.buffers()[2], np.uint8)[offsets[0]:offsets[-1]]
    offsets = offsets - offsets[0]
    word = ~_SPACE[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    begins = word.copy()
    begins[1:] &= ~word[:-1] | edge[1:-1]
    starts = np.flatnonzero(begins)
    if not len(starts):
        return np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    text = np.searchsorted(offsets, starts, "right") - 1
    within = np.arange(len(data)) - starts[np.maximum(np.cumsum(begins) - 1, 0)]
    within[~word] = 0
    longest = int(within.max()) + 1
    hashes = []
    for base in _BASES:
        letters = _mixed(np.arange(256, dtype=np.uint64) + np.uint64(base))
        weighed = letters[data] * _powers(base, longest)[within]
        weighed[~word] = 0
        hashes.append(_mixed(np.add.reduceat(weighed, starts)))
    return text, *hashes


def run_hashes(words: np.ndarray, length: int, base: int) -> np.ndarray:
    """A hash of the run of length words that begins at each word; the last length - 1 words have none."""
    n = len(words) - length + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    sums = np.zeros(len(words) + 1, np.uint64)
    np.cumsum(words * _powers(base, len(words)), out=sums[1:])
    return _mixed((sums[length:] - sums[:-length]) * _powers(pow(base, -1, 1 << 64), n))


def anchors(words: np.ndarray, text: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(runs, at, hashes): the words where whole runs of length words begin, where each one's anchor does, and its hash.

    A run's anchor is the first of least hash of the runs of half its length in it, so equal runs have equal anchors.
    """
    short = (length + 1) // 2
    span = length - short + 1
    h = run_hashes(words, short, _BASES[0])
    if len(h) < span:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
    at, width = np.arange(len(h)), 1
    while width < span:
        step = min(width, span - width)
        left, right = at[:-step], at[step:]
        at, width = np.where(h[left] <= h[right], left, right), width + step
    runs = np.flatnonzero(text[:len(at)] == text[length - 1:])
    at = at[runs]
    return runs, at, h[at]


def dedup_passages(docs: DataFrame, length: int = 50) -> DataFrame:
    """(doc_id, text, n_removed, removed) of every row, without the passages that stand earlier in the table.

    Words are what stands between ASCII white space, and are equal if they are after lower-casing. A run of length words
    is a repeat if an equal run begins at a smaller (doc_id, place) and doesn't overlap it. All words of repeats go, each
    with the white space after it; n_removed is their number, and removed lists the stretches that went as begin-end in
    characters of the original text, joined by commas. So a passage of length words or more stays where it stands first,
    whatever lines or texts surround it, and shorter ones always stay.

    Equal runs have equal anchors, runs of half the length chosen by their hashes, about two of 27 of all at 50 words.
    Anchors are counted with partial aggregation; only runs with a repeated anchor are digested, to 64 bits beside its 64,
    and travel packed by anchor. Runs of one anchor meet in one task, where they are sorted, on disk if need be, and each
    is compared with the first of its digest: memory does not grow with copies, but the time of that task does. Texts meet
    the lists of their anchors and of what goes where they are as long as these are small enough to be sent to all; beyond
    that they are exchanged.

    A null text stays null, with 0 removed and removed null. An empty text stays; one whose words all go keeps the white
    space it began with. Texts of any length are read whole. A null doc_id ranks first. Rows with equal doc_id and text
    are treated alike. An empty table gives an empty result. Other columns are left out, whatever their names.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", "text", F.xxhash64("text").alias("_h"))

    def anchored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _slices(batches, "_l"):
            text, words, _ = word_hashes(b.column("_l"))
            _, at, hashes = anchors(words, text, length)
            at, one = np.unique(at, return_index=True)
            of, first = pa.array(text[at]), np.searchsorted(text, text[at])
            yield pa.RecordBatch.from_arrays([b.column("doc_id").take(of), b.column("_h").take(of), pa.array((at - first).astype(np.int32)), pa.array(hashes[one].view(np.int64))], names=["doc_id", "_h", "_pos", "_f"])

    def digested(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _slices(batches, "_l"):
            text, words, others = word_hashes(b.column("_l"))
            runs, at, hashes = anchors(words, text, length)
            begins, lists, wanted = np.searchsorted(text, np.arange(b.num_rows)), b.column("_at"), np.zeros(len(words) + 1, bool)
            wanted[lists.flatten().to_numpy(zero_copy_only=False) + np.repeat(begins, pc.list_value_length(lists).to_numpy(zero_copy_only=False))] = True
            some = wanted[at]
            runs, at, hashes = runs[some], at[some], hashes[some]
            # Runs of one anchor stand side by side, and a row has them all.
            one = np.flatnonzero(np.r_[True, (at[1:] != at[:-1])]) if len(at) else np.zeros(0, np.int64)
            digests = pa.array(run_hashes(others, length, _BASES[1])[runs].view(np.int64))
            packed = pa.ListArray.from_arrays(pa.array(np.r_[one, len(runs)].astype(np.int32)), digests)
            of = pa.array(text[runs[one]])
            yield pa.RecordBatch.from_arrays([b.column("doc_id").take(of), b.column("_h").take(of), pa.array((runs[one] - begins[text[runs[one]]]).astype(np.int32)), pa.array(hashes[one].view(np.int64)), packed], names=["doc_id", "_h", "_pos", "_f", "_d"])

    def repeats(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Of rows sorted by digest and place those that aren't the first of their digest, and don't overlap it."""
        last = start = None
        for b in batches:
            n = b.num_rows
            if not n:
                continue
            pos, doc = b.column("_pos").to_numpy().astype(np.int64), b.column("doc_id").dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False)
            f, d, h = (b.column(c).to_numpy() for c in ("_f", "_d", "_h"))
            new = np.ones(n, bool)
            new[1:] = (f[1:] != f[:-1]) | (d[1:] != d[:-1])
            new[0] = last is None or last != (f[0], d[0])
            # The first place of a digest that an earlier batch began is in start.
            origin = np.maximum.accumulate(np.where(new, np.arange(n), -1))
            inside, held = origin >= 0, np.maximum(origin, 0)
            same = (doc == doc[held]) & (h == h[held])
            there = pos[held]
            if not new[0]:
                k, ids = int((~inside).sum()), b.column("doc_id")
                same[:k] = (h[:k] == start[1]) & np.array([x == start[0] for x in ids.slice(0, k).to_pylist()])
                there[:k] = start[2]
            if new.any():
                o = int(origin[-1])
                start = (b.column("doc_id")[o].as_py(), h[o], pos[o])
            last = (f[-1], d[-1])
            yield b.filter(pa.array(~same | (pos >= there + length))).select(["doc_id", "_h", "_pos"])

    def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for at in b.column("_at"):
                s = np.sort(at.values.to_numpy(zero_copy_only=False))
                cut = np.flatnonzero(np.diff(s) > length)
                out.append(np.column_stack([s[np.r_[0, cut + 1]], s[np.r_[cut, len(s) - 1]] + length]).ravel())
            yield pa.RecordBatch.from_arrays([b.column("_id"), b.column("_gh"), pa.array(out, pa.list_(pa.int32()))], names=["_id", "_gh", "_gone"])

    def rebuild(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                b = batch.slice(at, 500)
                out, removed, went = [], [], []
                for text, gone in zip(b.column("text").to_pylist(), b.column("_gone").to_pylist()):
                    if text is None or not gone:
                        out.append(text), removed.append(0), went.append(None if text is None else "")
                        continue
                    begins = [m.start() for m in PIECE.finditer(text)] + [len(text)]
                    cuts = [(begins[s], begins[e]) for s, e in zip(gone[::2], gone[1::2])]
                    out.append("".join(text[a:b] for (_, a), (b, _) in zip([(0, 0), *cuts], [*cuts, (len(text), 0)])))
                    removed.append(sum(gone[1::2]) - sum(gone[::2]))
                    went.append(",".join(f"{a}-{b}" for a, b in cuts))
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(out, pa.string()), pa.array(removed, pa.int64()), pa.array(went, pa.string())], names=["doc_id", "text", "n_removed", "removed"])

    def met(table: DataFrame, lists: DataFrame, name: str, how: str) -> DataFrame:
        lists = sent(lists, F.size(name) * 4 + 64)
        return table.join(lists, F.col("doc_id").eqNullSafe(F.col("_id")) & F.col("_h").eqNullSafe(F.col("_gh")), how)

    key = [F.col("doc_id").alias("_id"), F.col("_h").alias("_gh")]
    place = f"doc_id {kind}, _h long, _pos int"
    lower = rows.select("doc_id", "_h", F.lower("text").alias("_l"))
    found = materialize(lower.mapInArrow(anchored, f"{place}, _f long"))
    again = found.groupBy("_f").count().filter("count > 1").select("_f")
    held = materialize(found.join(again, "_f").groupBy(*key).agg(F.collect_list("_pos").alias("_at")))
    forget(found)
    runs = met(lower, held, "_at", "inner").select("doc_id", "_h", "_l", "_at").mapInArrow(digested, f"{place}, _f long, _d array<long>")
    runs = runs.repartition("_f").select("doc_id", "_h", "_pos", "_f", F.posexplode("_d").alias("_i", "_d"))
    runs = runs.select("doc_id", "_h", (F.col("_pos") + F.col("_i")).alias("_pos"), "_f", "_d").sortWithinPartitions("_f", "_d", "doc_id", "_h", "_pos")
    gone = runs.mapInArrow(repeats, place).groupBy(*key).agg(F.collect_list("_pos").alias("_at"))
    gone = materialize(gone.mapInArrow(merged, f"_id {kind}, _gh long, _gone array<int>"))
    forget(held)
    return met(rows, gone, "_gone", "left").select("doc_id", "text", "_gone").mapInArrow(rebuild, f"doc_id {kind}, text string, n_removed long, removed string")


PASSAGES_SQL = r"""
WITH t AS (SELECT doc_id, text, regexp_extract_all(text, '[^ \t\r\n\f]+[ \t\r\n\f]*') AS pieces, regexp_extract_all(lower(text), '[^ \t\r\n\f]+') AS words FROM documents WHERE text IS NOT NULL),
r AS (SELECT doc_id, words, unnest(range(0, len(words) - 49)) AS pos FROM t),
d AS (SELECT doc_id, pos, first_value({'d': doc_id, 'p': pos}) OVER (PARTITION BY md5(array_to_string(words[pos + 1:pos + 50], ' ')) ORDER BY doc_id, pos) AS f FROM r),
g AS (SELECT DISTINCT doc_id, unnest(range(pos, pos + 50)) AS pos FROM d WHERE doc_id <> f.d OR pos >= f.p + 50),
p AS (SELECT doc_id, unnest(pieces) AS piece, unnest(range(0, len(pieces))) AS pos, length(regexp_extract(text, '^[ \t\r\n\f]*')) AS lead FROM t),
s AS (SELECT p.*, g.pos IS NOT NULL AS gone, lead + coalesce(sum(length(piece)) OVER (PARTITION BY p.doc_id ORDER BY p.pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start
      FROM p LEFT JOIN g ON p.doc_id = g.doc_id AND p.pos = g.pos),
i AS (SELECT *, pos - row_number() OVER (PARTITION BY doc_id, gone ORDER BY pos) AS stretch FROM s),
c AS (SELECT doc_id, CAST(CAST(min(start) AS BIGINT) AS VARCHAR) || '-' || CAST(CAST(max(start + length(piece)) AS BIGINT) AS VARCHAR) AS cut, min(pos) AS pos FROM i WHERE gone GROUP BY doc_id, stretch),
k AS (SELECT doc_id, string_agg(piece, '' ORDER BY pos) FILTER (WHERE NOT gone) AS text, count(*) FILTER (WHERE gone) AS n_removed FROM s GROUP BY doc_id),
w AS (SELECT doc_id, string_agg(cut, ',' ORDER BY pos) AS removed FROM c GROUP BY doc_id)
SELECT t.doc_id, regexp_extract(t.text, '^[ \t\r\n\f]*') || coalesce(k.text, '') AS text, CAST(coalesce(k.n_removed, 0) AS BIGINT) AS n_removed, coalesce(w.removed, '') AS removed
FROM t LEFT JOIN k ON t.doc_id = k.doc_id LEFT JOIN w ON t.doc_id = w.doc_id UNION ALL SELECT doc_id, text, 0, NULL FROM documents WHERE text IS NULL
"""
