"""Exact top-k search by BM25 over impact-ordered postings, score at a time."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from telar.llm._common import materialize
from telar.llm._words import chunks, hash_spans, spans

K1, B = 1.2, 0.75
#: Impacts are quantised to so many levels within a partition.
LEVELS = 255
#: Scores are rounded to so many decimals before ranking, so that equal scores are equal in every order of summation.
DECIMALS = 6


def _query_words(text: str) -> dict[int, int]:
    """Hash and number of occurrences of each word."""
    out: dict[int, int] = {}
    for _, _, data, offsets in chunks(pa.array([text])):
        s, e, _ = spans(data, offsets)
        for h in hash_spans(data, s, e).tolist():
            out[h] = out.get(h, 0) + 1
    return out


class ImpactIndex:
    """Postings of some terms over some documents, by term and descending quantised impact.

    An impact q of a posting of score w (per occurrence in a query) says that (q - 1) * step < w <= q * step.
    """

    def __init__(self, terms: int, term: np.ndarray, doc: np.ndarray, score: np.ndarray, documents: int) -> None:
        self.documents = documents
        self.step = max(float(score.max(initial=0)), 1e-9) / LEVELS
        q = np.maximum(1, np.ceil(score / self.step)).astype(np.int32)
        order = np.lexsort((doc, -q, term))
        self.term, self.doc, self.score, self.q = term[order], doc[order], score[order], q[order]
        self.first = np.searchsorted(self.term, np.arange(terms + 1))
        # the same postings by document, for rescoring
        self.by_doc = np.argsort(self.doc, kind="stable")
        self.doc_first = np.searchsorted(self.doc[self.by_doc], np.arange(documents + 1))
        change = np.append(True, (self.term[1:] != self.term[:-1]) | (self.q[1:] != self.q[:-1])) if len(self.term) else np.zeros(0, bool)
        self.segment = np.append(np.flatnonzero(change), len(self.term))
        self.segment_of = np.searchsorted(self.segment, self.first)

    def search(self, query: list[tuple[int, int]], k: int, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
        """(documents, scores, share of postings read) of the k best by (rounded score, id), exactly.

        Segments of all the query's terms are processed by descending impact times the term's number of occurrences.
        What a document has gathered bounds its score from below by the impacts less one level each, and from above by
        the impacts plus the next impact of each term. Processing stops when no other document's upper bound reaches the
        k-th best lower bound; all documents whose upper bound does are scored exactly.
        """
        weight, lists = [], []
        for t, n in query:
            a, b = int(self.segment_of[t]), int(self.segment_of[t + 1])
            if b > a:
                lists.append(np.arange(a, b))
                weight.append(np.full(b - a, n))
        if not lists:
            return np.zeros(0, np.int64), np.zeros(0), 0.0
        which = np.repeat(np.arange(len(lists)), [len(x) for x in lists])
        seg, w = np.concatenate(lists), np.concatenate(weight)
        impact = self.q[self.segment[seg]] * w
        order = np.argsort(-impact, kind="stable")
        seg, w, impact, which = seg[order], w[order], impact[order], which[order]
        sizes = self.segment[seg + 1] - self.segment[seg]
        done = np.cumsum(sizes)
        high = np.zeros(self.documents, np.int64)
        slack = np.zeros(self.documents, np.int32)
        at, target = 0, max(4 * k, 256)
        while True:
            stop = min(len(seg), int(np.searchsorted(done, target)) + 1)
            counts = sizes[at:stop]
            ends = np.cumsum(counts)
            rows = np.arange(ends[-1]) + np.repeat(self.segment[seg[at:stop]] - (ends - counts), counts)
            docs = self.doc[rows]
            high += np.bincount(docs, np.repeat(impact[at:stop], counts), self.documents).astype(np.int64)
            slack += np.bincount(docs, np.repeat(w[at:stop], counts), self.documents).astype(np.int32)
            at = stop
            # the next segment of each term comes first among those left of the term
            _, nexts = np.unique(which[at:], return_index=True)
            rest = int(impact[at:][nexts].sum())
            touched = np.flatnonzero(high)
            if at >= len(seg):
                rest = 0
            if len(touched) >= k or at >= len(seg):
                low = (high - slack)[touched]
                kth = np.partition(low, len(low) - k)[len(low) - k] if len(low) >= k else -1
                margin = 1 + int(2 * 10.0**-DECIMALS / self.step)
                possible = touched[high[touched] + rest + margin >= kth]
                # a document not yet met may gather the rest
                if at >= len(seg) or (rest + margin < kth and len(possible) <= max(8 * k, 64)):
                    break
            target = 2 * int(done[at - 1])
        scores = self.exact(query, possible)
        rank = np.lexsort((ids[possible], -scores))[:k]
        return possible[rank], scores[rank], float(done[at - 1] / done[-1])

    def exact(self, query: list[tuple[int, int]], docs: np.ndarray) -> np.ndarray:
        weight = np.zeros(len(self.first), np.float64)
        for t, n in query:
            weight[t] = n
        first, last = self.doc_first[docs], self.doc_first[docs + 1]
        counts = last - first
        ends = np.cumsum(counts)
        rows = self.by_doc[np.arange(ends[-1] if len(ends) else 0) + np.repeat(first - (ends - counts), counts)]
        parts = weight[self.term[rows]] * self.score[rows]
        return np.round(np.bincount(np.repeat(np.arange(len(docs)), counts), parts, len(docs)), DECIMALS)


def top_k(docs: DataFrame, queries: DataFrame, k: int = 10, id_column: str = "item_id", limit: int = 32 << 20) -> DataFrame:
    """(item_id, doc_id, rank, score) of the k best documents for every row of queries (item_id, text), exactly.

    The score is BM25 (k1 1.2, b 0.75, logarithm of 1 + (N - df + 0.5) / (df + 0.5)) over words, lower-cased runs
    of letters, digits and characters outside ASCII; a word that stands n times in a query counts n times. Scores are
    rounded to six decimals; of equal scores the smaller doc_id is first. Documents without any word of a query are no
    results.

    df, N and the mean length cover the whole table. Each input partition then is a shard with an impact-ordered index
    of the queries' words, and finds its own k best for each query by proof; the best of those are taken per query. The
    queries' words are sent to all executors in parts of at most `limit` bytes of text, each part a scan of its own.

    Null and empty texts have length 0: a document of them is never a result but counts in N, a query of them has no
    result. Texts of any length are read whole. Identifiers are integers of 64 bits; anything else is read as null. Rows with the same doc_id are results of their own; a null doc_id is last among equals. Repeated query rows
    give repeated results. An empty table on either side gives an empty result. Other columns are left out.
    """
    texts = docs.select(F.col("doc_id").try_cast("long").alias("doc_id"), F.lower("text").alias("text"))
    asked = materialize(queries.select(F.col(id_column).try_cast("long").alias("item_id"), F.lower("text").alias("text")))
    size = asked.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = -(-size // limit) or 1
    out = None
    for part in range(parts):
        mine = asked if parts == 1 else asked.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(parts)) == part)
        found = _search_part(texts, [(r[0], _query_words(r[1] or "")) for r in mine.collect()], k)
        out = found if out is None else out.unionByName(found)
    return out


def _search_part(texts: DataFrame, asked: list[tuple[int, dict[int, int]]], k: int) -> DataFrame:
    words = np.array(sorted({h for _, q in asked for h in q}), np.uint64)
    number = {int(h): i for i, h in enumerate(words)}
    plans = [(i, item, sorted((number[h], n) for h, n in q.items())) for i, (item, q) in enumerate(asked)]

    def postings(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """Per run of rows: its place, lengths, and (term, document within the run, occurrences) of the queries' words."""
        slot_bits = max(12, int(len(words)).bit_length() + 3)
        shift = np.uint64(64 - slot_bits)
        maybe = np.zeros(1 << slot_bits, bool)
        maybe[(words >> shift).astype(np.int64)] = True
        for a, b, data, offsets in chunks(column):
            s, e, first = spans(data, offsets)
            h = hash_spans(data, s, e)
            hit = np.flatnonzero(maybe[(h >> shift).astype(np.int64)])
            term = np.searchsorted(words, h[hit])
            good = words[np.minimum(term, len(words) - 1)] == h[hit] if len(words) else np.zeros(0, bool)
            hit, term = hit[good], term[good]
            doc = np.searchsorted(first, hit, "right") - 1
            code, n = np.unique(doc * max(1, len(words)) + term, return_counts=True)
            yield a, b, np.diff(first), code % max(1, len(words)), code // max(1, len(words)), n

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, n, total = np.zeros(len(words), np.int64), 0, 0
        for batch in batches:
            for _, _, lengths, term, _, _ in postings(batch.column("text")):
                df += np.bincount(term, minlength=len(words))
                n += len(lengths)
                total += int(lengths.sum())
        yield pa.RecordBatch.from_arrays([pa.array(np.append(np.arange(len(words)), [-1, -2])), pa.array(np.append(df, [n, total]))], names=["term", "n"])

    df, n_docs, total = np.zeros(len(words), np.int64), 0, 0
    for term, n in texts.select("text").mapInArrow(count, "term long, n long").groupBy("term").agg(F.sum("n")).collect():
        if term >= 0:
            df[term] = n
        elif term == -1:
            n_docs = n
        else:
            total = n
    idf = np.log(1 + (n_docs - df + 0.5) / (df + 0.5))
    mean = total / n_docs if n_docs and total else 1.0

    def shard(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, no_id, term, doc, score, at = [], [], [], [], [], 0
        for batch in batches:
            ids.append(pc.fill_null(batch.column("doc_id"), 0).to_numpy())
            no_id.append(batch.column("doc_id").is_null().to_numpy(zero_copy_only=False))
            for a, _, lengths, t, d, n in postings(batch.column("text")):
                term.append(t.astype(np.int32))
                doc.append((d + at + a).astype(np.int32))
                tf = n.astype(np.float64)
                score.append(idf[t] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * lengths[d] / mean)))
            at += batch.num_rows
        if not at:
            return
        ids, no_id = np.concatenate(ids), np.concatenate(no_id)
        place = np.empty(at, np.int64)
        place[np.lexsort((ids, no_id))] = np.arange(at)
        if not term or not sum(map(len, term)):
            return
        index = ImpactIndex(len(words), np.concatenate(term), np.concatenate(doc), np.concatenate(score), at)
        out: list[tuple[np.ndarray, ...]] = []
        for row, item, query in plans:
            docs, scores, _ = index.search(query, k, place)
            out.append((np.full(len(docs), row), np.full(len(docs), -1 if item is None else item), np.full(len(docs), item is None), ids[docs], no_id[docs], scores))
        row, item, no_item, found, unknown, scores = (np.concatenate(x) for x in zip(*out)) if out else [np.zeros(0)] * 6
        if len(row):
            yield pa.RecordBatch.from_arrays(
                [pa.array(row.astype(np.int64)), pa.array(item.astype(np.int64), mask=no_item.astype(bool)), pa.array(found, mask=unknown), pa.array(scores)],
                names=["row", "item_id", "doc_id", "score"])

    best = Window.partitionBy("row").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    found = texts.mapInArrow(shard, "row long, item_id long, doc_id long, score double")
    return found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("item_id", "doc_id", F.col("rank").cast("long").alias("rank"), "score")


TOP_K_SQL = r"""
WITH w AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[0-9a-z\x{80}-\x{10ffff}]+')) AS word FROM documents),
tf AS (SELECT doc_id, word, count(*) AS tf FROM w GROUP BY ALL),
len AS (SELECT d.doc_id, coalesce(sum(tf), 0) AS n FROM documents d LEFT JOIN tf USING (doc_id) GROUP BY d.doc_id),
stats AS (SELECT count(*) AS docs, sum(n) / count(*) AS mean FROM len),
q AS (SELECT item_id, word, count(*) AS qtf FROM (SELECT item_id, unnest(regexp_extract_all(lower(text), '[0-9a-z\x{80}-\x{10ffff}]+')) AS word FROM benchmark) GROUP BY ALL),
df AS (SELECT word, count(*) AS df FROM tf WHERE word IN (SELECT word FROM q) GROUP BY word),
s AS (SELECT q.item_id, tf.doc_id, round(sum(qtf * ln(1 + (docs - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * n / mean))), 6) AS score
      FROM q JOIN df USING (word) JOIN tf USING (word) JOIN len USING (doc_id), stats GROUP BY q.item_id, tf.doc_id),
r AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM s)
SELECT item_id, doc_id, rank, score FROM r WHERE rank <= 10
"""
