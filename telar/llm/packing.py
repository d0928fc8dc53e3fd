"""Best-fit packing of documents into training sequences by exact-complement hashing."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from telar.llm._common import materialize

#: A token is a run of letters, digits and marks, or one other visible character.
TOKEN = r"[\p{L}\p{N}\p{M}]+|[^\s\p{L}\p{N}\p{M}]"
#: Ranks within a length are counted per bucket of rows, so that no task ranks a whole length.
BUCKETS = 1024


class _Complements:
    """Finds one, two or three available lengths that sum to a gap.

    Sums of pairs and of triples are indexed once, a triple's by the largest length that may begin one; an entry found to
    be no longer available is struck out, which is safe because counts only fall.
    """

    def __init__(self, left: np.ndarray) -> None:
        self.left, self.cap = left, len(left) - 1
        there = np.flatnonzero(left)
        pairs = np.zeros(2 * self.cap + 1, bool)
        for a in there.tolist():
            pairs[a + there] = True
        self.pair_sum = pairs[: self.cap + 1]
        # the largest first length of a triple of each sum, 0 where there is none
        self.triple_from = np.zeros(self.cap + 1, np.int64)
        for a in there.tolist():
            self.triple_from[a:][self.pair_sum[: self.cap + 1 - a]] = a

    def _pair(self, gap: int, taken: tuple[int, ...]) -> tuple[int, int] | None:
        """Two available lengths, those taken left out; the sum is struck out only if it can't be met with those either."""
        if gap < 2 or not self.pair_sum[gap]:
            return None
        a = np.arange(gap - 1, (gap - 1) // 2, -1)
        if not ((self.left[a] > 0) & (self.left[gap - a] > (2 * a == gap))).any():
            self.pair_sum[gap] = False
            return None
        for x in taken:
            self.left[x] -= 1
        fits = np.flatnonzero((self.left[a] > 0) & (self.left[gap - a] > (2 * a == gap)))
        for x in taken:
            self.left[x] += 1
        return (int(a[fits[0]]), gap - int(a[fits[0]])) if len(fits) else None

    def find(self, gap: int, length: int) -> tuple[int, ...] | None:
        """Lengths that fill the gap that one piece of `length` leaves."""
        if self.left[gap] > (gap == length):
            return (gap,)
        if pair := self._pair(gap, (length,)):
            return pair
        c = np.arange(self.triple_from[gap], 0, -1)
        for x in c[(self.left[c] > (c == length)) & self.pair_sum[gap - c]].tolist():
            if pair := self._pair(gap - x, (length, x)):
                self.triple_from[gap] = x
                return (x, *pair)
        self.triple_from[gap] = 0
        return None


def plan(counts: np.ndarray) -> list[tuple[tuple[int, ...], int]]:
    """Bins as (lengths, how many bins are made of these lengths), for counts[length] pieces, length < len(counts).

    Longest first, each length looks for combinations of one to three lengths that fill its gap exactly, as many at
    once as are available. What has none goes, longest first, to the open bin with the smallest gap that holds it.
    The work depends on the number of distinct lengths, not on the number of pieces.
    """
    left = counts.astype(np.int64).copy()
    cap = len(left)
    left = np.append(left, 0)  # left[cap]: full pieces are never here
    index, bins, rest = _Complements(left), [], np.zeros(cap + 1, np.int64)
    for length in range(cap - 1, 0, -1):
        while left[length] > 0:
            found = index.find(cap - length, length)
            if found is None:
                rest[length], left[length] = left[length], 0
                break
            lengths = (length, *found)
            uses = {x: lengths.count(x) for x in lengths}
            n = min(int(left[x]) // k for x, k in uses.items())
            for x, k in uses.items():
                left[x] -= n * k
            bins.append((lengths, n))
    open_: dict[int, list[tuple[tuple[int, ...], int]]] = {}
    for length in range(cap - 1, 0, -1):
        n = int(rest[length])
        while n:
            gap = min((g for g in open_ if g >= length), default=None)
            if gap is None:
                each = cap // length
                made = [((length,) * each, n // each), ((length,) * (n % each), 1 if n % each else 0)]
                n = 0
            else:
                lengths, have = open_[gap].pop()
                take = min(n, have)
                if have > take:
                    open_[gap].append((lengths, have - take))
                if not open_[gap]:
                    del open_[gap]
                made, n = [((*lengths, length), take)], n - take
            for lengths, k in made:
                if k:
                    open_.setdefault(cap - sum(lengths), []).append((lengths, k))
    return bins + [x for g in sorted(open_) for x in open_[g]]


def best_fit_pack(docs: DataFrame, capacity: int = 2048, length: Column | None = None) -> DataFrame:
    """Assign every token of every document to a bin of `capacity` tokens.

    Returns (doc_id, piece, token_start, n_tokens, bin_id, bin_offset): piece number `piece` of the document, its
    tokens from token_start on, stands at bin_offset of bin bin_id. A document longer than the capacity is cut into
    full pieces, each a bin of its own, and a rest; the rests are packed. Bins are numbered from 0 without gaps.

    Pieces are planned from the histogram of lengths, which has at most capacity - 1 rows whatever the input, and
    each piece finds its bin from its rank within its length. Ranks follow doc_id.

    Null and empty texts have no token: one row with bin_id and bin_offset null and n_tokens 0. Repeated rows and
    rows with equal or null doc_id are packed one by one. Texts of any length are counted whole, and cut. An empty table
    gives an empty result. Other columns are left out, whatever their names.
    """
    n = F.coalesce(length if length is not None else F.regexp_count(F.col("text"), F.lit(TOKEN)), F.lit(0))
    key = F.pmod(F.xxhash64("doc_id"), F.lit(BUCKETS)).cast("int")
    sized = materialize(docs.select("doc_id", n.cast("long").alias("_n")).select(
        "doc_id", (F.col("_n") / capacity).cast("long").alias("_full"), (F.col("_n") % capacity).cast("int").alias("_rest"), key.alias("_bucket")))
    counts = sized.groupBy("_rest", "_bucket").agg(F.count("*").alias("_k"), F.sum("_full").alias("_f"))
    counts = materialize(counts)
    histogram = counts.groupBy("_rest").agg(F.sum("_k").alias("k")).collect()
    have = np.zeros(capacity, np.int64)
    for row in histogram:
        have[row["_rest"]] = row["k"]
    have[0] = 0
    # for each length, the ranks at which a run of bins begins: (length, first rank, first bin, offset in bin)
    runs, next_rank, next_bin = [], np.zeros(capacity, np.int64), 0
    for lengths, k in plan(have):
        at = 0
        for x in lengths:
            runs.append((x, int(next_rank[x]), next_bin, at))
            next_rank[x] += k
            at += x
        next_bin += k
    runs.sort()
    table = np.array(runs, np.int64).reshape(-1, 4)
    first = np.searchsorted(table[:, 0], np.arange(capacity + 1))

    # Full pieces are numbered after the packed bins; both kinds get their number from counts per bucket.
    before = Window.partitionBy("_rest").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    per_rest = counts.groupBy("_rest").agg(F.sum("_f").alias("_fr")).withColumn("_of", F.lit(0))
    rest_start = per_rest.select("_rest", F.coalesce(F.sum("_fr").over(Window.partitionBy("_of").orderBy("_rest").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_f_rest"))
    starts = counts.select("_rest", "_bucket", F.coalesce(F.sum("_k").over(before), F.lit(0)).alias("_k0"), F.coalesce(F.sum("_f").over(before), F.lit(0)).alias("_f0")).join(rest_start, "_rest")
    within = Window.partitionBy("_rest", "_bucket").orderBy("doc_id", "_full")
    ranked = sized.withColumn("_rn", F.row_number().over(within) - 1).withColumn(
        "_fs", F.coalesce(F.sum("_full").over(within.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    placed = ranked.join(starts, ["_rest", "_bucket"]).select(
        "doc_id", "_full", F.col("_rest").cast("long").alias("_rest"), (F.col("_k0") + F.col("_rn")).alias("_rank"), (F.lit(next_bin) + F.col("_f_rest") + F.col("_f0") + F.col("_fs")).alias("_own"))

    def locate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rest, rank = b.column("_rest").to_numpy(), b.column("_rank").to_numpy()
            out_bin, out_at = np.zeros(len(rest), np.int64), np.zeros(len(rest), np.int64)
            if len(table):
                # runs are sorted by (length, first rank): one search over both
                span = int(max(table[:, 1].max(), rank.max(initial=0))) + 1
                row = np.searchsorted(table[:, 0] * span + table[:, 1], rest * span + rank, "right") - 1
                row = np.maximum(row, first[np.minimum(rest, capacity)].clip(max=len(table) - 1))
                out_bin, out_at = table[row, 2] + rank - table[row, 1], table[row, 3]
            none = rest == 0
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), b.column("_full"), b.column("_rest"), b.column("_own"), pa.array(out_bin, mask=none), pa.array(out_at, mask=none)],
                names=["doc_id", "_full", "_rest", "_own", "_bin", "_at"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    found = placed.mapInArrow(locate, f"doc_id {kind}, _full long, _rest long, _own long, _bin long, _at long")
    piece = F.explode(F.sequence(F.lit(0).cast("long"), F.col("_full") - F.when((F.col("_rest") == 0) & (F.col("_full") > 0), 1).otherwise(0)))
    last = F.col("piece") == F.col("_full")
    return found.withColumn("piece", piece).select(
        "doc_id", "piece", (F.col("piece") * capacity).alias("token_start"),
        F.when(last, F.col("_rest")).otherwise(F.lit(capacity)).cast("long").alias("n_tokens"),
        F.when(last, F.col("_bin")).otherwise(F.col("_own") + F.col("piece")).alias("bin_id"),
        F.when(last, F.col("_at")).otherwise(F.lit(0).cast("long")).alias("bin_offset"))
