"""Pairs of documents with similar sets of word n-grams, by rare-first prefix filtering."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import Broadcast, TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from telar.llm._common import forget, grouped, materialize, planes, whole
from telar.llm._words import chunks, gram_hashes, hash_spans, mix, spans
from telar.llm.components import components, forest

#: Counters of the sketch of words.
WORD_BITS = 21
#: Bits of an n-gram's hash by which it is counted.
COUNT_BITS = 40
#: N-grams in more texts than this may be listed as frequent; of more than FREQUENT such n-grams the most frequent are.
LEAST, FREQUENT = 8, 1 << 21
#: Counters of a slice of a sketch.
SLICE_BITS = 15
#: Prefix n-grams that are joined at once, about, and how many times as many a part of their exchange has.
PART, TIMES = 1 << 22, 4
#: Bytes of text whose n-grams are counted together, about.
COUNTED = 16 << 20
#: N-grams of more sets than this link them by a star, others by pairs.
HOT = 64
#: N-grams of a part that two sets of a crowd share at least to be linked without counting their n-grams of other parts,
#: and sets of a crowd.
SURE, CROWD = 3, 8
#: Parts whose trees of links are merged at once.
TREES = 8
#: Bytes of a Bloom filter of candidates that may be broadcast; beyond, all sets are exchanged.
BLOOM_LIMIT = 32 << 20
#: N-grams of the sets that a task compares with as many others.
BLOCK = 1_000_000
_LOW = np.uint64((1 << 56) - 1)


def _distinct(g: np.ndarray) -> np.ndarray:
    g = np.sort(g)
    return g[np.append(True, g[1:] != g[:-1])] if len(g) else g


class Order:
    """A total order of n-grams, the rare first, the same in every document.

    Frequent n-grams are listed by a byte for each slot of their hashes and follow their counts over all texts, which are
    exact but for collisions of hashes. The others come before them, by the frequency expected from those of their words as
    if they met by chance.
    """

    def __init__(self, tokens: float, n: int, bits: int, least: int) -> None:
        """tokens: how many words there are in all; bits: of the slots; least: the level of the least frequent that are listed."""
        self.tokens, self.n, self.bits, self.least = max(1, int(tokens)), n, bits, least
        # in fifths of a power of two; words that were not met are as rare as those met once
        self.total = int(round(5 * np.log2(self.tokens)))
        self.word = np.full(1 << WORD_BITS, min(255, self.total), np.uint8)
        self.gram = np.zeros(1 << bits, np.uint8)

    @staticmethod
    def levels(counts: np.ndarray, tokens: int) -> np.ndarray:
        """A byte for each counter of a slice of words: what take keeps."""
        return np.round(5 * np.log2(tokens / np.maximum(counts, 1))).clip(0, 255).astype(np.uint8)

    @staticmethod
    def level(counts: np.ndarray) -> np.ndarray:
        """The places in the order of n-grams with these counts."""
        return np.round(5 * np.log2(counts) + 100).clip(0, 255).astype(np.uint64)

    def take(self, at: int, levels: bytes) -> None:
        self.word[at << SLICE_BITS : at + 1 << SLICE_BITS] = np.frombuffer(levels, np.uint8)

    def list(self, gram: np.ndarray, level: np.ndarray) -> None:
        np.maximum.at(self.gram, (gram >> np.uint64(COUNT_BITS - self.bits)).astype(np.int64), level.astype(np.uint8))

    def keys(self, column: pa.Array) -> Iterator[np.ndarray]:
        """The distinct n-grams of each text, as numbers that follow the order."""
        n = self.n
        for _, _, data, offsets in chunks(column):
            s, e, first = spans(data, offsets)
            h = hash_spans(data, s, e)
            by_word = self.word[(h >> np.uint64(64 - WORD_BITS)).astype(np.int64)].astype(np.int32)
            for (a, b), g in zip(zip(first[:-1].tolist(), first[1:].tolist()), gram_hashes(h, first, n)):
                if not len(g):
                    yield g
                    continue
                m = min(n, b - a)
                chance = self.total - by_word[a : b - m + 1]
                for i in range(1, m):
                    chance -= by_word[a + i : b - m + 1 + i]
                rank = np.maximum((chance + 100).clip(0, self.least - 1), self.gram[(g >> np.uint64(64 - self.bits)).astype(np.int64)]).astype(np.uint64)
                yield _distinct(rank << np.uint64(56) | g & _LOW)


def _prefix(size: int, t: float) -> int:
    """N-grams of which two sets of at least t similarity share one, whichever order all sets follow."""
    return size - math.ceil(t * size - 1e-9) + 1 if size else 0


def _order(texts: DataFrame, n: int) -> Order:
    """The order that follows from a sketch of the words, of fixed size, and from the counts of the n-grams of all texts."""
    size = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(16, -(-size // COUNTED))
    spread = np.array([-(-(i << COUNT_BITS) // parts) for i in range(parts + 1)], np.uint64)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << WORD_BITS, np.uint32)
        words, grams, size = [], [], 0

        def row(at: list[int], counts: list[bytes]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(counts, pa.binary())], names=["slice", "counts"])

        def add_up() -> Iterator[pa.RecordBatch]:
            nonlocal words, grams, size
            at = np.sort(np.concatenate(words))
            first = np.flatnonzero(np.append(True, at[1:] != at[:-1])) if len(at) else np.zeros(0, np.int64)
            total[at[first]] += np.diff(np.append(first, len(at))).astype(np.uint32)
            g = np.sort(np.concatenate(grams))
            cut = np.searchsorted(g, spread)
            there = np.flatnonzero(np.diff(cut)).tolist()
            words, grams, size = [], [], 0
            # sorted, so that differences are small
            yield row([1 << 20 | q for q in there], [planes(np.diff(g[cut[q] : cut[q + 1]], prepend=np.uint64(0))) for q in there])

        for b in batches:
            for _, _, data, offsets in chunks(b.column(0)):
                s, e, first = spans(data, offsets)
                h = hash_spans(data, s, e)
                words.append((h >> np.uint64(64 - WORD_BITS)).astype(np.int32))
                grams.append(np.concatenate([np.zeros(0, np.uint64), *map(_distinct, gram_hashes(h, first, n))]) >> np.uint64(64 - COUNT_BITS))
                size += len(h)
                if size > 2_000_000:
                    yield from add_up()
        if size:
            yield from add_up()
        for i, part in enumerate(total.reshape(-1, 1 << SLICE_BITS)):
            if part.any():
                yield row([i], [planes(part)])

    def add(table: pa.Table) -> Iterator[pa.RecordBatch]:
        at = table["slice"][0].as_py()
        if at >> 20:
            g = np.sort(np.concatenate([np.cumsum(whole(x, np.uint64), dtype=np.uint64) for x in table["counts"].to_pylist()]))
            first = np.flatnonzero(np.append(True, g[1:] != g[:-1]))
            counts = np.diff(np.append(first, len(g)))
            often = counts > LEAST
            level = Order.level(counts[often])
            kept = np.bincount(level.astype(np.int64), minlength=256)
            out = [(at, planes(kept), float(len(g))), (at + (1 << 20), planes(g[first[often]] << np.uint64(8) | level), 0.0)]
        else:
            total = np.zeros(1 << SLICE_BITS, np.int64)
            for x in table["counts"].to_pylist():
                total += whole(x, np.uint32)
            out = [(at, planes(total), float(total.sum()))]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), (pa.int32(), pa.binary(), pa.float64()))], names=["slice", "counts", "total"])

    counted = materialize(grouped(texts.select("text").mapInArrow(count, "slice int, counts binary"), ["slice"], add, "slice int, counts binary, total double"))
    kind = F.shiftright("slice", 20)
    totals = dict(counted.groupBy(kind).agg(F.sum("total")).collect())
    tokens = max(1, int(totals.get(0, 0)))

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(256, np.int64)
        for b in batches:
            for x in b.column(0).to_pylist():
                total += whole(x, np.int64)
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["kept"])

    kept = np.sum([np.frombuffer(r[0], np.int64) for r in counted.filter(kind == 1).select("counts").mapInArrow(summed, "kept binary").collect()] or [np.zeros(256, np.int64)], axis=0)
    above = np.cumsum(kept[::-1])[::-1]
    least = max(int(Order.level(np.array([LEAST + 1]))[0]), int(np.argmax(above <= FREQUENT)))
    order = Order(tokens, n, max(16, min(25, int(16 * above[least]).bit_length())), least)

    def level(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for at, x in zip(b.column("slice").to_pylist(), b.column("counts").to_pylist()):
                if at >> 20:
                    x = whole(x, np.uint64)
                    out.append(x[x & np.uint64(255) >= least].tobytes())
                else:
                    out.append(Order.levels(whole(x, np.int64), tokens).tobytes())
            yield pa.RecordBatch.from_arrays([b.column("slice"), pa.array(out, pa.binary())], names=["slice", "levels"])

    # a byte for each counter, 8 for each of at most FREQUENT n-grams
    for at, levels in counted.filter(kind != 1).select("slice", "counts").mapInArrow(level, "slice int, levels binary").toLocalIterator():
        if at >> 20:
            x = np.frombuffer(levels, np.uint64)
            order.list(x >> np.uint64(8), x & np.uint64(255))
        else:
            order.take(at, levels)
    forget(counted)
    return order


def _signature(key: np.ndarray) -> int:
    """63 bits that stand for the set."""
    return int(mix(np.add.reduce(mix(key)).reshape(1) + np.uint64(len(key)))[0] >> np.uint64(1))


class _Bloom:
    def __init__(self, values: np.ndarray) -> None:
        self.bits = max(13, int(len(values) * 12).bit_length())
        self.table = np.zeros(1 << self.bits - 3, np.uint8)
        for i in self._slots(values):
            np.bitwise_or.at(self.table, i >> 3, np.uint8(1) << (i & 7).astype(np.uint8))

    def _slots(self, values: np.ndarray) -> list[np.ndarray]:
        h = mix(values.astype(np.uint64))
        return [(h >> np.uint64(s) & np.uint64((1 << self.bits) - 1)).astype(np.int64) for s in (0, 17, 31)]

    def has(self, values: np.ndarray) -> np.ndarray:
        return np.logical_and.reduce([self.table[i >> 3] >> (i & 7).astype(np.uint8) & 1 for i in self._slots(values)]) > 0


def _similar(sets: list[np.ndarray], t: float, split: int | None = None) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(x, ys, similarities): all pairs of sets of at least t similarity, each once. With split, pairs across it only.

    Sets are arrays of order keys. The shorter sets' prefixes are indexed; a set looks its own up there and keeps those
    whose length, whose matched n-grams' positions, and whose suffixes' spread over ranges of the order allow the
    overlap needed. What is left is verified by exact intersection.
    """
    if len(sets) < 2:
        return
    order = sorted(range(len(sets)), key=lambda i: len(sets[i]))
    size = np.array([len(sets[i]) for i in order])
    # the sets' own frequencies give the order here, exactly
    flat = np.concatenate([sets[i] for i in order])
    _, number, df = np.unique(flat, return_inverse=True, return_counts=True)
    by_df = np.argsort(df, kind="stable")
    place = np.empty(len(df), np.int64)
    place[by_df] = np.arange(len(df))
    flat, df = place[number], df[by_df]
    first = np.concatenate([[0], np.cumsum(size)])
    owner = np.repeat(np.arange(len(sets)), size)
    flat = flat[np.lexsort((flat, owner))]
    at = np.arange(len(flat)) - first[owner]
    prefix = np.array([_prefix(int(n), t) for n in size])
    index = np.flatnonzero((at < prefix[owner]) & (df[flat] > 1))
    by_gram = index[np.argsort(flat[index], kind="stable")]
    start = np.searchsorted(flat[by_gram], np.arange(len(df) + 1))
    spread_of = flat * 16 // max(1, len(df))
    spread = np.bincount(owner * 16 + spread_of, minlength=len(sets) * 16).reshape(-1, 16)
    right = np.array([split is not None and i >= split for i in order])
    mark = np.zeros(len(df), bool)
    for x in range(1, len(sets)):
        mine = flat[first[x] : first[x] + prefix[x]]
        counts = start[mine + 1] - start[mine]
        if not counts.any():
            continue
        ends = np.cumsum(counts)
        posts = by_gram[np.arange(ends[-1]) + np.repeat(start[mine] - (ends - counts), counts)]
        y = owner[posts]
        before = y < x
        if split is not None:
            before &= right[y] != right[x]
        # length filter
        before &= size[y] >= t * size[x] - 1e-9
        if not before.any():
            continue
        posts, y = posts[before], y[before]
        i = np.repeat(np.arange(len(mine)), counts)[before]
        if 8 * len(y) > x:
            slot, among = y, np.arange(x)
        else:
            among, slot = np.unique(y, return_inverse=True)
        matched = np.bincount(slot, minlength=len(among))
        last_x, last_y = np.zeros(len(among), np.int64), np.zeros(len(among), np.int64)
        np.maximum.at(last_x, slot, i)
        np.maximum.at(last_y, slot, at[posts])
        # positional filter: prefix n-grams matched, and what can follow the last match
        met = np.flatnonzero(matched)
        ys = among[met]
        need = np.ceil(t / (1 + t) * (size[x] + size[ys]) - 1e-9)
        fits = matched[met] + np.minimum(size[x] - last_x[met] - 1, size[ys] - last_y[met] - 1) >= need
        ys, need = ys[fits], need[fits]
        # suffix filter: ranges of the order bound the symmetric difference
        ys = ys[np.abs(spread[ys] - spread[x]).sum(1) <= size[x] + size[ys] - 2 * need]
        if not len(ys):
            continue
        mark[flat[first[x] : first[x + 1]]] = True
        n = size[ys]
        ends = np.cumsum(n)
        rows = np.arange(ends[-1]) + np.repeat(first[ys] - (ends - n), n)
        both = np.add.reduceat(mark[flat[rows]].astype(np.int64), ends - n)
        mark[flat[first[x] : first[x + 1]]] = False
        j = both / (size[x] + n - both)
        good = j >= t - 1e-12
        if good.any():
            yield order[x], np.array([order[v] for v in ys[good].tolist()]), j[good]


def _packed(part: np.ndarray, parts: int, columns: list[np.ndarray], to_bytes: Callable[[np.ndarray], bytes] = np.ndarray.tobytes) -> Iterator[tuple[int, list[bytes]]]:
    """The rows of each part, column by column."""
    order = np.argsort(part, kind="stable")
    cut = np.searchsorted(part[order], np.arange(parts + 1))
    for q in np.flatnonzero(np.diff(cut)).tolist():
        rows = order[cut[q] : cut[q + 1]]
        yield q, [to_bytes(c[rows].reshape(-1)) for c in columns]


def _needed(n: np.ndarray, m: np.ndarray, t: float) -> np.ndarray:
    """How many prefix n-grams two sets of these sizes share at least, if they are similar.

    Their common n-grams up to where the first prefix ends are in both prefixes; the others are in what follows it.
    """
    rest = [x - (x - np.ceil(t * x - 1e-9) + 1) for x in (n, m)]
    return np.maximum(1, np.ceil(t / (1 + t) * (n + m) - 1e-9) - np.maximum(*rest))


def _short(sig: int) -> int:
    """48 bits of a signature: enough to link candidates, as two sets taken for one only link more."""
    return sig >> 15


def _candidates(texts: DataFrame, t: float, rank: Broadcast, parts: int) -> DataFrame:
    """(short, comp): the sets that may be similar to another, and the connected components of those that may be.

    Sets that share an n-gram of their prefixes are linked if so many of these as a similar pair needs are shared, or if
    one of them is shared by more than HOT sets, whose pairs are not listed. Of sets linked in a part it passes on
    a tree, and none of their pairs: else a group of near copies would pass on the square of its sets once for each part.
    So CROWD sets and more are linked as well if pairs that share in this part alone SURE n-grams, and more than its share
    of those needed, connect them.
    """
    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        order_of = rank.value
        for b in batches:
            held, sigs, sizes, counts, size, seen = [], [], [], [], 0, set()
            for key in chain(order_of.keys(b.column(0)), [None]):
                if key is not None and len(key):
                    sig = _short(_signature(key))
                    # every document posts its signature, and each set its prefix, once in a task
                    posts = [np.array([sig], np.uint64)]
                    if sig not in seen:
                        seen.add(sig)
                        posts.append(key[: _prefix(len(key), t)])
                    held += posts
                    sigs.append(sig)
                    sizes.append(len(key))
                    counts.append(sum(map(len, posts)))
                    size += counts[-1]
                if held and (key is None or size > 1_000_000):
                    token = mix(np.concatenate(held))
                    part = (token % np.uint64(parts * TIMES)).astype(np.int64)
                    own, n = np.array(sigs, "<i8"), np.array(sizes, np.uint32)
                    rows = []
                    for q, (tokens, which) in _packed(part, parts * TIMES, [(token >> np.uint64(32)).astype("<u4"), np.repeat(np.arange(len(sigs)), counts)]):
                        w = np.frombuffer(which, np.int64)
                        f = np.flatnonzero(np.append(True, w[1:] != w[:-1]))
                        rows.append((q // TIMES, q % TIMES, tokens, own[w[f]].view(np.uint8).reshape(-1, 8)[:, :6].tobytes(), planes(n[w[f]]), planes(np.diff(np.append(f, len(w))).astype(np.uint32))))
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), (pa.int32(), pa.int32(), *[pa.binary()] * 4))], names=["part", "piece", "tokens", "sigs", "sizes", "counts"])
                    held, sigs, sizes, counts, size = [], [], [], [], 0

    def flat(table: pa.Table, column: str) -> bytes:
        return b"".join(table[column].to_pylist())

    def unpacked(table: pa.Table, column: str, kind: type) -> np.ndarray:
        return np.concatenate([whole(x, kind) for x in table[column].to_pylist()])

    def joined(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Both ends of stars and loops, and (sig, sig, size, size, count) of pairs that share n-grams of a piece."""
        token, runs = np.frombuffer(flat(table, "tokens"), "<u4"), unpacked(table, "counts", np.uint32)
        sig = np.zeros((len(runs), 8), np.uint8)
        sig[:, :6] = np.frombuffer(flat(table, "sigs"), np.uint8).reshape(-1, 6)
        sig, n = np.repeat(sig.reshape(-1).view("<i8"), runs), np.repeat(unpacked(table, "sizes", np.uint32), runs)
        # n-grams of one set alone are most, and go first
        order = np.argsort(token, kind="stable")
        new = np.append(True, token[order][1:] != token[order][:-1])
        alone = new & np.append(new[1:], True)
        order = order[~alone]
        order = order[np.lexsort((sig[order], token[order]))]
        token, sig, n = token[order], sig[order], n[order].astype(np.int64)
        again = np.append(False, (token[1:] == token[:-1]) & (sig[1:] == sig[:-1])) if len(token) else np.zeros(0, bool)
        # a signature posted twice is a loop: a set of several documents, which may have no other link
        loops = np.unique(sig[again & (token == (mix(sig.astype(np.uint64)) >> np.uint64(32)).astype(np.uint32))])
        token, sig, n = token[~again], sig[~again], n[~again]
        first = np.flatnonzero(np.append(True, token[1:] != token[:-1])) if len(token) else np.zeros(0, np.int64)
        length = np.diff(np.append(first, len(token)))
        run, long = np.repeat(np.arange(len(first)), length), np.repeat(length, length)
        hot = long > HOT
        least = np.repeat(sig[first], length)
        a, b = forest(sig[hot], least[hot])
        a, b = np.concatenate([a, loops]), np.concatenate([b, loops])
        run, sig, n = run[~hot], sig[~hot], n[~hot]
        pairs = [np.zeros((0, 5), np.int64)]
        for d in range(1, HOT):
            i = np.flatnonzero(run[d:] == run[:-d])
            if not len(i):
                break
            i = i[np.minimum(n[i], n[i + d]) >= t * np.maximum(n[i], n[i + d]) - 1e-9]
            pairs.append(np.column_stack([sig[i], sig[i + d], n[i], n[i + d], np.ones(len(i), np.int64)]))
        return a, b, summed(np.concatenate(pairs))

    def summed(pairs: np.ndarray) -> np.ndarray:
        pairs = pairs[np.lexsort((pairs[:, 1], pairs[:, 0]))]
        first = np.flatnonzero(np.append(True, (pairs[1:, :2] != pairs[:-1, :2]).any(1))) if len(pairs) else np.zeros(0, np.int64)
        out = pairs[first]
        out[:, 4] = np.add.reduceat(pairs[:, 4], first) if len(first) else 0
        return out

    def rooted(node: np.ndarray, root: np.ndarray, x: np.ndarray) -> np.ndarray:
        """The roots of x in a forest, whose nodes are sorted."""
        if not len(node):
            return x
        at = np.minimum(np.searchsorted(node, x), len(node) - 1)
        return np.where(node[at] == x, root[at], x)

    def link(table: pa.Table) -> Iterator[pa.RecordBatch]:
        # a pair counted over all pieces of a part is passed on once
        pieces = table["piece"].to_numpy()
        a, b, pairs = zip(*[joined(table.take(np.flatnonzero(pieces == q))) for q in np.unique(pieces).tolist()])
        a, b, pairs = np.concatenate(a), np.concatenate(b), summed(np.concatenate(pairs))
        loops = np.unique(a[a == b])
        need = _needed(pairs[:, 2], pairs[:, 3], t)
        sure = pairs[:, 4] >= np.minimum(need, np.maximum(SURE, np.ceil(need / parts) + 1))
        node, root = forest(pairs[sure, 0], pairs[sure, 1])
        roots, below = np.unique(root, return_counts=True)
        sure &= (pairs[:, 4] >= need) | np.isin(rooted(node, root, pairs[:, 0]), roots[below >= CROWD - 1])
        a, b = forest(np.concatenate([a, pairs[sure, 0]]), np.concatenate([b, pairs[sure, 1]]))
        pairs = pairs[rooted(a, b, pairs[:, 0]) != rooted(a, b, pairs[:, 1])]
        a, b = np.concatenate([a, loops]), np.concatenate([b, loops])
        if len(a):
            yield pa.RecordBatch.from_arrays([pa.array([-1 - table["part"][0].as_py() // TREES], pa.int32()), *[pa.array([planes(x)]) for x in (a, b)], pa.array([b""]), pa.array([b""])], names=["part", "a", "b", "counts", "sizes"])
        part = (mix(pairs[:, 0].astype(np.uint64) * np.uint64(3) + pairs[:, 1].astype(np.uint64)) % np.uint64(parts)).astype(np.int64)
        rows = [(q, *x) for q, x in _packed(part, parts, [np.ascontiguousarray(pairs[:, 0]), np.ascontiguousarray(pairs[:, 1]), pairs[:, 4].astype(np.uint32), pairs[:, 2:4].astype(np.uint32)], planes)]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), (pa.int32(), *[pa.binary()] * 4))], names=["part", "a", "b", "counts", "sizes"])

    def keep(table: pa.Table) -> Iterator[pa.RecordBatch]:
        if table["part"][0].as_py() < 0:
            a, b, loops = (np.zeros(0, np.int64) for _ in range(3))
            for x, y in zip(*(table[c].to_pylist() for c in "ab")):
                x, y = whole(x, np.int64), whole(y, np.int64)
                loops = np.union1d(loops, x[x == y])
                a, b = forest(np.concatenate([a, x]), np.concatenate([b, y]))
            a, b = np.concatenate([a, loops]), np.concatenate([b, loops])
        else:
            a, b = unpacked(table, "a", np.int64), unpacked(table, "b", np.int64)
            count, n = unpacked(table, "counts", np.uint32).astype(np.int64), unpacked(table, "sizes", np.uint32).reshape(-1, 2).astype(np.int64)
            order = np.lexsort((b, a))
            a, b, count, n = a[order], b[order], count[order], n[order]
            first = np.flatnonzero(np.append(True, (a[1:] != a[:-1]) | (b[1:] != b[:-1])))
            good = np.add.reduceat(count, first) >= _needed(n[first, 0], n[first, 1], t)
            a, b = a[first][good], b[first][good]
        yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

    posted = texts.select("text").mapInArrow(emit, "part int, piece int, tokens binary, sigs binary, sizes binary, counts binary")
    linked = grouped(posted, ["part"], link, "part int, a binary, b binary, counts binary, sizes binary")
    edges = materialize(grouped(linked, ["part"], keep, "a long, b long"))
    joined = components(edges).select(F.col("node").alias("short"), F.col("component").alias("comp"))
    alone = edges.filter("a = b").select(F.col("a").alias("short"), F.col("a").alias("comp")).distinct().join(joined, "short", "left_anti")
    out = materialize(joined.union(alone))
    forget(edges)
    return out


def _gathered(docs: DataFrame, n: int, t: float) -> tuple[DataFrame, DataFrame]:
    """((doc_id, sig, n, w, task, keys) of every row, and the candidates).

    sig is null where the set is similar to no other for certain; keys has the set, once in each task for rows of equal sets.
    """
    rows = docs.select(F.col("doc_id").try_cast("long").alias("doc_id"), F.lower("text").alias("text"))
    texts = rows.filter("doc_id is not null and text is not null")
    spark = docs.sparkSession
    order = _order(texts, n)
    parts, rank = max(16, order.tokens // (PART * TIMES)), spark.sparkContext.broadcast(order)
    del order
    comps = _candidates(texts, t, rank, parts)
    count = comps.count()
    bloom = None
    if count * 12 / 8 * 2 <= BLOOM_LIMIT:
        values = comps.select("short").toPandas()["short"].to_numpy() if count else np.zeros(0, np.int64)
        bloom = spark.sparkContext.broadcast(_Bloom(values))

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        order_of, filter_ = rank.value, bloom.value if bloom is not None else None
        task, seen = TaskContext.get().partitionId(), set()
        for b in batches:
            ids, out, size = b.column("doc_id").to_pylist(), [], 0

            def flush() -> pa.RecordBatch:
                known = np.array([k is not None for _, _, k in out])
                if filter_ is not None:
                    known &= filter_.has(_short(np.array([s for _, s, _ in out], np.int64)))
                rows = []
                for (d, s, key), there in zip(out, known.tolist()):
                    if not there:
                        rows.append((d, None, None, None, task, None))
                        continue
                    first = s not in seen
                    seen.add(s)
                    # without their ranks, which every pair of blocks finds anew: 56 bits, whose differences are packed
                    rows.append((d, s, len(key), 1 + len(key) * first, task, planes(np.diff(np.sort(key & _LOW), prepend=np.uint64(0))) if first else None))
                return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), (*[pa.int64()] * 4, pa.int32(), pa.binary()))], names=["doc_id", "sig", "n", "w", "task", "keys"])

            for d, key in zip(ids, order_of.keys(b.column("text"))):
                out.append((d, _signature(key), key) if len(key) and d is not None else (d, 0, None))
                size += len(key)
                if size > 1_000_000:
                    yield flush()
                    out, size = [], 0
            if out:
                yield flush()

    # the sets are moved to the pairs of their blocks; which these are is worked out without them
    sets = materialize(rows.mapInArrow(gather, "doc_id long, sig long, n long, w long, task int, keys binary"))
    rank.destroy()
    if bloom is not None:
        bloom.destroy()
    return sets, comps


def _blocked(sized: DataFrame, comps: DataFrame) -> DataFrame:
    """The rows (sig, n, _w) of the sets with their components and blocks there, in order of their lengths."""
    each = sized.withColumn("short", F.shiftright("sig", 15)).join(comps, "short").drop("short")
    within = Window.partitionBy("comp").orderBy("n", "sig").rowsBetween(Window.unboundedPreceding, -1)
    return materialize(each.withColumn("_b", F.coalesce(F.sum("_w").over(within) / BLOCK, F.lit(0.0)).cast("int")))


def _blocks(docs: DataFrame, n: int, t: float) -> DataFrame:
    """(comp, bi, bj, side, doc_id, sig, keys): the documents of each component, once for each pair of its blocks."""
    sets, comps = _gathered(docs, n, t)
    sets = sets.filter("sig is not null")
    blocked = _blocked(sets.groupBy("sig").agg(F.max("n").alias("n"), F.sum("w").alias("_w")), comps)
    forget(comps)
    return sets.join(_paired(blocked, t), "sig").select("comp", "bi", "bj", "side", "doc_id", "sig", "keys")


def _paired(blocked: DataFrame, t: float) -> DataFrame:
    """(sig, comp, bi, bj, side): where each set goes: of each component, those pairs of blocks whose lengths can be similar."""
    ranges = blocked.groupBy("comp", "_b").agg(F.min("n").alias("_low"), F.max("n").alias("_high"))
    left = ranges.select("comp", F.col("_b").alias("bi"), F.col("_high").alias("_hi"))
    right = ranges.select("comp", F.col("_b").alias("bj"), F.col("_low").alias("_lj"))
    pairs = left.join(right, "comp").filter((F.col("bi") <= F.col("bj")) & ((F.col("bi") == F.col("bj")) | (F.col("_hi") >= F.col("_lj") * t - 1e-9))).select("comp", "bi", "bj")
    sides = pairs.select("comp", "bi", "bj", F.col("bi").alias("_b"), F.lit(0).alias("side")).union(pairs.filter("bi < bj").select("comp", "bi", "bj", F.col("bj"), F.lit(1)))
    return blocked.select("comp", "sig", "_b").join(sides, ["comp", "_b"]).select("sig", "comp", "bi", "bj", "side")


def _members(table: pa.Table) -> tuple[list[np.ndarray], list[np.ndarray], int]:
    """(sets, doc_ids of each set, number of sets of side 0) of a pair of blocks; one set for equal signatures of a side."""
    side, sig, doc = (table[c].to_numpy() for c in ("side", "sig", "doc_id"))
    keys = table["keys"].combine_chunks()
    order = np.lexsort((doc, sig, side))
    cut = np.flatnonzero(np.append(True, (sig[order][1:] != sig[order][:-1]) | (side[order][1:] != side[order][:-1])))
    groups = np.split(order, cut[1:])
    have = {}
    valid = keys.is_valid().to_numpy(zero_copy_only=False)
    for i in np.flatnonzero(valid).tolist():
        have.setdefault(int(sig[i]), i)
    sets, ids = [], []
    for g in groups:
        s = int(sig[g[0]])
        sets.append(np.cumsum(whole(keys[have[s]].as_py(), np.uint64), dtype=np.uint64))
        ids.append(np.unique(doc[g]))
    return sets, ids, int((side[order][cut] == 0).sum())


def jaccard_pairs(docs: DataFrame, n: int = 3, threshold: float = 0.5) -> DataFrame:
    """(doc_a, doc_b, jaccard), doc_a < doc_b: all pairs of documents whose sets of word n-grams are that similar.

    Words are lower-cased runs of letters, digits and characters outside ASCII; all the words of a text of fewer than n
    are one n-gram. Similarity is Jaccard's, of sets, at least `threshold`.

    1. Sketches of fixed size count words and n-grams over all texts; from them follows an order of n-grams, the rare
       first, which any document can compute for its own.
    2. Of each distinct set the prefix that any similar set must meet is posted, in parts by n-gram. Sets whose prefixes
       share as many n-grams as their lengths require are linked, and links make connected components: no similar pair
       lies across two.
    3. The sets of the components are brought together, large components in blocks by length, and pairs of blocks whose
       lengths differ too much are left out. Within, prefixes are joined again in the exact order of rarity there, with
       length, positional and suffix filters, and each pair left is verified once, by exact intersection.

    Documents of equal sets are one set with several members up to the output, which has all their pairs. No partner or
    candidate is capped.

    Null, empty and wordless texts are in no pair, nor is a row with a null doc_id, or one that is no integer of 64 bits.
    Texts of any length are read whole. Rows of the same doc_id are no pair;
    where their texts differ, a pair is listed once, with its largest similarity. An empty table gives an empty result.
    Other columns are left out.
    """

    def verify(table: pa.Table) -> Iterator[pa.RecordBatch]:
        sets, ids, split = _members(table)
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        size = 0

        def product(a: np.ndarray, b: np.ndarray, j: float) -> None:
            nonlocal size
            held.append((np.repeat(a, len(b)), np.tile(b, len(a)), np.full(len(a) * len(b), j)))
            size += len(a) * len(b)

        def flush() -> pa.RecordBatch:
            nonlocal held, size
            a, b, j = (np.concatenate(x) for x in zip(*held))
            held, size = [], 0
            apart = a != b
            return pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)[apart]), pa.array(np.maximum(a, b)[apart]), pa.array(j[apart])], names=["doc_a", "doc_b", "jaccard"])

        two_sides = split < len(sets)
        if not two_sides:
            for x in ids:
                for i in range(len(x) - 1):
                    product(x[i : i + 1], x[i + 1 :], 1.0)
                    if size > 200_000:
                        yield flush()
        for x, ys, js in _similar(sets, threshold, split if two_sides else None):
            for y, v in zip(ys.tolist(), js.tolist()):
                product(ids[x], ids[y], v)
            if size > 200_000:
                yield flush()
        if held:
            yield flush()

    kind = "doc_a long, doc_b long, jaccard double"
    found = grouped(_blocks(docs, n, threshold), ["comp", "bi", "bj"], verify, kind)
    return found.groupBy("doc_a", "doc_b").agg(F.max("jaccard").alias("jaccard"))


def _classes(docs: DataFrame, n: int, t: float, count: bool = True) -> tuple[DataFrame, DataFrame]:
    """((doc_id, sig) of every row, (sig, owner_id, n_links) of every set that is similar to another or of several rows).

    Of rows with equal sets one stands for all where sets are compared, so that copies cost nothing there. Without count
    n_links is not to be used.
    """
    sets, comps = _gathered(docs, n, t)
    there = F.col("keys").isNotNull()
    sized = sets.filter("sig is not null").groupBy("sig").agg(F.max("n").alias("n"), F.count("*").alias("m"), F.min("doc_id").alias("least"), F.min(F.when(there, F.col("task"))).alias("task"))
    blocked = _blocked(sized.withColumn("_w", F.col("n") + 1), comps)
    forget(comps)

    def compare(table: pa.Table) -> Iterator[pa.RecordBatch]:
        side, sig, m = (table[c].to_numpy() for c in ("side", "sig", "m"))
        order = np.lexsort((sig, side))
        side, sig, m = side[order], sig[order], m[order]
        keys = table["keys"].combine_chunks().take(pa.array(order))
        split = int((side == 0).sum())
        links, a, b = np.zeros(len(sig), np.int64), [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for x, ys, _ in _similar([np.cumsum(whole(k.as_py(), np.uint64), dtype=np.uint64) for k in keys], t, split if split < len(sig) else None):
            links[x] += m[ys].sum()
            links[ys] += m[x]
            a.append(sig[ys])
            b.append(np.full(len(ys), sig[x]))
            if len(a) > 1000:
                a, b = ([v] for v in forest(np.concatenate(a), np.concatenate(b)))
        p, q = forest(np.concatenate(a), np.concatenate(b))
        yield pa.RecordBatch.from_arrays([pa.array(p), pa.array(q), pa.nulls(len(p), pa.int64())], names=["a", "b", "k"])
        if count:
            some = links > 0
            yield pa.RecordBatch.from_arrays([pa.array(sig[some]), pa.nulls(int(some.sum()), pa.int64()), pa.array(links[some])], names=["a", "b", "k"])

    where = _paired(blocked, t).join(blocked.select("sig", "m", "task"), "sig")
    held = sets.filter(there).select("sig", "task", "keys").join(where, ["sig", "task"]).select("comp", "bi", "bj", "side", "sig", "m", "keys")
    found = materialize(grouped(held, ["comp", "bi", "bj"], compare, "a long, b long, k long"))
    linked = components(found.filter("b is not null")).select(F.col("node").alias("sig"), "component")
    counts = found.filter("b is null").groupBy(F.col("a").alias("sig")).agg(F.sum("k").alias("k"))
    each = materialize(blocked.select("sig", "m", "least").join(linked, "sig", "left").join(counts, "sig", "left").withColumn("component", F.coalesce("component", "sig")))
    owners = each.groupBy("component").agg(F.min("least").alias("owner_id"))
    forget(found)
    return sets.select("doc_id", "sig"), each.join(owners, "component").select("sig", "owner_id", (F.coalesce("k", F.lit(0)) + F.col("m") - 1).alias("n_links"))


def jaccard_classes(docs: DataFrame, n: int = 3, threshold: float = 0.5) -> DataFrame:
    """(doc_id, owner_id, n_links) of every row: the smallest doc_id connected with it by similar pairs, and its links.

    Similarity, order and search are those of jaccard_pairs. n_links counts the other rows whose sets are similar to the
    row's, its copies among them; no pair is listed, so there are as many rows as in the table. Rows of equal sets are
    compared as one. owner_id is the row's own doc_id where it has no links.

    Rows are taken one by one, repeated or not. Null, empty and wordless texts have no links, nor has a row with a null
    doc_id, or one that is no integer of 64 bits, whose doc_id and owner_id are null. Texts of any length are read whole. An
    empty table gives an empty result. Other columns are left out.
    """
    rows, classes = _classes(docs, n, threshold)
    alone = rows.filter("sig is null").select("doc_id", F.col("doc_id").alias("owner_id"), F.lit(0).cast("long").alias("n_links"))
    return rows.filter("sig is not null").join(classes, "sig", "left").select("doc_id", F.coalesce("owner_id", "doc_id").alias("owner_id"), F.coalesce("n_links", F.lit(0)).alias("n_links")).union(alone)


def near_duplicates(docs: DataFrame, n: int = 3, threshold: float = 0.5) -> DataFrame:
    """(doc_id, owner_id): every document that is connected by similar pairs with one of smaller doc_id, and the smallest.

    Pairs are those of jaccard_pairs, with its treatment of nulls; they are not listed but joined into groups where they
    are found, so that a group of m documents makes m - 1 rows.
    """
    rows, classes = _classes(docs, n, threshold, count=False)
    # documents of several texts connect the classes of these
    edges = rows.filter("sig is not null").join(classes, "sig").select(F.col("doc_id").alias("a"), F.col("owner_id").alias("b"))
    return components(edges).filter("node <> component").select(F.col("node").alias("doc_id"), F.col("component").alias("owner_id"))


CLASSES_SQL = r"""
WITH RECURSIVE d AS MATERIALIZED (SELECT row_number() OVER () AS r, TRY_CAST(doc_id AS BIGINT) AS doc_id, text FROM documents),
w AS (SELECT r, regexp_extract_all(lower(text), '[0-9a-z\x{80}-\x{10ffff}]+') AS words FROM d WHERE doc_id IS NOT NULL),
g AS (SELECT r, unnest(CASE WHEN len(words) >= 3 THEN list_transform(range(1, len(words) - 1), lambda i: words[i] || ' ' || words[i + 1] || ' ' || words[i + 2]) WHEN len(words) > 0 THEN [array_to_string(words, ' ')] END) AS gram FROM w),
s AS MATERIALIZED (SELECT DISTINCT r, gram FROM g),
n AS (SELECT r, count(*) AS n FROM s GROUP BY r),
p AS (SELECT a.r AS a, b.r AS b, count(*) AS shared FROM s a JOIN s b ON a.gram = b.gram AND a.r <> b.r GROUP BY ALL),
l AS MATERIALIZED (SELECT a, b FROM p JOIN n x ON x.r = a JOIN n y ON y.r = b WHERE shared / (x.n + y.n - shared) >= 0.5 - 1e-12),
c AS (SELECT r AS a, r AS b FROM d UNION SELECT c.a, l.b FROM c JOIN l ON l.a = c.b),
o AS (SELECT c.a AS r, min(d.doc_id) AS owner_id FROM c JOIN d ON d.r = c.b GROUP BY c.a)
SELECT d.doc_id, owner_id, (SELECT count(*) FROM l WHERE l.a = d.r) AS n_links FROM d JOIN o USING (r)
"""
