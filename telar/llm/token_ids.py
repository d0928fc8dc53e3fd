"""Token ids in fixed-width bit packing."""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from telar.llm._words import chunks, hash_spans

#: White space outside ASCII, and separators that some engines count as white space; buffers that hold any are encoded text by text.
_WIDE_SPACE = re.compile(rb"[\x1c-\x1f]|\xc2[\x85\xa0]|\xe1\x9a\x80|\xe2\x80[\x80-\x8a\xa8\xa9\xaf]|\xe2\x81\x9f|\xe3\x80\x80")
_MAYBE_WIDE, _SPACE = np.zeros(256, bool), np.zeros(256, bool)
_MAYBE_WIDE[[*range(0x1C, 0x20), 0xC2, 0xE1, 0xE2, 0xE3]] = True
_SPACE[[*range(9, 14), 32]] = True


def width(vocabulary: int) -> int:
    """Bits that the largest of `vocabulary` ids needs."""
    return max(1, (vocabulary - 1).bit_length())


def pack(ids: np.ndarray, bits: int, block: int) -> bytes:
    """ids, each in `bits` bits, in blocks of `block` ids; a block begins at a byte, its last may be short.

    Bits are little-endian: id i of a block stands at bits i * bits to (i + 1) * bits - 1, counted from the lowest bit of
    its first byte. 64 ids fill `bits` words of 64 bits, so whole lanes are shifted at once.
    """
    if not len(ids):
        return b""
    if block % 64:
        raise ValueError("block must be a multiple of 64")
    if bits == 16:
        return ids.astype("<u2").tobytes()
    n = len(ids)
    lanes = np.zeros((-(-n // 64), 64), np.uint64)
    lanes.reshape(-1)[:n] = ids
    words = np.zeros((len(lanes), bits), np.uint64)
    for i in range(64):
        at, shift = divmod(i * bits, 64)
        words[:, at] |= lanes[:, i] << np.uint64(shift)
        if shift + bits > 64:
            words[:, at + 1] |= lanes[:, i] >> np.uint64(64 - shift)
    return words.astype("<u8").tobytes()[: (n * bits + 7) // 8]


def unpack(payload: bytes, bits: int, n: int) -> np.ndarray:
    """The first n ids of packed bytes, which may start at any block's offset."""
    if bits == 16:
        return np.frombuffer(payload, "<u2", n).astype(np.uint32)
    m = -(-n // 64)
    data = np.zeros(m * bits * 8, np.uint8)
    got = np.frombuffer(payload, np.uint8)[: len(data)]
    data[: len(got)] = got
    words = data.view("<u8").reshape(m, bits)
    lanes = np.empty((m, 64), np.uint32)
    mask = np.uint64((1 << bits) - 1)
    for i in range(64):
        at, shift = divmod(i * bits, 64)
        x = words[:, at] >> np.uint64(shift)
        if shift + bits > 64:
            x = x | words[:, at + 1] << np.uint64(64 - shift)
        lanes[:, i] = x & mask
    return lanes.reshape(-1)[:n]


def token_at(payload: bytes, offsets: list[int], bits: int, block: int, i: int) -> int:
    """Id number i, read from its block alone."""
    b, k = divmod(i, block)
    end = offsets[b + 1] if b + 1 < len(offsets) else len(payload)
    return int(unpack(payload[offsets[b] : end], bits, k + 1)[k])


class Chunker:
    """Token ids by a cache of chunks.

    A chunk is a run of ASCII white space with the characters up to the next. The tokenizer's pattern never lets a
    piece run from other characters into white space, and looks no further back, so chunks are encoded independently;
    most are met again and again. Chunks are found by their hashes in two tables of `1 << bits` slots, all of a buffer
    at once, and what is found is compared with the text byte by byte.
    """

    def __init__(self, path: str, pattern: str, bits: int = 20) -> None:
        import base64

        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.tokenizer = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.bits = bits
        self.clear()

    def clear(self) -> None:
        n = 1 << self.bits
        self.slots = np.zeros((2, n), np.uint64)
        self.where = np.zeros((2, n), np.int32)
        self.used, self.ids_used, self.bytes_used = 0, 0, 0
        self.id_at, self.byte_at = np.zeros(n + 1, np.int64), np.zeros(n + 1, np.int64)
        self.ids, self.bytes = np.zeros(4 * n, np.uint32), np.zeros(12 * n, np.uint8)

    def _learn(self, hashes: np.ndarray, chunks: list[bytes], evict: int) -> None:
        """Take in new chunks; where both slots of one are taken, it evicts from table `evict`."""
        ids = [self.tokenizer.encode_ordinary(c.decode()) for c in chunks]
        k = np.arange(self.used, self.used + len(chunks))
        self.id_at[k + 1] = self.ids_used + np.cumsum([*map(len, ids)])
        self.byte_at[k + 1] = self.bytes_used + np.cumsum([*map(len, chunks)])
        self.used += len(chunks)
        i, self.ids_used = self.ids_used, int(self.id_at[self.used])
        j, self.bytes_used = self.bytes_used, int(self.byte_at[self.used])
        if self.ids_used > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros(self.ids_used, np.uint32)])
        if self.bytes_used > len(self.bytes):
            self.bytes = np.concatenate([self.bytes, np.zeros(self.bytes_used, np.uint8)])
        self.ids[i : self.ids_used] = np.fromiter(chain.from_iterable(ids), np.uint32)
        self.bytes[j : self.bytes_used] = np.frombuffer(b"".join(chunks), np.uint8)
        slots = self._slots(hashes)
        free = [self.slots[t][slots[t]] == 0 for t in (0, 1)]
        table = np.where(free[0], 0, np.where(free[1], 1, evict))
        slot = np.where(table == 0, slots[0], slots[1])
        self.slots[table, slot] = hashes
        self.where[table, slot] = k
        # where two took one slot, hash and number must be of the same
        lost = self.slots[table, slot] != hashes
        if lost.any():
            kept = ~lost
            self.where[table[kept], slot[kept]] = k[kept]

    def _slots(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        mask = np.uint64((1 << self.bits) - 1)
        return (hashes & mask).astype(np.int64), (hashes >> np.uint64(40) & mask).astype(np.int64)

    def _find(self, hashes: np.ndarray) -> np.ndarray:
        """Number of each chunk in the cache, -1 where it is not there."""
        a, b = self._slots(hashes)
        at = np.where(self.slots[0][a] == hashes, self.where[0][a], -1)
        miss = np.flatnonzero(at < 0)
        b = b[miss]
        at[miss] = np.where(self.slots[1][b] == hashes[miss], self.where[1][b], -1)
        return at

    def buffer(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts of a buffer, and where those of each text begin."""
        n = len(data)
        if not n:
            return np.zeros(0, np.uint32), np.zeros(len(offsets), np.int64)
        if _MAYBE_WIDE[data].any() and _WIDE_SPACE.search(data.tobytes()):
            return self._plain(data, offsets)
        space = _SPACE[data]
        start = np.empty(n, bool)
        start[0] = True
        np.logical_and(space[1:], ~space[:-1], out=start[1:])
        start[offsets[:-1][offsets[:-1] < n]] = True
        s = np.flatnonzero(start)
        e = np.append(s[1:], n)
        hashes = hash_spans(data, s, e) | np.uint64(1)
        if 4 * len(s) > 1 << self.bits:
            return self._plain(data, offsets)
        if self.used + 4 * len(s) > 1 << self.bits:
            self.clear()
        at = self._find(hashes)
        for attempt in range(4):
            miss = np.flatnonzero(at < 0)
            if not len(miss):
                break
            _, k = np.unique(hashes[miss], return_index=True)
            k = miss[k]
            self._learn(hashes[k], [data[i:j].tobytes() for i, j in zip(s[k].tolist(), e[k].tolist())], (attempt + 1) % 2)
            at = self._find(hashes)
        else:
            return self._plain(data, offsets)
        if not (((e - s) == self.byte_at[at + 1] - self.byte_at[at]).all() and (self.bytes[_ragged(self.byte_at, at)] == data).all()):
            return self._plain(data, offsets)
        counts = self.id_at[at + 1] - self.id_at[at]
        before = np.zeros(len(s) + 1, np.int64)
        np.cumsum(counts, out=before[1:])
        return self.ids[_ragged(self.id_at, at)], before[np.searchsorted(s, offsets)]

    def _plain(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        ids = [self.tokenizer.encode_ordinary(data[a:b].tobytes().decode()) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist())]
        return np.fromiter(chain.from_iterable(ids), np.uint32), np.cumsum([0, *map(len, ids)])

    def __call__(self, text: str) -> np.ndarray:
        data = np.frombuffer(text.encode(), np.uint8)
        return self.buffer(data, np.array([0, len(data)]))[0]


def _ragged(starts: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Concatenated ranges starts[i] to starts[i + 1] for i of at."""
    first = starts[at]
    counts = starts[at + 1] - first
    ends = np.cumsum(counts)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(first - (ends - counts), counts)


#: One cache for each worker process, kept from task to task.
_chunkers: dict[tuple[str, str], Chunker] = {}


def tokenizer_file(name: str = "byte_bpe_50k.tiktoken", folder: str = "/opt/tokenizers") -> str:
    return f"{folder}/{name}"


#: The splitting pattern of the byte-level vocabularies.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def packed_tokens(docs: DataFrame, path: str, vocabulary: int = 50_257, block: int = 1024, pattern: str = PATTERN) -> DataFrame:
    """(doc_id, n_tokens, bits, block_tokens, block_offsets, payload) of every row.

    The payload holds the text's token ids in the fewest bits that `vocabulary` ids need, in blocks of block_tokens
    ids, of which block_offsets gives the first bytes: `unpack` reads from any block on, `token_at` one id. There is no
    shuffle; a text's ids stay in one row.

    A null text has n_tokens and payload null and no offsets; an empty text has 0 tokens and an empty payload. Repeated
    rows are packed one by one. An empty table gives an empty result. Other columns are left out.
    """
    bits = width(vocabulary)
    size = block * bits // 8

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = (path, pattern)
        if key not in _chunkers:
            _chunkers[key] = Chunker(path, pattern)
        chunker = _chunkers[key]
        for batch in batches:
            texts = batch.column("text")
            valid = texts.is_valid().to_numpy(zero_copy_only=False)
            for a, b, data, where in chunks(texts):
                ids, first = chunker.buffer(data, where)
                counts, offsets, payloads = [], [], []
                for i, j, there in zip(first[:-1].tolist(), first[1:].tolist(), valid[a:b].tolist()):
                    counts.append(j - i if there else None)
                    offsets.append(list(range(0, -(-(j - i) // block) * size, size)))
                    payloads.append(pack(ids[i:j], bits, block) if there else None)
                k = b - a
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(a, k), pa.array(counts, pa.int64()), pa.array([bits] * k, pa.int32()), pa.array([block] * k, pa.int32()),
                     pa.array(offsets, pa.list_(pa.int64())), pa.array(payloads, pa.binary())],
                    names=["doc_id", "n_tokens", "bits", "block_tokens", "block_offsets", "payload"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_tokens long, bits int, block_tokens int, block_offsets array<long>, payload binary")


def token_ids(packed: DataFrame) -> DataFrame:
    """(doc_id, ids) read back from packed_tokens."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = [None if n is None else unpack(p, w, n).tolist() for n, w, p in zip(b.column("n_tokens").to_pylist(), b.column("bits").to_pylist(), b.column("payload").to_pylist())]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(ids, pa.list_(pa.int32()))], names=["doc_id", "ids"])

    kind = packed.schema["doc_id"].dataType.simpleString()
    return packed.select("doc_id", "n_tokens", "bits", "payload").mapInArrow(run, f"doc_id {kind}, ids array<int>")
