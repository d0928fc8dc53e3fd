"""Exact duplicates by Patricia tries over full byte strings."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from telar.llm._common import shared_dir


class _Node:
    """A node of a compressed radix trie: children by the first byte of their edge; owner and members where a key ends."""

    __slots__ = ("children", "edge", "members", "owner")

    def __init__(self, edge: bytes) -> None:
        self.edge, self.children, self.owner, self.members = edge, None, None, None


def _common(a: bytes, b: bytes) -> int:
    """Length of the common prefix, by halving: comparisons of slices run at memory speed."""
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    low, step = 0, 1 << max(0, n.bit_length() - 1)
    while step:
        if low + step <= n and a[low : low + step] == b[low : low + step]:
            low += step
        step >>= 1
    return low


class _Members:
    """The identifiers of one key, in 8 bytes each; beyond `limit` of them they go to a file, a few MB at a time."""

    __slots__ = ("count", "held", "limit", "more", "path")

    def __init__(self, limit: int, path: str | None) -> None:
        self.held, self.more, self.count, self.limit, self.path = [], None, 0, limit, path

    def __len__(self) -> int:
        return self.count

    def __iter__(self) -> Iterator[int | None]:
        for _, _, members in self.more.read() if self.more else ():
            yield from members
        yield from self.held

    def extend(self, members: list) -> int:
        """Bytes that this adds to the memory held."""
        before = len(self.held)
        self.held += members
        self.count += len(members)
        if len(self.held) > self.limit and self.path:
            self.more = self.more or _Spill(self.path)
            self.more.add(b"", None, self.held)
            self.more.flush()
            self.held = []
        return 40 * (len(self.held) - before)

    def drop(self) -> None:
        if self.more:
            self.more.drop()


class Patricia:
    """Maps byte strings to their smallest identifier and all their members.

    Where the kept edges exceed `limit` bytes, the largest subtree under the root is written to `folder`, and later
    keys that begin with its first byte follow it there; each is then taken in by a trie of its own, below all that its
    keys have in common, so that every trie has fewer keys than the one it came from.
    """

    def __init__(self, limit: int, folder: str | None = None) -> None:
        self.root, self.limit, self.folder = _Node(b""), limit, folder
        self.bytes = 0
        self.weight: dict[int, int] = {}
        self.spilled: dict[int, _Spill] = {}

    def add(self, key: bytes, owner: int | None, members: list) -> None:
        first = key[0] if key else -1
        if first in self.spilled:
            self.spilled[first].add(key, owner, members)
            return
        node, rest = self.root, key
        while True:
            if not rest:
                break
            child = node.children.get(rest[0]) if node.children else None
            if child is None:
                child = _Node(rest)
                if node.children is None:
                    node.children = {}
                node.children[rest[0]] = child
                self._grow(first, len(rest) + 200)
                node = child
                break
            k = _common(child.edge, rest)
            if k < len(child.edge):
                middle = _Node(child.edge[:k])
                child.edge = child.edge[k:]
                middle.children = {child.edge[0]: child}
                node.children[middle.edge[0]] = middle
                self._grow(first, 300)
                child = middle
            node, rest = child, rest[k:]
        if node.members is None:
            node.members, node.owner = _Members(max(1000, self.limit // 400), f"{self.folder}/{uuid.uuid4().hex}" if self.folder else None), owner
        elif owner is not None and (node.owner is None or owner < node.owner):
            node.owner = owner
        self._grow(first, node.members.extend(members))
        if self.bytes > self.limit and self.folder:
            self._spill()

    def _grow(self, first: int, n: int) -> None:
        self.bytes += n
        self.weight[first] = self.weight.get(first, 0) + n

    def _walk(self, node: _Node, prefix: bytes) -> Iterator[tuple[bytes, object, _Members]]:
        stack = [(node, prefix)]
        while stack:
            node, prefix = stack.pop()
            here = prefix + node.edge
            if node.members is not None:
                yield here, node.owner, node.members
            if node.children:
                stack += [(c, here) for c in node.children.values()]

    def _spill(self) -> None:
        first = max((f for f in self.weight if f >= 0), key=self.weight.get, default=None)
        if first is None or not self.root.children or first not in self.root.children:
            return
        node = self.root.children[first]
        if not node.children:
            return  # one key
        del self.root.children[first]
        self.spilled[first] = spill = _Spill(f"{self.folder}/{uuid.uuid4().hex}")
        for key, owner, members in self._walk(node, b""):
            batch = []
            for m in members:
                batch.append(m)
                if len(batch) == 50_000:
                    spill.add(key, owner, batch)
                    batch = []
            if batch:
                spill.add(key, owner, batch)
            members.drop()
        spill.flush()
        self.bytes -= self.weight.pop(first)

    def items(self) -> Iterator[tuple[object, _Members]]:
        """(smallest identifier, members) of each distinct key."""
        for _, owner, members in self._walk(self.root, b""):
            yield owner, members
            members.drop()
        self.root = _Node(b"")
        for first, spill in self.spilled.items():
            low, high = None, None
            for key, _, _ in spill.read():
                low, high = key if low is None else min(low, key), key if high is None else max(high, key)
            shared = _common(low, high)
            trie = Patricia(self.limit, self.folder)
            for key, owner, members in spill.read():
                trie.add(key[shared:], owner, members)
            yield from trie.items()
            spill.drop()


class _Spill:
    """Records of a spilled subtree, in files of the shared folder."""

    def __init__(self, path: str) -> None:
        self.path, self.rows, self.size, self.parts = path, [], 0, 0

    def _fs(self) -> tuple[pa.fs.FileSystem, str]:
        from pyarrow import fs

        return fs.FileSystem.from_uri(self.path if ":" in self.path else f"file://{self.path}")

    def add(self, key: bytes, owner: int | None, members: list) -> None:
        self.rows.append((key, owner, members))
        self.size += len(key) + 16 * len(members)
        if self.size > 4 << 20:
            self.flush()

    def flush(self) -> None:
        if not self.rows:
            return
        fs, path = self._fs()
        fs.create_dir(path, recursive=True)
        keys, owners, members = zip(*self.rows)
        table = pa.table({"k": pa.array(keys, pa.large_binary()), "o": pa.array(owners, pa.int64()), "m": pa.array(members, pa.list_(pa.int64()))})
        with fs.open_output_stream(f"{path}/{self.parts}") as sink, pa.ipc.new_stream(sink, table.schema) as writer:
            writer.write_table(table)
        self.parts, self.rows, self.size = self.parts + 1, [], 0

    def read(self) -> Iterator[tuple[bytes, object, list]]:
        self.flush()
        fs, path = self._fs()
        for i in range(self.parts):
            with fs.open_input_stream(f"{path}/{i}") as source:
                for batch in pa.ipc.open_stream(source):
                    yield from zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist())

    def drop(self) -> None:
        fs, path = self._fs()
        fs.delete_dir(path)


def exact_owners(docs: DataFrame, limit: int = 64 << 20) -> DataFrame:
    """(doc_id, owner_id, n_copies) of every row: the smallest doc_id with the same text, and how many rows have it.

    Rows are partitioned by length and hash of the text, and each partition inserts full texts into compressed radix
    tries, so equality is that of bytes. Each batch of rows first groups its own, and passes on each distinct
    text once with its members. A trie above `limit` bytes spills by subtree to the shared folder, and so do the members
    of a text with very many copies: memory does not grow with either, though one task lists a text's members.

    A null text equals nothing: the row owns itself, with n_copies 1. Empty texts equal each other. Texts of any length
    are compared whole. Rows with a null doc_id count as copies; where all copies have a null doc_id, the owner is null.
    doc_id is read as an integer of 64 bits, and anything else as null. An empty table gives an empty result. Other columns
    are left out, whatever their names.
    """
    folder = f"{shared_dir(docs.sparkSession).rstrip('/')}/telar-trie-{uuid.uuid4().hex}"

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # one batch at a time: a small trie, and memory that doesn't grow with the partition
        for b in batches:
            seen: dict[tuple, list] = {}
            texts = b.column("text").cast(pa.large_binary())
            ids = b.column("doc_id").to_pylist()
            hashes = b.column("_h").to_pylist()
            keep, members, where = [], [], {}
            for i, h in enumerate(hashes):
                for j in seen.get(h, ()):
                    if texts[j].equals(texts[i]):
                        members[where[j]].append(ids[i])
                        break
                else:
                    seen.setdefault(h, []).append(i)
                    where[i] = len(keep)
                    keep.append(i)
                    members.append([ids[i]])
            take = pa.array(keep, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [pc.take(b.column("_n"), take), pc.take(b.column("_h"), take), pc.take(b.column("text"), take), pa.array(members, pa.list_(pa.int64()))],
                names=["_n", "_h", "text", "ids"])

    def owners(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie = Patricia(limit, folder)
        for b in batches:
            texts = b.column("text").cast(pa.large_binary())
            for i, ids in enumerate(b.column("ids").to_pylist()):
                known = [x for x in ids if x is not None]
                trie.add(texts[i].as_py(), min(known) if known else None, ids)
        out: tuple[list, list, list] = ([], [], [])
        for owner, members in trie.items():
            n = len(members)
            for m in members:
                for column, x in zip(out, (m, owner, n)):
                    column.append(x)
                if len(out[0]) >= 50_000:
                    yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in out], names=["doc_id", "owner_id", "n_copies"])
                    out = ([], [], [])
        yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in out], names=["doc_id", "owner_id", "n_copies"])

    rows = docs.select(F.col("doc_id").try_cast("long").alias("doc_id"), "text")
    there = rows.filter("text is not null").select("doc_id", "text", F.octet_length("text").alias("_n"), F.xxhash64("text").alias("_h"))
    found = there.mapInArrow(local, "_n int, _h long, text string, ids array<long>").repartition("_n", "_h").mapInArrow(owners, "doc_id long, owner_id long, n_copies long")
    none = rows.filter("text is null").select("doc_id", F.col("doc_id").alias("owner_id"), F.lit(1).cast("long").alias("n_copies"))
    return found.unionByName(none)


OWNERS_SQL = """
SELECT doc_id, CASE WHEN text IS NULL THEN doc_id ELSE min(doc_id) OVER (PARTITION BY text) END AS owner_id,
       CASE WHEN text IS NULL THEN 1 ELSE count(*) OVER (PARTITION BY text) END AS n_copies
FROM documents
"""
