"""Exact dedup with Patricia-trie owners.

1. Every input task inserts its texts into a radix trie whose terminals hold the row that stays among its own; all rows
   point at a terminal. A task emits each distinct text once between flushes, so a group of any size reaches the shuffle
   as at most one text a flush: the pre-aggregation of hot groups.
2. Terminals are dealt by (length, content hash) to partitions, where their full byte strings enter a trie again; its
   terminals name the owner of each group and its size. Beyond a byte budget whole subtrees go to a file of the task and are
   built later, one at a time, so memory is bounded.
3. A text that very many flushes hold is merged in salted groups first, which then send it once each.
4. Rows look up their group by the terminal that they point at: one key for each flush, never one for a whole group.

Equality is that of the bytes; hashes only deal rows out.
"""

from __future__ import annotations

import hashlib
import pickle
import tempfile
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lattica.llm.shared import column_or_null, parallelism, small, struct, written
from lattica.llm.text import pieces

#: Bytes of text and rows that an input task holds between flushes.
FLUSH_BYTES, FLUSH_ROWS = 32 << 20, 1 << 18
#: Bytes of edges that a trie holds before subtrees are spilled.
TRIE_BYTES = 128 << 20
#: Terminals of one length and content hash from which they are merged in groups of so many first.
HOT = 1_000


class Node:
    __slots__ = ("children", "edge", "value")

    def __init__(self, edge: bytes, value=None):
        self.edge, self.children, self.value = edge, None, value


def _common(a: bytes, b: bytes, at: int) -> int:
    """Length of the longest common prefix of a and b[at:], by halving."""
    n = min(len(a), len(b) - at)
    if a[:n] == b[at : at + n]:
        return n
    low, high = 0, n  # a[:low] agrees, a[:high] doesn't
    while high - low > 1:
        mid = (low + high) // 2
        if a[low:mid] == b[at + low : at + mid]:
            low = mid
        else:
            high = mid
    return low


class PatriciaTrie:
    """Compressed radix trie over byte strings; each terminal holds one value, merged on insertion."""

    def __init__(self, merge: Callable, budget: int = TRIE_BYTES, depth: int = 0):
        self.root, self.merge, self.budget, self.bytes, self.depth = Node(b""), merge, budget, 0, depth
        self.spilled: dict[int, tempfile._TemporaryFileWrapper] = {}

    def insert(self, key: bytes, value) -> Node | None:
        """The key's terminal; None if its subtree is spilled."""
        if self.spilled and (f := self.spilled.get(key[0] if key else -1)) is not None:
            pickle.dump((key, value), f)
            return None
        node, at = self.root, 0
        while True:
            if at == len(key):
                break
            if node.children is None:
                node.children = {}
            child = node.children.get(key[at])
            if child is None:
                child = node.children[key[at]] = Node(key[at:])
                self.bytes += len(key) - at + 200
                node, at = child, len(key)
                break
            n = _common(child.edge, key, at)
            if n < len(child.edge):
                upper = Node(child.edge[:n])
                upper.children = {child.edge[n]: child}
                child.edge = child.edge[n:]
                node.children[key[at]] = upper
                child = upper
                self.bytes += 200
            node, at = child, at + n
        node.value = value if node.value is None else self.merge(node.value, value)
        if self.bytes > self.budget:
            self._spill()
        return node

    def _walk(self, top: Node, prefix: bytes) -> Iterator[tuple[bytes, object]]:
        stack = [(top, prefix)]
        while stack:
            node, path = stack.pop()
            if node.value is not None:
                yield path, node.value
            for child in (node.children or {}).values():
                stack.append((child, path + child.edge))

    def _spill(self) -> None:
        """All subtrees but the root's own terminal leave; later keys of theirs follow them."""
        for first, child in (self.root.children or {}).items():
            f = tempfile.TemporaryFile()
            for entry in self._walk(child, child.edge):
                pickle.dump(entry, f)
            self.spilled[first] = f
        self.root.children, self.bytes = None, 0

    def items(self) -> Iterator[tuple[bytes, object]]:
        """All keys and values; spilled subtrees are built one after another."""
        yield from self._walk(self.root, b"")
        for f in self.spilled.values():
            # below the first byte that all keys of the file share, so that a further spill splits them further
            f.seek(0)
            head = None
            while True:
                try:
                    key, _ = pickle.load(f)
                except EOFError:
                    break
                head = key if head is None else head[: _common(head, key, 0)]
            sub = PatriciaTrie(self.merge, self.budget, self.depth + 1)
            f.seek(0)
            while True:
                try:
                    key, value = pickle.load(f)
                except EOFError:
                    break
                sub.insert(key[len(head) :], value)
            f.close()
            for rest, value in sub.items():
                yield head + rest, value


def _better(keep: str) -> Callable:
    """Order of (id, uid): the wanted id first, a null id last, then the earlier row."""
    sign = -1 if keep == "max" else 1

    def rank(v):
        return (v[0] is None, 0 if v[0] is None else sign * v[0], v[1])

    return rank


def _local(keep: str, flush_bytes: int, flush_rows: int):
    """Rows with uid, the uid of the row that stays among those of the task's trie, and on that row its text and count."""
    rank = _better(keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        uid = TaskContext.get().partitionId() << 33
        held, terminals, size, trie = [], [], 0, PatriciaTrie(lambda a, b: a, 1 << 62)

        def flush():
            at = 0
            for batch in held:
                mine = terminals[at : at + batch.num_rows]
                at += batch.num_rows
                uids = np.array([m[0] for m in mine], dtype=np.int64)
                owner = np.array([m[1].value[1] for m in mine], dtype=np.int64)
                own = pa.array(uids == owner)
                count = pa.array([m[1].value[2] for m in mine], type=pa.int64())
                text = batch.column("text")
                none = pa.nulls(len(text), text.type)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(uids), pa.array(owner), batch.column("doc_id"), pc.if_else(own, count, pa.nulls(len(count), pa.int64())), pc.if_else(own, text, none), *(batch.column(i) for i in range(2, batch.num_columns))],
                    names=["_uid", "_owner", "doc_id", "_n", "text", *batch.schema.names[2:]],
                )

        for whole in batches:
            for batch in pieces(whole, "text", 4 << 20):
                for key, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").cast(pa.large_binary()).to_pylist(), strict=True):
                    text = text or b""
                    node = trie.insert(text, ())
                    old = node.value
                    node.value = [key, uid, 1] if not old else [*(old if rank(old) < rank((key, uid)) else (key, uid))[:2], old[2] + 1]
                    terminals.append((uid, node))
                    uid += 1
                    size += len(text) + 100
                held.append(batch)
                if size > flush_bytes or len(terminals) > flush_rows:
                    yield from flush()
                    held, terminals, size, trie = [], [], 0, PatriciaTrie(lambda a, b: a, 1 << 62)
        yield from flush()

    return run


_PARTIAL = "_uid long, doc_id long, _n long, text string, owners array<long>"


def _global(keep: str, budget: int, partial: bool = False):
    """For each local terminal: the row that stays of its whole group, and the group's size and digest. partial: the texts
    themselves, each once, with the best row, the number of rows and the local terminals that they had here."""
    rank = _better(keep)

    def merge(a, b):
        best = a if rank(a) < rank(b) else b
        few, many = sorted((a[3], b[3]), key=len)
        many.extend(few)  # in place: a group with an owner in every flush stays linear
        return (*best[:2], a[2] + b[2], many)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie = PatriciaTrie(merge, budget)
        for batch in batches:
            ids, uids, n, owners = (batch.column(c).to_pylist() for c in ("doc_id", "_uid", "_n", "owners"))
            for key, uid, k, text, mine in zip(ids, uids, n, batch.column("text").cast(pa.large_binary()).to_pylist(), owners, strict=True):
                trie.insert(text or b"", (key, uid, k, mine or [uid]))
        if partial:
            for text, (key, uid, n, owners) in trie.items():
                raw = pa.array([text], type=pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array([uid]), pa.array([key], type=pa.int64()), pa.array([n]), pa.Array.from_buffers(pa.string(), 1, raw.buffers()), pa.array([owners], type=pa.list_(pa.int64()))], names=["_uid", "doc_id", "_n", "text", "owners"])
            return
        out: list[list] = [[], [], [], [], []]

        def emit():
            return pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(out, (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string()), strict=True)], names=["_owner", "_keep_uid", "keep_id", "group_size", "text_sha256"])

        for text, (key, uid, n, owners) in trie.items():
            digest = hashlib.sha256(text).hexdigest()
            for o in owners:
                for c, v in zip(out, (o, uid, key, n, digest), strict=True):
                    c.append(v)
            if len(out[0]) >= 10_000:
                yield emit()
                out = [[], [], [], [], []]
        yield emit()

    return run


def _groups(rows: DataFrame, keep: str, budget: int, hot: int) -> DataFrame:
    parts = parallelism(rows.sparkSession)
    owners = rows.filter("_n IS NOT NULL").select("_uid", "doc_id", "_n", "text", F.lit(None).cast("array<long>").alias("owners"))
    text = F.coalesce("text", F.lit(""))
    name = [F.octet_length(text), F.xxhash64(text)]
    often = written(owners.groupBy(*(n.alias(f"_k{i}") for i, n in enumerate(name))).agg(F.count("*").alias("_times")).filter(F.col("_times") > hot))
    if often.limit(1).count():
        side = small(often, F.lit(24))
        keyed = owners.select("*", *(n.alias(f"_k{i}") for i, n in enumerate(name)))
        salted = keyed.join(side, ["_k0", "_k1"]).withColumn("_salt", F.pmod(F.xxhash64("_uid"), F.ceil(F.col("_times") / hot)))
        merged = salted.repartition(parts, "_k0", "_k1", "_salt").select(*owners.columns).mapInArrow(_global(keep, budget, True), _PARTIAL)
        owners = keyed.join(side, ["_k0", "_k1"], "left_anti").select(*owners.columns).unionByName(merged)
    dealt = owners.repartition(parts, *name)
    return dealt.mapInArrow(_global(keep, budget), "_owner long, _keep_uid long, keep_id long, group_size long, text_sha256 string")


def _terminals(docs: DataFrame, id_col: str, text_col: str, keep: str, rest: list[str], flush_bytes: int, flush_rows: int) -> DataFrame:
    key, text = column_or_null(docs, id_col, "long").alias("doc_id"), column_or_null(docs, text_col, "string").alias("text")
    frame = docs.select(key, text, *([F.struct(*(F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(rest))).alias("_row")] if rest else []))
    kinds = "_uid long, _owner long, doc_id long, _n long, text string"
    schema = struct(kinds)
    for f in frame.schema.fields[2:]:
        schema.add(f)
    return written(frame.mapInArrow(_local(keep, flush_bytes, flush_rows), schema))


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "max", flush_bytes: int = FLUSH_BYTES, flush_rows: int = FLUSH_ROWS, trie_bytes: int = TRIE_BYTES, hot: int = HOT) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 for every row.

    A null text counts as empty. A null id loses to any other; of rows with the same id and text, the first in its task stays,
    so exactly one row of each group is kept. An empty table gives no rows. Other columns aren't read.
    """
    if keep not in ("max", "min"):
        raise ValueError("keep is 'max' or 'min'")
    rows = _terminals(docs, id_col, text_col, keep, [], flush_bytes, flush_rows)
    groups = _groups(rows, keep, trie_bytes, hot)
    return rows.select("_uid", "_owner", "doc_id").join(groups, "_owner").select("doc_id", "keep_id", "group_size", (F.col("_uid") == F.col("_keep_uid")).alias("kept"), "text_sha256")


def drop_exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "max", **limits) -> DataFrame:
    """The rows that stay, with all their columns as they were: of rows with equal texts (null counts as empty) the one with the
    wanted id, a null id last, and of rows alike in both one."""
    limits = {"flush_bytes": FLUSH_BYTES, "flush_rows": FLUSH_ROWS, "trie_bytes": TRIE_BYTES, "hot": HOT} | limits
    names = docs.columns
    rest = [c for c in names if c != text_col]
    rows = _terminals(docs, id_col, text_col, keep, rest, limits["flush_bytes"], limits["flush_rows"])
    kept = _groups(rows, keep, limits["trie_bytes"], limits["hot"]).select("_keep_uid").distinct()
    out = rows.filter("_n IS NOT NULL").join(kept, F.col("_uid") == F.col("_keep_uid"), "left_semi")
    return out.select(*((F.col("text") if c == text_col else F.col(f"_row.c{rest.index(c)}")).alias(c) for c in names))
