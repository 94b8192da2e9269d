"""Words covered by repeated word windows: what the two substring dedups share.

Every window of L words has an anchor, the k-gram in it with the smallest hash, so equal windows have equal anchors. Windows
of a text that share an anchor are one segment. Anchors are counted over the whole corpus, packed and dealt by hash; only
segments whose anchor occurs again are then dealt out with their words, by anchor, so a shard holds every window that could
equal another of its own. An engine (FM-index or sparse suffix array) says which windows of a shard's distinct segments occur
again. Very common anchors (a line in a third of the texts) are dealt by longer contexts of both halves of their windows, which
splits them without losing an equal pair.

Both times, tasks work in packs: a pack sends each distinct anchor or segment once, with its count, and keeps where it occurs
to itself, in a row of its own. Answers come back by pack. So an anchor or passage that a third of the texts hold reaches one
task as at most one entry a pack, and nothing is grouped by its occurrences.

Words travel as numbers in a list of 64-bit hashes, one list for each row of a pack; windows are equal if all their hashes are.
Hashes of anchors and contexts only deal segments out, and segments are compared word by word before one stands for another. Texts are known
by 128 bits of a hash of id and text.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lattica.llm.shared import column_or_null, discard, parallelism, small, written
from lattica.llm.text import U, Words, mix, pack, pieces, span_hash

#: Occurrences from which an anchor's segments are dealt by longer contexts.
HOT = 2_000
#: Window starts that are looked at together, within one text; bits of a word's place among them.
_SPAN, _POS = 1 << 25, 26
#: Anchors of a pack; a pack of segments is closed at twice as many words of its texts. Bytes of a part, on average.
PACK, PART = 1 << 20, 12 << 20


def _runs(key: np.ndarray) -> list[tuple[int, int]]:
    if not len(key):
        return []
    cut = [0, *(np.flatnonzero(key[1:] != key[:-1]) + 1).tolist(), len(key)]
    return list(zip(cut[:-1], cut[1:], strict=True))


class Segments:
    """Segments of some texts: first and last window start, anchor word and hash, text, and number within the text."""

    def __init__(self, texts: pa.Array, length: int, k: int, span: int = _SPAN):
        self.words = w = Words(texts)
        found = [self._within(a, min(len(w.doc), a + span + length - 1), length, k) for a in range(0, max(len(w.doc) - length + 1, 1), span)]
        self.first, self.last, self.anchor, self.hash = (np.concatenate(c) for c in zip(*found, strict=True))
        self.doc = w.doc[self.first]
        begins = np.searchsorted(self.doc, np.arange(len(texts)))
        self.number = np.arange(len(self.first)) - begins[self.doc]

    def _within(self, low: int, high: int, length: int, k: int) -> tuple[np.ndarray, ...]:
        """Segments of the windows within these words; a segment that goes on behind them is two."""
        doc, n, width = self.words.doc[low:high], high - low, length - k + 1
        grams = np.full(n + 1, np.iinfo(np.uint64).max, dtype=np.uint64)
        at = np.arange(max(0, n - k + 1))
        at = at[doc[at] == doc[at + k - 1]]
        grams[at] = span_hash(self.words.hash[low:high], at, at + k)
        least = np.arange(n, dtype=np.uint64) | (grams[:n] >> U(_POS) << U(_POS))
        have = 1
        while have < width:  # minima over doubling widths; ties go to the left
            step = min(have, width - have)
            least = np.minimum(least[: len(least) - step], least[step:])
            have += step
        starts = np.arange(max(0, n - length + 1))
        starts = starts[doc[starts] == doc[starts + length - 1]]
        anchor = (least[starts] & U((1 << _POS) - 1)).astype(np.int64)
        doc = doc[starts]
        cut = np.flatnonzero(np.concatenate([[True], (anchor[1:] != anchor[:-1]) | (doc[1:] != doc[:-1])])) if len(starts) else starts
        last = starts[np.append(cut[1:], len(starts)) - 1] if len(cut) else starts
        return starts[cut] + low, last + low, anchor[cut] + low, grams[anchor[cut]]


def alike(key: np.ndarray, words: np.ndarray, first: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(one row of each kind, the kind of every row): rows with equal keys and equal words, which are compared one by one."""
    _, at, which = np.unique(key, return_index=True, return_inverse=True)
    rep = at[which]
    other = np.flatnonzero(rep != np.arange(len(key)))
    odd = n[other] != n[rep[other]]
    same = np.flatnonzero(~odd)
    for lo in range(0, len(same), 1 << 14):  # a bounded number of words at a time
        rows = same[lo : lo + (1 << 14)]
        m, a, b = n[other[rows]], first[other[rows]], first[rep[other[rows]]]
        step = np.arange(int(m.sum())) - np.repeat(np.cumsum(m) - m, m)
        differ = words[np.repeat(a, m) + step] != words[np.repeat(b, m) + step]
        if differ.any():
            odd[rows[np.repeat(np.arange(len(m)), m)[differ]]] = True
    if odd.any():  # a key of two different rows
        kinds = {}
        for i in np.flatnonzero(np.isin(which, which[other[odd]])).tolist():
            content = (int(key[i]), words[first[i] : first[i] + n[i]].tobytes())
            which[i] = kinds.setdefault(content, len(at) + len(kinds))
        _, at, which = np.unique(which, return_index=True, return_inverse=True)
    return at, which


#: Both tables of packs. kind 0: where the entries of a pack occur; kind 1: what it sends to part p.
_ANCHORS = "kind int, pack long, p int, key binary, doc binary, number binary, entry binary, h binary, n binary"
_ANCHOR_NAMES = [c.split()[0] for c in _ANCHORS.split(", ")]
#: Two hashes of id and text, by which a text is known.
_KEY = ["k1", "k2"]


def _table(names: list[str], rows: list[dict], wide: bool = False):
    """Rows of packed arrays; fields that a row lacks are null."""
    kinds = {"kind": pa.int32(), "p": pa.int32(), "pack": pa.int64()}
    cols = [pa.array([r.get(c) for r in rows], type=kinds.get(c, pa.binary())) for c in names]
    return (pa.Table if wide else pa.RecordBatch).from_arrays(cols, names=names)


def _column(table: pa.Table, name: str, kind) -> np.ndarray:
    return np.concatenate([np.frombuffer(x, dtype=kind) for x in table.column(name).to_pylist()])


def _keys(part: pa.RecordBatch) -> np.ndarray:
    return np.stack([part.column(c).to_numpy(zero_copy_only=False) for c in _KEY], 1)


def _by_key(rows: list[tuple], blob: str) -> pa.Table:
    """(k1, k2, packed array) of some texts."""
    cols = list(zip(*rows, strict=True)) if rows else [[], [], []]
    return pa.Table.from_arrays([pa.array(list(c), type=t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.binary()), strict=True)], names=[*_KEY, blob])


def _find(length: int, k: int, p_n: int, per_pack: int):
    """Packs of anchors: their texts and numbers stay, distinct anchors and their counts go to parts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, at = [], 0, TaskContext.get().partitionId() << 32

        def flush():
            h, number, key = (np.concatenate([x[i] for x in held]) for i in range(3))
            base = np.cumsum([0, *(len(x[2]) for x in held[:-1])])
            doc = np.concatenate([x[3] + b for x, b in zip(held, base, strict=True)])
            held.clear()
            distinct, inverse, n = np.unique(h, return_inverse=True, return_counts=True)
            part = (mix(distinct) % U(p_n)).astype(np.int64)
            order = np.argsort(part, kind="stable")
            rows = [{"kind": 0, "pack": at, "key": pack(key), "doc": pack(doc.astype(np.uint32)), "number": pack(number.astype(np.uint32)), "entry": pack(inverse.astype(np.uint32))}]
            part = part[order]
            for a, b in _runs(part):
                o = order[a:b]
                rows.append({"kind": 1, "pack": at, "p": int(part[a]), "h": pack(distinct[o]), "n": pack(n[o].astype(np.uint32)), "entry": pack(o.astype(np.uint32))})
            return _table(_ANCHOR_NAMES, rows)

        for batch in batches:
            for part in pieces(batch, "text"):
                s = Segments(part.column("text"), length, k)
                if len(s.first):
                    have, doc = np.unique(s.doc, return_inverse=True)
                    held.append((s.hash, s.number, _keys(part)[have], doc))
                    size += len(s.first)
                if size >= per_pack:
                    yield flush()
                    size, at = 0, at + 1
        if held:
            yield flush()

    return run


def _packs_of(table: pa.Table, name: str) -> np.ndarray:
    """The pack of each entry of the rows' 4-byte columns."""
    return np.repeat(table.column("pack").to_numpy(), [len(x) // 4 for x in table.column(name).to_pylist()])


def _again(hot: int):
    """Anchors of one part that occur again, as entries of their packs, with the top bit where the anchor is very common."""

    def run(table: pa.Table) -> pa.Table:
        h, n, entry, packs = _column(table, "h", np.uint64), _column(table, "n", np.uint32).astype(np.int64), _column(table, "entry", np.uint32), _packs_of(table, "entry")
        order = np.argsort(h)
        first = np.flatnonzero(np.concatenate([[True], h[order][1:] != h[order][:-1]]))
        total = np.empty(len(h), dtype=np.int64)
        total[order] = np.repeat(np.add.reduceat(n[order], first), np.diff(np.append(first, len(h))))
        twice = np.flatnonzero(total > 1)
        twice = twice[np.argsort(packs[twice], kind="stable")]
        packs, entry = packs[twice], entry[twice] | np.where(total[twice] > hot, np.uint32(1 << 31), np.uint32(0))
        return _table(_ANCHOR_NAMES, [{"kind": 2, "pack": int(packs[a]), "entry": pack(entry[a:b])} for a, b in _runs(packs)], True)

    return run


def _by_text(table: pa.Table) -> pa.Table:
    """A pack's answers, by text: numbers of its segments, and the top bit where the anchor is very common."""
    kind = table.column("kind").to_numpy()
    here, told = table.filter(pa.array(kind == 0)), table.filter(pa.array(kind == 2))
    rows = []
    if len(told):
        key, doc, number, entry = _column(here, "key", np.int64).reshape(-1, 2), *(_column(here, c, np.uint32) for c in ("doc", "number", "entry"))
        answer, said = np.zeros(int(entry.max()) + 1, dtype=np.uint8), _column(told, "entry", np.uint32)
        answer[said & np.uint32((1 << 31) - 1)] = 1 + (said >> np.uint32(31))
        got = answer[entry]
        asked = np.flatnonzero(got)  # in order of texts
        doc, number = doc[asked], number[asked] | np.where(got[asked] > 1, np.uint32(1 << 31), np.uint32(0))
        rows = [(*key[doc[a]].tolist(), pack(number[a:b])) for a, b in _runs(doc)]
    return _by_key(rows, "numbers")


_SEGMENTS = "kind int, pack long, p int, key binary, doc binary, start binary, entry binary, anchors binary, lengths binary, before binary, codes binary, words binary, many binary, runs binary"
_NAMES = [c.split()[0] for c in _SEGMENTS.split(", ")]


def _deal(length: int, k: int, p_n: int, per_pack: int):
    """Packs of the segments asked for: where they occur stays, distinct word sequences go to parts by anchor."""
    half = (length - k + 1) // 2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, at_pack = [], 0, TaskContext.get().partitionId() << 32

        def flush():
            route, first, lens, doc, at, before = (np.concatenate([x[i] for x in held]) for i in range(6))
            base = np.cumsum([0, *(len(x[6]) for x in held[:-1])])
            docs = np.cumsum([0, *(len(x[7]) for x in held[:-1])])
            many = [len(x[0]) for x in held]
            codes, key = np.concatenate([x[6] for x in held]), np.concatenate([x[7] for x in held])
            first, doc = first + np.repeat(base, many), doc + np.repeat(docs, many)
            held.clear()
            content = span_hash(codes, first, first + lens) ^ mix(route + before.astype(np.uint64))
            some, entry = alike(content, codes, first, lens)
            # entries in order of their parts
            part = (mix(route[some]) % U(p_n)).astype(np.int64)
            order = np.argsort(part, kind="stable")
            place = np.empty(len(order), dtype=np.int64)
            place[order] = np.arange(len(order))
            entry, distinct, part = place[entry], some[order], part[order]
            count = np.bincount(entry)
            rows = [{"kind": 0, "pack": at_pack, "key": pack(key), "doc": pack(doc.astype(np.uint32)), "start": pack(at.astype(np.uint32)), "entry": pack(entry.astype(np.uint32))}]
            for a, b in _runs(part):
                d = distinct[a:b]
                n = lens[d]
                spots = np.repeat(first[d] - (np.cumsum(n) - n), n) + np.arange(n.sum())
                own, words = np.unique(codes[spots], return_inverse=True)
                rows.append({
                    "kind": 1, "pack": at_pack, "p": int(part[a]), "entry": pack(np.arange(a, b, dtype=np.uint32)), "anchors": pack(route[d]), "lengths": pack(n.astype(np.uint8)),
                    "before": pack(before[d].astype(np.uint8)), "codes": pack(own), "words": pack(words.astype(_narrow(len(own)))), "many": pack((count[a:b] > 1).astype(np.uint8)),
                })
            return _table(_NAMES, rows)

        for batch in batches:
            for part in pieces(batch, "text"):
                s = Segments(part.column("text"), length, k)
                w = s.words
                asked = part.column("numbers").to_pylist()
                begins = np.searchsorted(s.doc, np.arange(part.num_rows))
                pick, common = [], []
                for i, x in enumerate(asked):
                    if x:
                        n = np.frombuffer(x, dtype=np.uint32)
                        pick.append(begins[i] + (n & np.uint32((1 << 31) - 1)).astype(np.int64))
                        common.append(n >> np.uint32(31))
                if not pick:
                    continue
                pick, common = np.concatenate(pick), np.concatenate(common).astype(bool)
                codes = w.hash
                first, last, anchor, h = s.first[pick], s.last[pick], s.anchor[pick], s.hash[pick]
                # windows that begin near a common anchor hold `half` words after it; the others `half` words before it
                near, far = np.maximum(first, anchor - half), np.minimum(last, anchor - half - 1)
                calm = ~common
                groups = [(calm, first, last, h)]
                right = common & (near <= last)
                left = common & (first <= far)
                if right.any():
                    e = np.minimum(anchor + k + (length - k - half), len(codes))
                    groups.append((right, near, last, mix(span_hash(w.hash, anchor, e) + U(1))))
                if left.any():
                    b = np.maximum(anchor - half - 1, 0)
                    groups.append((left, first, far, mix(span_hash(w.hash, b, anchor + k) + U(2))))
                told = [(route[mask], lo[mask], hi[mask] - lo[mask] + length, s.doc[pick][mask], lo[mask] - w.first[s.doc[pick][mask]], anchor[mask] - lo[mask]) for mask, lo, hi, route in groups if mask.any()]
                held.append((*(np.concatenate(c) for c in zip(*told, strict=True)), codes, _keys(part)))
                size += len(codes)
                if size >= 2 * per_pack:
                    yield flush()
                    size, at_pack = 0, at_pack + 1
        if held:
            yield flush()

    return run


def _narrow(n: int):
    """The type that numbers below n are packed in."""
    return np.uint16 if n <= 1 << 16 else np.uint32


def _words_of(table: pa.Table) -> np.ndarray:
    """The words of all rows as numbers in one list."""
    lists = [np.frombuffer(x, dtype=np.uint64) for x in table.column("codes").to_pylist()]
    _, number = np.unique(np.concatenate(lists), return_inverse=True)
    number = number.astype(np.uint32)
    at = np.cumsum([0, *(len(x) for x in lists)])
    return np.concatenate([number[at[i] + np.frombuffer(x, dtype=_narrow(len(lists[i])))] for i, x in enumerate(table.column("words").to_pylist())])


def _shard(length: int, engine: Callable, k: int):
    """Windows of one part that occur again, as (entry, first window, word after the last) of the packs that hold them."""

    def run(table: pa.Table) -> pa.Table:
        route, n, before = _column(table, "anchors", np.uint64), _column(table, "lengths", np.uint8).astype(np.int64), _column(table, "before", np.uint8).astype(np.int64)
        words, entry, packs = _words_of(table), _column(table, "entry", np.uint32), _packs_of(table, "entry")
        # segments of several packs can be the same
        first = np.concatenate([[0], np.cumsum(n)[:-1]])
        content = span_hash(mix(words + U(1)), first, first + n) ^ mix(route + before.astype(np.uint64))
        at, which = alike(content, words, first, n)
        del content
        many = np.bincount(which, _column(table, "many", np.uint8) + 1, len(at)) > 1
        route, n, before, first = route[at], n[at], before[at], first[at]
        windows = n - length + 1
        offsets = np.concatenate([[0], np.cumsum(windows)])
        again = np.repeat(many, windows)
        # where an anchor has one distinct segment, there is nothing else to meet
        order = np.argsort(route, kind="stable")
        group = np.cumsum(np.concatenate([[True], route[order][1:] != route[order][:-1]])) - 1
        size = np.bincount(group)[group]
        met = order[size > 1]
        if len(met):
            gid = group[size > 1]
            # a segment can't hold a window twice: its windows share the place of their anchor
            engine(words, first[met], n[met], before[met], gid, length, k, again, offsets[met])
        # runs of repeated windows of each segment, for each pack that has it
        edge = again.copy()
        edge[1:] &= ~again[:-1]
        edge[offsets[:-1]] = again[offsets[:-1]]
        run_at = np.flatnonzero(edge)
        stop = np.zeros(len(again) + 1, dtype=bool)
        stop[offsets[1:]] = True
        stop[:-1] |= ~again
        ends = np.flatnonzero(stop)
        run_end = ends[np.searchsorted(ends, run_at, side="right")] if len(run_at) else run_at
        of = np.searchsorted(offsets, run_at, side="right") - 1
        lo, hi = run_at - offsets[of], run_end - offsets[of] + length - 1
        held = np.argsort(packs, kind="stable")
        pos, reps = _each(of, len(at), which[held])
        told = np.stack([np.repeat(entry[held], reps), lo[pos], hi[pos]], 1).astype(np.uint32)
        packs = np.repeat(packs[held], reps)
        return _table(_NAMES, [{"kind": 2, "pack": int(packs[a]), "runs": pack(told[a:b])} for a, b in _runs(packs)], True)

    return run


def _each(of: np.ndarray, n: int, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions of the entries that belong to each of `which` in turn, `of` being sorted, and how many each has."""
    count = np.bincount(of, minlength=n)
    begin, reps = np.concatenate([[0], np.cumsum(count)])[which], count[which]
    return np.repeat(begin, reps) + np.arange(reps.sum()) - np.repeat(np.cumsum(reps) - reps, reps), reps


def _merge_spans(table: pa.Table) -> pa.Table:
    """A pack's answers, by text: spans of words that go."""
    kind = table.column("kind").to_numpy()
    here, told = table.filter(pa.array(kind == 0)), table.filter(pa.array(kind == 2))
    rows = []
    if len(told):
        key, doc, start, entry = _column(here, "key", np.int64).reshape(-1, 2), *(_column(here, c, np.uint32).astype(np.int64) for c in ("doc", "start", "entry"))
        runs = np.concatenate([np.frombuffer(x, dtype=np.uint32).reshape(-1, 3) for x in told.column("runs").to_pylist()]).astype(np.int64)
        runs = runs[np.argsort(runs[:, 0], kind="stable")]
        pos, reps = _each(runs[:, 0], int(entry.max()) + 1, entry)
        doc, spans = np.repeat(doc, reps), runs[pos, 1:] + np.repeat(start, reps)[:, None]
        order = np.lexsort((spans[:, 0], doc))
        doc, spans = doc[order], spans[order]
        for a, b in _runs(doc):
            lo, hi = spans[a:b, 0], np.maximum.accumulate(spans[a:b, 1])
            cut = np.concatenate([[True], lo[1:] > hi[:-1]])
            ends = np.append(np.flatnonzero(cut)[1:], b - a) - 1
            rows.append((*key[doc[a]].tolist(), pack(np.stack([lo[cut], hi[ends]], 1).astype(np.uint32))))
    return _by_key(rows, "spans")


def _kept(with_text: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, "text"):
                w = Words(part.column("text"), hashes=False)
                spans = part.column("spans").to_pylist()
                raw, n, gone, digests, texts, where = w.data.tobytes(), [], [], [], [], []
                for i in range(part.num_rows):
                    mine = raw[w.offsets[i] : w.offsets[i + 1]].split()
                    n.append(len(mine))
                    cut = np.frombuffer(spans[i], dtype=np.uint32).reshape(-1, 2).tolist() if spans[i] else []
                    kept, at = [], 0
                    for lo, hi in cut:
                        kept += mine[at:lo]
                        at = hi
                    kept += mine[at:]
                    gone.append(len(mine) - len(kept))
                    joined = b" ".join(kept)
                    digests.append(hashlib.sha256(joined).hexdigest())
                    if with_text:
                        texts.append(joined.decode("utf-8", "replace"))
                        where.append([{"first": lo, "end": hi} for lo, hi in cut])
                cols = [part.column("doc_id"), pa.array(n, type=pa.int64()), pa.array(gone, type=pa.int64()), pa.array(digests, type=pa.string())]
                names = ["doc_id", "n_words", "n_removed", "kept_sha256"]
                if with_text:
                    cols += [pa.array(texts, type=pa.string()), pa.array(where, type=pa.list_(pa.struct([("first", pa.int32()), ("end", pa.int32())])))]
                    names += ["kept_text", "removed"]
                yield pa.RecordBatch.from_arrays(cols, names=names)

    return run


def remove_repeats(docs: DataFrame, engine: Callable, length: int, k: int, id_col: str = "doc_id", text_col: str = "text", with_text: bool = False, hot: int = HOT, per_pack: int = PACK) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 for every row; with_text adds the kept text and the removed word spans.

    A word goes if it lies in a window of `length` words whose sequence also starts elsewhere in the corpus, the same text
    included. A null text has no words; texts below `length` words lose none. Rows alike in id and text count as two
    places. An empty table gives no rows. Other columns aren't read.
    """
    if not 0 < k < length <= 128:
        raise ValueError("0 < k < length <= 128")
    least = parallelism(docs.sparkSession)
    text = docs.select(column_or_null(docs, id_col, "long").alias("doc_id"), column_or_null(docs, text_col, "string").alias("text"))
    text = text.withColumn("k1", F.xxhash64("doc_id", "text")).withColumn("k2", F.xxhash64("text", F.lit(1), "doc_id"))
    parted = lambda n: max(least, -(-int(n or 0) // PART))
    # an anchor is 16 bytes, and there is one for half a window of words, which are at least 2 bytes each
    p_n = parted(16 * (text.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // (length - k + 2))
    # a text is within one pack; rows alike in id and text have one key, and the same answers
    found = written(text.select(*_KEY, "text").mapInArrow(_find(length, k, p_n, per_pack), _ANCHORS))
    again = found.filter("kind = 1").groupBy("p").applyInArrow(_again(hot), _ANCHORS)
    asked = found.filter("kind = 0").unionByName(again).groupBy("pack").applyInArrow(_by_text, "k1 long, k2 long, numbers binary")
    asked = written(asked.groupBy(*_KEY).agg(F.first("numbers").alias("numbers")))
    discard(found)
    # a segment has some 1.5 windows of words, of 2 to 4 bytes, and 20 bytes besides
    p_n = parted((asked.agg(F.sum(F.octet_length("numbers"))).first()[0] or 0) // 4 * (5 * length + 20))
    dealt = written(text.select(*_KEY, "text").join(small(asked, F.octet_length("numbers")), _KEY).mapInArrow(_deal(length, k, p_n, per_pack), _SEGMENTS))
    discard(asked)
    shards = dealt.filter("kind = 1").groupBy("p").applyInArrow(_shard(length, engine, k), _SEGMENTS)
    spans = dealt.filter("kind = 0").unionByName(shards).groupBy("pack").applyInArrow(_merge_spans, "k1 long, k2 long, spans binary")
    spans = written(spans.groupBy(*_KEY).agg(F.first("spans").alias("spans")))
    discard(dealt)
    kept = "doc_id long, n_words long, n_removed long, kept_sha256 string" + (", kept_text string, removed array<struct<first:int,end:int>>" if with_text else "")
    return text.join(small(spans, F.octet_length("spans")), _KEY, "left").select("doc_id", "text", "spans").mapInArrow(_kept(with_text), kept)
