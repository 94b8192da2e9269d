"""LM scoring by masked pseudo-likelihood.

A word is a class and a word within it. The class is predicted from the words on both sides by a window network (embeddings
by place, a hidden layer, softmax over classes), trained in numpy; the word within its class has the probability of its
count in the corpus. Summed log-probabilities of all words given their contexts score a document.

1. Frequent words (probes) are found by hashed counts, and how often one stands near another, over all documents. Probes that
   keep the same company form a few contexts (languages, subjects).
2. Every word votes for the context that it stands in. Tasks work in packs: a pack sends each distinct word with its count and
   votes once, dealt by word; there all its votes meet, and its exact count in the corpus, its context and so its class go back
   to the packs. The tables grow with the vocabulary; nothing of them reaches the driver.
   Classes: the most frequent words have their own; others are classed by context and by how often they occur.
3. Texts are written as strings of classes, one byte a word. Training and scoring work on these. Every task takes gradient steps
   on masked places of its own texts, and the tasks' weights are averaged in a tree, in rounds. A place is dealt to a round by its text and
   its position, and `mask` rounds mask every place of every text once.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lattica.llm.shared import column_or_null, discard, parallelism, written
from lattica.llm.text import U, Words, mix, pack, pieces, span_hash

#: Hashed cells in which probes are sought; ranges these are added up in; probes; probes looked at on each side of a word.
CELLS, RANGES, PROBES, REACH = 1 << 17, 16, 256, 8
#: Words with a class of their own; contexts; counts from which a word is in the next of the classes of its context.
OWN, CONTEXTS, BANDS = 32, 8, (2, 4, 32)
CLASSES = OWN + CONTEXTS * (len(BANDS) + 1)
#: Hidden units; words seen on each side.
HIDDEN, SIDE = 24, 2
#: One word of so many is masked in a round of training; passes over the corpus, as many, so that each place is masked in one of
#: them; places of a gradient step, at first and at most.
MASK, ROUNDS, FIRST_STEP, STEP = 2, 2, 32, 1024
#: Step size of the first round; later rounds divide it by their number.
RATE = 0.1
#: Words of a pack; bytes of a part of the words, on average.
PACK, PART = 1 << 20, 12 << 20
_BRANCH = 16


@dataclass
class Network:
    place: np.ndarray  # (2 * side, classes + 1, hidden): what a class at a place adds; the last row is the text's edge
    bias: np.ndarray
    out: np.ndarray
    prior: np.ndarray

    @staticmethod
    def new(classes: int, hidden: int, side: int, prior: np.ndarray, seed: int = 7) -> Network:
        r = np.random.default_rng(seed)
        return Network((r.standard_normal((2 * side, classes + 1, hidden)) * 0.1).astype(np.float32), np.zeros(hidden, np.float32), (r.standard_normal((hidden, classes)) * 0.1).astype(np.float32), prior.astype(np.float32))

    def arrays(self) -> list[np.ndarray]:
        return [self.place, self.bias, self.out, self.prior]

    def hidden(self, context: np.ndarray) -> np.ndarray:
        h = self.bias + self.place[0][context[0]]
        for p, c in zip(self.place[1:], context[1:], strict=True):
            h += p[c]
        return np.tanh(h, out=h)

    def log_probabilities(self, context: np.ndarray, target: np.ndarray) -> np.ndarray:
        """Of each target class given its context (places, words)."""
        z = self.hidden(context) @ self.out + self.prior
        z -= z.max(1, keepdims=True)
        picked = z[np.arange(len(target)), target]
        return picked - np.log(np.exp(z, out=z).sum(1))

    def gradients(self, context: np.ndarray, target: np.ndarray) -> list[np.ndarray]:
        """Of the mean loss, in the order of arrays()."""
        h = self.hidden(context)
        z = h @ self.out + self.prior
        z -= z.max(1, keepdims=True)
        np.exp(z, out=z)
        z /= z.sum(1, keepdims=True)
        rows = np.arange(len(target))
        z[rows, target] -= 1
        z /= len(target)
        back = (z @ self.out.T) * (1 - h * h)
        seen = np.zeros((len(target), self.place.shape[0], self.place.shape[1]), dtype=z.dtype)
        for i, c in enumerate(context):
            seen[rows, i, c] = 1
        return [(seen.reshape(len(target), -1).T @ back).reshape(self.place.shape), back.sum(0), h.T @ z, z.sum(0)]

    def step(self, context: np.ndarray, target: np.ndarray, rate: float, squares: list[np.ndarray]) -> None:
        """Each weight moves by its gradient over the root of the sum of squares of its gradients so far."""
        for a, g, s in zip(self.arrays(), self.gradients(context, target), squares, strict=True):
            s += g * g
            a -= rate * g / np.sqrt(s + 1e-8)


def contexts_of(classes: np.ndarray, doc: np.ndarray, at: np.ndarray, side: int, edge: int) -> np.ndarray:
    """(places, words): classes of the neighbours, the edge where the text ends."""
    n = len(classes)
    out = np.empty((2 * side, len(at)), dtype=np.int64)
    for i, d in enumerate([*range(-side, 0), *range(1, side + 1)]):
        near = np.clip(at + d, 0, n - 1)
        out[i] = np.where((at + d == near) & (doc[near] == doc[at]), classes[near], edge)
    return out


def masked(seeds: np.ndarray, counts: np.ndarray, mask: int, round_: int) -> np.ndarray:
    """Places masked in this round: dealt by their text's hash and place in it, not by how texts are dealt to tasks."""
    place = np.arange(int(counts.sum())) - np.repeat(np.cumsum(counts) - counts, counts)
    return np.flatnonzero(mix(np.repeat(seeds, counts) + mix(place.astype(np.uint64) + U(1))) % U(mask) == U(round_ % mask))


def cells_of(hashes: np.ndarray) -> np.ndarray:
    return (mix(hashes ^ U(0x1B873593)) & U(CELLS - 1)).astype(np.int64)


def _add(table: pa.Table) -> pa.Table:
    """Adds up the packed arrays of a slot."""
    total = sum(np.frombuffer(x) for x in table.column("data").to_pylist())
    return pa.table({"slot": table.column("slot").slice(0, 1), "data": pa.array([pack(total)], type=pa.binary())})


def _summed(rows: DataFrame, tasks: int) -> np.ndarray | None:
    """Sum of the arrays (slot, data) of so many slots, met in a tree."""
    while tasks > _BRANCH:
        tasks = -(-tasks // _BRANCH)
        rows = rows.withColumn("slot", F.pmod("slot", F.lit(tasks)).cast("int")).groupBy("slot").applyInArrow(_add, "slot int, data binary")
    got = rows.withColumn("slot", F.lit(0)).groupBy("slot").applyInArrow(_add, "slot int, data binary").collect()
    return np.frombuffer(got[0][1]) if got else None


def cell_counts(text: DataFrame) -> np.ndarray:
    """Counts by hashed cell over all words of all documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(CELLS, dtype=np.int64)
        for batch in batches:
            for part in pieces(batch, "text"):
                counts += np.bincount(cells_of(Words(part.column("text")).hash), minlength=CELLS)
        yield pa.RecordBatch.from_arrays([pa.array(range(RANGES), type=pa.int32()), pa.array([pack(c.astype(np.float64)) for c in np.split(counts, RANGES)], type=pa.binary())], names=["slot", "data"])

    rows = text.mapInArrow(run, "slot int, data binary").groupBy("slot").applyInArrow(_add, "slot int, data binary").collect()
    out = np.zeros((RANGES, CELLS // RANGES))
    for slot, data in rows:
        out[slot] = np.frombuffer(data)
    return out.ravel()


def probe_table(counts: np.ndarray, probes: int = PROBES) -> np.ndarray:
    """Number of each cell among the most frequent ones, `probes` for all others."""
    out = np.full(len(counts), probes, dtype=np.int64)
    top = np.lexsort((np.arange(len(counts)), -counts))[:probes]
    top = top[counts[top] > 0]
    out[top] = np.arange(len(top))
    return out


def company(text: DataFrame, table: np.ndarray, probes: int = PROBES, reach: int = REACH) -> np.ndarray:
    """(probes, probes): how often one is among the next `reach` probes of the other, in one text, either way round."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(probes * probes, dtype=np.int64)
        for batch in batches:
            for part in pieces(batch, "text"):
                w = Words(part.column("text"))
                p = table[cells_of(w.hash)]
                at = np.flatnonzero(p < probes)
                p, doc = p[at], w.doc[at]
                for lag in range(1, reach + 1):
                    same = doc[lag:] == doc[:-lag]
                    total += np.bincount((p[:-lag] * probes + p[lag:])[same], minlength=probes * probes)
        yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], type=pa.int32()), pa.array([pack(total.astype(np.float64))], type=pa.binary())], names=["slot", "data"])

    got = _summed(text.mapInArrow(run, "slot int, data binary"), max(1, text.rdd.getNumPartitions()))
    m = np.zeros((probes, probes)) if got is None else got.reshape(probes, probes)
    return m + m.T


def contexts(near: np.ndarray, k: int = CONTEXTS, rounds: int = 30) -> np.ndarray:
    """(probes, k), whole numbers: how much a probe nearby speaks for each context, in 1/256 nats.

    Probes are parted by the company they keep, by k-means of the roots of their shares, begun with the probes farthest from
    those chosen before. Of a context, each probe has its share of the company of the context's probes.
    """
    total = near.sum(1)
    prior = (total + 1) / (total + 1).sum()
    share = np.sqrt((near + 20 * prior) / (total + 20)[:, None])
    x = share - np.sqrt(prior)
    weight = total + 1e-9
    chosen, far = [int(total.argmax())], None
    while len(chosen) < k:
        d = ((x - x[chosen[-1]]) ** 2).sum(1)
        far = d if far is None else np.minimum(far, d)
        chosen.append(int((far * np.sqrt(weight)).argmax()))
    centre = x[chosen]
    for _ in range(rounds):
        of = ((x[:, None] - centre[None]) ** 2).sum(2).argmin(1)
        centre = np.stack([np.average(x[of == c], axis=0, weights=weight[of == c]) if (of == c).any() else centre[c] for c in range(k)])
    held = np.stack([near[of == c].sum(0) if (of == c).any() else np.zeros(len(near)) for c in range(k)])
    q = (held + 20 * prior) / (held.sum(1, keepdims=True) + 20)
    return np.round(np.log(q / prior).T * 256).astype(np.int32)


def votes(w: Words, probe: np.ndarray, speaks: np.ndarray, reach: int = REACH) -> np.ndarray:
    """The context of each word: that for which the `reach` probes on each side (its own included) speak most."""
    at = np.flatnonzero(probe < len(speaks))
    total = np.zeros((len(at) + 1, speaks.shape[1]), dtype=np.int32)  # differences are right, whether or not sums wrap around
    np.cumsum(speaks[probe[at]], axis=0, out=total[1:], dtype=np.int32)
    before = np.searchsorted(at, np.arange(len(probe)))
    first = np.searchsorted(at, w.first)
    low, high = np.maximum(before - reach, first[w.doc]), np.minimum(before + reach + 1, first[w.doc + 1])
    return (total[high] - total[low]).argmax(1)


_ROWS = "kind int, pack long, p int, ids binary, blank binary, counts binary, seeds binary, low binary, high binary, h binary, vote binary, n binary, entry binary"
_NAMES = [c.split()[0] for c in _ROWS.split(", ")]


def _table(rows: list[dict], names: list[str], wide: bool = False):
    kinds = {"kind": pa.int32(), "p": pa.int32(), "pack": pa.int64()}
    cols = [pa.array([r.get(c) for r in rows], type=kinds.get(c, pa.binary())) for c in names]
    return (pa.Table if wide else pa.RecordBatch).from_arrays(cols, names=names)


def _runs(key: np.ndarray) -> list[tuple[int, int]]:
    if not len(key):
        return []
    cut = [0, *(np.flatnonzero(key[1:] != key[:-1]) + 1).tolist(), len(key)]
    return list(zip(cut[:-1], cut[1:], strict=True))


def _packs(table: np.ndarray, speaks: np.ndarray, p_n: int, per_pack: int):
    """Packs of texts: kind 0 keeps ids and the words as numbers of the pack's list; kind 1 sends words, votes and counts to parts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, at_pack = [], 0, TaskContext.get().partitionId() << 32

        def flush():
            h, vote, ids, blank, counts, seeds = (np.concatenate([x[i] for x in held]) for i in range(6))
            held.clear()
            distinct, inverse, n = np.unique(h, return_inverse=True, return_counts=True)
            rank = np.empty(len(distinct), dtype=np.int64)  # frequent words have small numbers, which are packed well
            order = np.lexsort((distinct, -n))
            rank[order] = np.arange(len(order))
            entry, distinct = rank[inverse].astype(np.uint32), distinct[order]
            rows = [{"kind": 0, "pack": at_pack, "ids": pack(ids), "blank": pack(blank), "counts": pack(counts), "seeds": pack(seeds), "low": pack(entry.astype(np.uint16)), "high": pack((entry >> np.uint32(16)).astype(np.uint16))}]
            pairs, n = np.unique(entry.astype(np.int64) * CONTEXTS + vote, return_counts=True)
            entry, vote = pairs // CONTEXTS, pairs % CONTEXTS
            part = (mix(distinct[entry]) % U(p_n)).astype(np.int64)
            order = np.argsort(part, kind="stable")
            for a, b in _runs(part[order]):
                o = order[a:b]
                rows.append({"kind": 1, "pack": at_pack, "p": int(part[o[0]]), "h": pack(distinct[entry[o]]), "vote": pack(vote[o].astype(np.uint8)), "n": pack(n[o].astype(np.uint32)), "entry": pack(entry[o].astype(np.uint32))})
            return _table(rows, _NAMES)

        for batch in batches:
            for part in pieces(batch, "text"):
                w = Words(part.column("text"))
                seeds = span_hash(w.hash, w.first[:-1], w.first[1:]) if len(w.hash) else np.zeros(part.num_rows, dtype=np.uint64)
                ids = part.column("doc_id")
                held.append((w.hash, votes(w, table[cells_of(w.hash)], speaks), ids.fill_null(0).to_numpy(zero_copy_only=False), ids.is_null().to_numpy(zero_copy_only=False), w.counts.astype(np.int64), seeds))
                size += len(w.hash)
                if size >= per_pack:
                    yield flush()
                    size, at_pack = 0, at_pack + 1
        if held:
            yield flush()

    return run


def _column(table: pa.Table, name: str, kind) -> np.ndarray:
    return np.concatenate([np.frombuffer(x, dtype=kind) for x in table.column(name).to_pylist()])


def _classed(own: np.ndarray):
    """The words of one part: their exact counts in the corpus and classes, for each pack that asked; and the counts of classes."""

    def run(rows: pa.Table) -> pa.Table:
        h, vote, n, entry = _column(rows, "h", np.uint64), _column(rows, "vote", np.uint8), _column(rows, "n", np.uint32).astype(np.float64), _column(rows, "entry", np.uint32)
        packs = np.repeat(rows.column("pack").to_numpy(), [len(x) // 4 for x in rows.column("entry").to_pylist()])
        distinct, which = np.unique(h, return_inverse=True)
        by_context = np.bincount(which * CONTEXTS + vote, n, len(distinct) * CONTEXTS).reshape(-1, CONTEXTS)
        total = by_context.sum(1)
        alone = own[cells_of(distinct)]
        of = np.where(alone < OWN, alone, OWN + by_context.argmax(1) * (len(BANDS) + 1) + np.searchsorted(BANDS, total, side="right"))
        order = np.lexsort((entry, packs))
        fresh = np.concatenate([[True], (packs[order][1:] != packs[order][:-1]) | (entry[order][1:] != entry[order][:-1])])
        order = order[fresh]
        packs, entry, which = packs[order], entry[order], which[order]
        out = [{"kind": 2, "pack": int(packs[a]), "entry": pack(entry[a:b]), "vote": pack(of[which[a:b]].astype(np.uint8)), "n": pack(total[which[a:b]])} for a, b in _runs(packs)]
        mass = np.bincount(of, total, CLASSES)
        return _table([*out, {"kind": 3, "p": rows.column("p")[0].as_py(), "n": pack(mass)}], _NAMES, True)

    return run


_CODED = "doc_id long, seed long, classes binary, log_counts double"


def _coded(rows: pa.Table) -> pa.Table:
    """The texts of a pack as strings of classes, with the sum of the logarithms of their words' counts."""
    kind = rows.column("kind").to_numpy()
    here, told = rows.filter(pa.array(kind == 0)), rows.filter(pa.array(kind == 2))
    ids, blank, counts, seeds = (_column(here, c, t) for c, t in (("ids", np.int64), ("blank", bool), ("counts", np.int64), ("seeds", np.int64)))
    word = _column(here, "low", np.uint16).astype(np.int64) | (_column(here, "high", np.uint16).astype(np.int64) << 16)
    classes, logs = np.zeros(0, dtype=np.uint8), np.zeros(0)
    if len(told):
        entry = _column(told, "entry", np.uint32)
        classes, logs = np.empty(len(entry), dtype=np.uint8), np.empty(len(entry))
        classes[entry], logs[entry] = _column(told, "vote", np.uint8), np.log(_column(told, "n", np.float64))
    classes, total = classes[word].tobytes(), np.concatenate([[0.0], np.cumsum(logs[word])])
    ends = np.cumsum(counts)
    spans = list(zip((ends - counts).tolist(), ends.tolist(), strict=True))
    sums = np.array([total[b] - total[a] for a, b in spans])
    return pa.Table.from_arrays([pa.array(ids, mask=blank), pa.array(seeds), pa.array([classes[a:b] for a, b in spans], type=pa.binary()), pa.array(sums)], names=[c.split()[0] for c in _CODED.split(", ")])


def coded_texts(text: DataFrame, per_pack: int = PACK) -> tuple[DataFrame, np.ndarray]:
    """A row for each text: doc_id, seed, classes (a byte a word), log_counts (summed); and how often each class occurs."""
    counts = cell_counts(text)
    table = probe_table(counts)
    speaks = contexts(company(text, table))
    # a distinct word of a pack is 17 bytes and stands for several words of 7 bytes or so
    p_n = max(parallelism(text.sparkSession), -(-int(counts.sum()) * 3 // PART))
    rows = written(text.mapInArrow(_packs(table, speaks, p_n, per_pack), _ROWS))
    told = written(rows.filter("kind = 1").groupBy("p").applyInArrow(_classed(probe_table(counts, OWN)), _ROWS))
    mass = _summed(told.filter("kind = 3").select(F.col("p").alias("slot"), F.col("n").alias("data")), p_n)
    both = rows.filter("kind = 0").unionByName(told.filter("kind = 2"))
    coded = written(both.groupBy("pack").applyInArrow(_coded, _CODED))
    discard(rows, told)
    return coded, np.zeros(CLASSES) if mass is None else mass


def _strings(batch: pa.RecordBatch, limit: int = 1 << 21) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Slices of a batch with their classes, one text after another, and the words of each text."""
    for part in pieces(batch, "classes", limit):
        raw = part.column("classes").to_pylist()
        yield part, np.frombuffer(b"".join(raw), dtype=np.uint8).astype(np.int64), np.array([len(x) for x in raw], dtype=np.int64)


def _train(network: Network, side: int, mask: int, round_: int, rate: float):
    """One round over a task's texts: weights after it times the masked places, and their number last."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = Network(*(a.copy() for a in network.arrays()))
        squares = [np.zeros_like(a) for a in net.arrays()]
        edge, n, size = network.out.shape[1], 0, np.float32(rate / (1 + round_))
        for batch in batches:
            for part, c, counts in _strings(batch):
                doc = np.repeat(np.arange(len(counts)), counts)
                at = masked(part.column("seed").to_numpy(zero_copy_only=False).view(np.uint64), counts, mask, round_)
                at = at[np.argsort(mix(at.astype(np.uint64)), kind="stable")]  # a step sees many texts
                while len(at):
                    some, at = np.split(at, [min(max(FIRST_STEP, n // 64), STEP)])
                    net.step(contexts_of(c, doc, some, side, edge), c[some], size, squares)
                    n += len(some)
        flat = np.concatenate([a.ravel() for a in net.arrays()]).astype(np.float64)
        yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], type=pa.int32()), pa.array([pack(np.append(flat * n, n))], type=pa.binary())], names=["slot", "data"])

    return run


def train(coded: DataFrame, mass: np.ndarray, hidden: int = HIDDEN, side: int = SIDE, mask: int = MASK, rounds: int = ROUNDS, rate: float = RATE) -> Network:
    """The network after so many rounds, begun with the classes' shares."""
    net = Network.new(len(mass), hidden, side, np.log((mass + 1) / (mass + 1).sum()))
    tasks = max(1, coded.rdd.getNumPartitions())
    for r in range(rounds):
        flat = _summed(coded.mapInArrow(_train(net, side, mask, r, rate), "slot int, data binary"), tasks)
        if flat is None or flat[-1] == 0:
            break
        mean, parts, at = flat[:-1] / flat[-1], [], 0
        for a in net.arrays():
            parts.append(mean[at : at + a.size].reshape(a.shape).astype(np.float32))
            at += a.size
        net = Network(*parts)
    return net


def score_coded(coded: DataFrame, net: Network, mass: np.ndarray) -> DataFrame:
    """doc_id, n_words, log_likelihood, per_word, class_likelihood (the part of the sum that is the network's)."""
    log_mass = np.log(np.maximum(mass, 1))
    side, edge = len(net.place) // 2, net.out.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, c, counts in _strings(batch):
                doc = np.repeat(np.arange(len(counts)), counts)
                by_class, within = np.empty(len(c)), np.bincount(doc, log_mass[c], len(counts))
                for i in range(0, len(c), 16_384):
                    some = np.arange(i, min(i + 16_384, len(c)))
                    by_class[some] = net.log_probabilities(contexts_of(c, doc, some, side, edge), c[some])
                by_class = np.bincount(doc, by_class, len(counts))
                total = by_class + np.where(counts > 0, part.column("log_counts").to_numpy(zero_copy_only=False) - within, 0.0)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(counts), pa.array(total), pa.array(total / np.maximum(counts, 1)), pa.array(by_class)], names=["doc_id", "n_words", "log_likelihood", "per_word", "class_likelihood"])

    return coded.mapInArrow(run, "doc_id long, n_words long, log_likelihood double, per_word double, class_likelihood double")


def score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", hidden: int = HIDDEN, side: int = SIDE, mask: int = MASK, rounds: int = ROUNDS, rate: float = RATE) -> DataFrame:
    """doc_id, n_words, log_likelihood (natural, summed over the words), per_word (0 for a text without words), class_likelihood
    (the network's part of the sum) for every row.

    A null text has no words. Null ids stay null; repeated rows are scored alike. The model is trained on these same documents;
    its weights depend on how texts are dealt to tasks, a text's score given the weights doesn't. An empty table gives no rows.
    Other columns aren't read. A task holds the longest text some ten times over.
    """
    text = docs.select(column_or_null(docs, id_col, "long").alias("doc_id"), column_or_null(docs, text_col, "string").alias("text"))
    coded, mass = coded_texts(text)
    return score_coded(coded, train(coded, mass, hidden, side, mask, rounds, rate), mass)
