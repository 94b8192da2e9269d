"""Quality classifier: histogram gradient-boosted trees over statistics of a document.

Statistics come from Arrow buffers with numpy. Trees are grown on a bounded sample of labelled rows on the driver, then
flattened into arrays (split feature, threshold, leaf values of complete trees) which every task walks for all rows at once.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lattica.llm.shared import column_or_null
from lattica.llm.text import Words, pieces

#: At most so many labelled rows are learned from: those with the smallest hash of their id.
SAMPLE = 20_000
#: Score from which a document counts as good.
THRESHOLD = 0.7

_MARKS = {"upper": range(65, 91), "lower": range(97, 123), "digit": range(48, 58), "bang": b"!", "pipe": b"|", "symbol": b"#$%&*<>{}[]=@~^\\_+", "stop": b".,;:?", "line": b"\n", "wide": range(128, 256)}
FEATURES = [*(f"share_{k}" for k in _MARKS), "log_words", "mean_length", "long_words", "bare_marks", "ends_bang", "ends_symbol", "ends_stop", "all_caps", "repeats", "longest_repeat", "distinct", "top_gap", "words_a_line"]
_TABLES = {k: np.isin(np.arange(256), list(v)) for k, v in _MARKS.items()}


def _sum(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sums of values[bounds[i]:bounds[i+1]]; empty spans are 0."""
    total = np.zeros(len(values) + 1)
    np.cumsum(values, out=total[1:])
    return total[bounds[1:]] - total[bounds[:-1]]


def statistics(texts: pa.Array) -> np.ndarray:
    """A row of FEATURES for each text; an empty text has zeros."""
    w = Words(texts)
    out = np.zeros((len(texts), len(FEATURES)))
    size, n = np.maximum(np.diff(w.offsets), 1), np.maximum(w.counts, 1)
    marks = {k: _sum(t[w.data], w.offsets) for k, t in _TABLES.items()}
    for j, k in enumerate(_MARKS):
        out[:, j] = marks[k] / size
    j = len(_MARKS)
    length = w.ends - w.starts
    last = w.data[w.ends - 1] if len(length) else np.zeros(0, dtype=np.uint8)
    lower = np.concatenate([[0], np.cumsum(_TABLES["lower"][w.data], dtype=np.int64)])
    upper = np.concatenate([[0], np.cumsum(_TABLES["upper"][w.data], dtype=np.int64)])
    letters = np.concatenate([[0], np.cumsum((_TABLES["lower"] | _TABLES["upper"] | _TABLES["wide"] | _TABLES["digit"])[w.data], dtype=np.int64)])
    caps = (upper[w.ends] - upper[w.starts] > 1) & (lower[w.ends] == lower[w.starts])
    bare = letters[w.ends] == letters[w.starts]
    same = np.zeros(len(length), dtype=bool)
    same[1:] = (w.hash[1:] == w.hash[:-1]) & (w.doc[1:] == w.doc[:-1])
    run = np.arange(len(same)) - np.maximum.accumulate(np.where(same, 0, np.arange(len(same)))) if len(same) else np.zeros(0)
    longest = np.zeros(len(texts))
    np.maximum.at(longest, w.doc, run)
    order = np.lexsort((w.hash, w.doc))
    fresh = np.ones(len(order), dtype=bool)
    if len(order):
        h, d = w.hash[order], w.doc[order]
        fresh[1:] = (h[1:] != h[:-1]) | (d[1:] != d[:-1])
    groups = np.flatnonzero(fresh)
    most = np.zeros(len(texts))
    if len(groups):
        np.maximum.at(most, w.doc[order][groups], np.diff(np.append(groups, len(order))))
    for v in (
        np.log1p(w.counts), _sum(length, w.first) / n, _sum(length > 20, w.first) / n, _sum(bare, w.first) / n, _sum(_TABLES["bang"][last], w.first) / n,
        _sum(_TABLES["symbol"][last], w.first) / n, _sum(_TABLES["stop"][last], w.first) / n, _sum(caps, w.first) / n, _sum(same, w.first) / n, np.log1p(longest),
        _sum(fresh, w.first) / n / np.maximum(np.log1p(w.counts), 1), most / n, np.log1p(w.counts / (marks["line"] + 1)),
    ):
        out[:, j] = v
        j += 1
    return out


@dataclass
class Trees:
    """Complete binary trees of one depth: feature and threshold of inner nodes in level order, values of leaves."""

    feature: np.ndarray
    threshold: np.ndarray
    leaf: np.ndarray
    base: float

    def predict(self, x: np.ndarray) -> np.ndarray:
        rows, total = np.arange(len(x)), np.full(len(x), self.base)
        depth = int(np.log2(self.leaf.shape[1])) if len(self.leaf) else 0
        for f, t, v in zip(self.feature, self.threshold, self.leaf, strict=True):
            node = np.zeros(len(x), dtype=np.int64)
            for _ in range(depth):
                node = 2 * node + 1 + (x[rows, f[node]] > t[node])
            total += v[node - (len(v) - 1)]
        return 1 / (1 + np.exp(-total))


def fit(x: np.ndarray, y: np.ndarray, trees: int = 80, depth: int = 4, rate: float = 0.2, bins: int = 64, ridge: float = 1.0) -> Trees:
    """Logistic loss, second order; splits are sought in histograms of quantile bins. Without rows, everything scores 1."""
    none = Trees(np.zeros((0, 1), int), np.zeros((0, 1)), np.zeros((0, 2)), 40.0)
    if not len(y):
        return none
    mean = (y.sum() + 0.5) / (len(y) + 1)
    base = float(np.log(mean / (1 - mean)))
    if y.min() == y.max():
        return Trees(none.feature, none.threshold, none.leaf, base)
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(x.shape[1])]
    binned = np.stack([np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(edges)], 1)
    inner, total = 2**depth - 1, np.full(len(y), base)
    out = ([], [], [])
    for _ in range(trees):
        p = 1 / (1 + np.exp(-total))
        g, h = p - y, p * (1 - p)
        node, feature, threshold = np.zeros(len(y), dtype=np.int64), np.zeros(inner, dtype=np.int64), np.full(inner, np.inf)
        for level in range(depth):
            first, width = 2**level - 1, 2**level
            at = node - first
            best = np.full(width, 1e-9)
            pick = np.zeros((width, 2), dtype=np.int64) - 1
            for j, e in enumerate(edges):
                if not len(e):
                    continue
                key = at * bins + binned[:, j]
                gs = np.bincount(key, g, width * bins).reshape(width, bins).cumsum(1)
                hs = np.bincount(key, h, width * bins).reshape(width, bins).cumsum(1)
                gl, hl, gt, ht = gs[:, : len(e)], hs[:, : len(e)], gs[:, -1:], hs[:, -1:]
                gain = gl**2 / (hl + ridge) + (gt - gl) ** 2 / (ht - hl + ridge) - gt**2 / (ht + ridge)
                gain[(hl < 1) | (ht - hl < 1)] = 0
                top = gain.argmax(1)
                better = gain[np.arange(width), top] > best
                best[better] = gain[np.arange(width), top][better]
                pick[better] = np.stack([np.full(width, j), top], 1)[better]
            for k in range(width):
                if pick[k, 0] >= 0:
                    feature[first + k], threshold[first + k] = pick[k, 0], edges[pick[k, 0]][pick[k, 1]]
            node = 2 * node + 1 + (x[np.arange(len(y)), feature[node]] > threshold[node])
        at = node - inner
        leaf = -rate * np.bincount(at, g, inner + 1) / (np.bincount(at, h, inner + 1) + ridge)
        total += leaf[at]
        for o, v in zip(out, (feature, threshold, leaf), strict=True):
            o.append(v)
    return Trees(*(np.array(o) for o in out), base)


def _held_out(c):
    """Remainder 2 of crc32(id as text) by 4: such rows are never learned from."""
    return F.coalesce(F.pmod(F.crc32(c.cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))


def _measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in pieces(batch, "text"):
            x = statistics(part.column("text"))
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("y"), pa.array(list(x), type=pa.list_(pa.float64()))], names=["doc_id", "y", "x"])


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", sample: int = SAMPLE) -> Trees:
    """Learns from at most `sample` labelled rows that aren't held out. Rows without an id or a label aren't learned from; of labels
    of one id the larger counts, and of texts of one id the one with the smallest hash. Without labels, everything scores 1."""
    picked = (
        labels.select(column_or_null(labels, id_col, "long").alias("_id"), column_or_null(labels, label_col, "int").alias("y"))
        .filter(F.col("_id").isNotNull() & F.col("y").isNotNull() & ~_held_out(F.col("_id")))
        .groupBy("_id").agg(F.max("y").alias("y"))
        .orderBy(F.xxhash64("_id"), "_id").limit(sample)
    )
    text = docs.select(column_or_null(docs, id_col, "long").alias("doc_id"), column_or_null(docs, text_col, "string").alias("text"))
    # `sample` rows of two numbers: the broadcast has that bound
    rows = text.join(F.broadcast(picked), F.col("doc_id") == F.col("_id")).groupBy("doc_id", "y").agg(F.min_by("text", F.xxhash64("text")).alias("text"))
    got = rows.mapInArrow(_measure, "doc_id long, y int, x array<double>").orderBy("doc_id").toPandas()
    return fit(np.array(got["x"].tolist()).reshape(len(got), len(FEATURES)), got["y"].to_numpy(dtype=float))


def score(docs: DataFrame, model: Trees, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score, predicted for every row. A null text is scored as an empty one; other columns aren't read."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, "text"):
                s = model.predict(statistics(part.column("text")))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("held_out"), pa.array(s), pa.array((s >= threshold).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    key = column_or_null(docs, id_col, "long")
    frame = docs.select(key.alias("doc_id"), _held_out(key).alias("held_out"), column_or_null(docs, text_col, "string").alias("text"))
    return frame.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")


def keep_good(docs: DataFrame, model: Trees, text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows that aren't rejected, with all their columns; the text is scored where it is read, without a join. A null text is
    scored as an empty one, and ids play no part."""
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, text_col):
                good = model.predict(statistics(part.column(at).cast(pa.string()))) >= threshold
                if good.any():
                    yield part.filter(pa.array(good))

    return docs.mapInArrow(run, docs.schema)
