"""Benchmark decontamination by template canonicalisation.

Numbers, names and units become typed placeholders; windows of template tokens of documents and benchmark items are joined
by hash. Every window is joined by its words as they stand too, so that copies are met whatever their words are taken for;
a template with few literal tokens would meet others by chance and is left out. An item shorter than a window is one window.
Windows of one item at one displacement form an alignment. Its slots must be consistent: a value of the item stands for
one value of the document in more than half of its places, and the other way round. Slots that differ aren't covered. Numbers and
units may be equal by chance, so nothing else follows for them; a name that stands for several, none of them in most places, is
somebody else, and such an alignment counts only with the windows that agree word for word. So a re-parameterised question is
caught and a chance meeting of placeholders isn't.

A capitalised word inside a sentence is a name, unless an article or the like stands before it: then it is a noun, as in German.

The tasks get a bitmap of the benchmark's window hashes, and the hashes themselves if they are few (their number is checked);
only windows that it lets through leave them. Copies of a document leak alike, so verdicts are kept by text.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lattica.llm.shared import bitmap, cleaned, column_or_null, small, written
from lattica.llm.text import U, Words, mix, pieces, span_hash

#: Template tokens of a window; tokens that must be covered at most; share of the item that is enough; literal tokens that a
#: template needs.
WINDOW, COVER, SHARE, LITERAL = 8, 13, 0.5, 4
#: Windows of a benchmark whose hashes are sent to the tasks (8 bytes each); bits of the bitmap at least and at most.
FEW, LEAST_BITS, MOST_BITS = 4_000_000, 1 << 23, 1 << 30
_CACHE = 400_000
#: Tells hashes of windows taken word for word from those of templates.
_EXACT = U(0x6A09E667F3BCC909)

LITERALS, NUMBER, NAME, UNIT = 0, 1, 2, 3
UNITS = frozenset("% ° °c °f mm cm m km mg g kg t ml l s sec secs min mins h hr hrs hour hours minute minutes second seconds day days week weeks month months year years inch inches foot feet ft mile miles lb lbs oz pound pounds dollar dollars cent cents euro euros $ € £ mph kmh km/h w kw v a hz j n pa meter meters metre metres gram grams liter liters litre litres percent".split())
#: Words before which a capitalised word is a noun.
DETERMINERS = frozenset(
    "the a an this that these those my your his her its our their some any no each every "
    "der die das dem den des ein eine einen einem einer eines kein keine keinen mein meine dein deine sein seine ihr ihre unser unsere im am zum zur vom beim "
    "le la les un une du au aux ce cet cette ces mon ma mes ton ta tes son sa ses el los las una unos unas del al lo mi su sus".split()
)
_NUMBER = re.compile(r"[$€£+-]?[0-9][0-9.,:/]*(?:st|nd|rd|th)?%?")
_STRIP = re.compile(r"^[^\w$€£+%°-]+|[^\w%°$€£]+$")


def _classify(word: bytes) -> tuple[int, int, int, int]:
    """(kind if a name may stand here, kind if a sentence begins here, hash of the bare word, whether it ends a sentence (1) or
    comes before a noun (2))."""
    text = word.decode("utf-8", "replace")
    bare = _STRIP.sub("", text) or text
    value = xxhash.xxh64_intdigest(bare.lower().encode()) | 1
    ends = 1 if text.rstrip("\"')]}»”’")[-1:] in ".!?:" else 2 * (bare.lower() in DETERMINERS)
    if _NUMBER.fullmatch(bare):
        return NUMBER, NUMBER, value, ends
    if bare.lower() in UNITS:
        return UNIT, UNIT, value, ends
    capital = bare[:1].isupper() and not bare.isupper()
    return (NAME if capital else LITERALS), LITERALS, value, ends


class Canon:
    """Template tokens of word batches, with a bounded table of words already classified."""

    def __init__(self):
        self.known: dict[int, int] = {}
        self.rows: list[tuple[int, int, int, int]] = []

    def of(self, w: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(template hash, slot value or 0, kind, hash of the bare word) of each word."""
        distinct, first, inverse = np.unique(w.hash, return_index=True, return_inverse=True)
        if len(self.rows) + len(distinct) > _CACHE:
            self.known, self.rows = {}, []
        known, rows, data = self.known, self.rows, w.data
        at = np.empty(len(distinct), dtype=np.int64)
        for i, (h, f) in enumerate(zip(distinct.tolist(), first.tolist(), strict=True)):
            k = known.get(h)
            if k is None:
                k = known[h] = len(rows)
                rows.append(_classify(data[w.starts[f] : w.ends[f]].tobytes()))
            at[i] = k
        table = [rows[k] for k in at.tolist()]
        kind0 = np.array([r[0] for r in table], dtype=np.int8)[inverse]
        kind1 = np.array([r[1] for r in table], dtype=np.int8)[inverse]
        value = np.array([r[2] for r in table], dtype=np.uint64)[inverse]
        says = np.array([r[3] for r in table], dtype=np.int8)[inverse]
        begins = np.ones(len(inverse), dtype=bool)
        begins[1:] = (says[:-1] == 1) | (w.doc[1:] != w.doc[:-1])
        noun = np.zeros(len(inverse), dtype=bool)
        noun[1:] = (says[:-1] == 2) & (w.doc[1:] == w.doc[:-1])
        begins |= (w.starts > 0) & (data[np.maximum(w.starts - 1, 0)] == 10)
        kind = np.where(begins, kind1, kind0)
        after_number = np.zeros(len(kind), dtype=bool)
        after_number[1:] = (kind[:-1] == NUMBER) & (w.doc[1:] == w.doc[:-1])
        kind[((kind == UNIT) & ~after_number) | ((kind == NAME) & noun)] = LITERALS
        template = np.where(kind == LITERALS, value, mix(kind.astype(np.uint64) + U(77)))
        return template, np.where(kind == LITERALS, U(0), value), kind, value


def _windows(w: Words, canon: Canon, sizes: list[int]):
    """(start words, size, hashes, slots of all words, names of all words) of windows: by template, then word for word, without slots."""
    template, slots, kind, value = canon.of(w)
    none = np.zeros(len(slots), dtype=np.uint64)
    literal = np.concatenate([[0], np.cumsum(kind == LITERALS)])
    for k in sizes:
        at = np.arange(max(0, len(w.doc) - k + 1))
        if k > 1 and len(at):
            at = at[w.doc[at] == w.doc[at + k - 1]]
        yield at, k, mix(span_hash(value, at, at + k) ^ _EXACT), none, none > 0
        at = at[literal[at + k] - literal[at] >= LITERAL]
        yield at, k, span_hash(template, at, at + k), slots, kind == NAME


SCHEMA = "_uid long, doc_id long, h1 long, h2 long, hits array<struct<pos:int,size:int,hash:long,slots:array<long>>>"


def _lists(doc: np.ndarray, n: int, cols: list[tuple[str, pa.Array]]) -> pa.Array:
    """For each of n texts the list of its rows, which come in order of texts."""
    bounds = np.searchsorted(doc, np.arange(n + 1)).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(bounds), pa.StructArray.from_arrays([c for _, c in cols], names=[x for x, _ in cols]))


def _scan(sizes: list[int], bits: np.ndarray, few):
    """For each row, those of its windows that the bitmap lets through and, with `few` (a broadcast of sorted hashes), the
    benchmark has. Of a whole item's windows that are alike in a text, one is enough."""
    size = len(bits) * 8

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        canon, wanted = Canon(), few.value if few else None
        for batch in batches:
            for part in pieces(batch, "text"):
                w = Words(part.column("text"))
                held = []
                for at, k, h, slots, _ in _windows(w, canon, sizes):
                    spot = h & U(size - 1)
                    maybe = np.flatnonzero((bits[(spot >> U(3)).astype(np.int64)] >> (spot & U(7)).astype(np.uint8)) & 1)
                    if wanted is not None:
                        maybe = maybe[wanted[np.minimum(np.searchsorted(wanted, h[maybe]), len(wanted) - 1)] == h[maybe]] if len(wanted) else maybe[:0]
                    at, h = at[maybe], h[maybe]
                    if k < WINDOW and len(at):
                        names = h ^ mix(span_hash(slots, at, at + k))
                        order = np.lexsort((at, names, w.doc[at]))
                        same = (names[order][1:] == names[order][:-1]) & (w.doc[at][order][1:] == w.doc[at][order][:-1])
                        first = order[np.concatenate([[True], ~same])]
                        at, h = at[first], h[first]
                    if len(at):
                        held.append((w.doc[at], at - w.first[w.doc[at]], np.full(len(at), k), h.view(np.int64), np.full(len(at), k), slots[np.repeat(at, k) + np.tile(np.arange(k), len(at))].view(np.int64)))
                doc, pos, sizes_, h, n, values = (np.concatenate(c) for c in zip(*held, strict=True)) if held else [np.zeros(0, dtype=np.int64)] * 6
                order = np.argsort(doc, kind="stable")
                begin, n = (np.cumsum(n) - n)[order], n[order]
                spots = np.repeat(begin - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
                inner = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(n)]).astype(np.int32)), pa.array(values[spots]))
                hits = _lists(doc[order], part.num_rows, [("pos", pa.array(pos[order].astype(np.int32))), ("size", pa.array(sizes_[order].astype(np.int32))), ("hash", pa.array(h[order])), ("slots", inner)])
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in ("_uid", "doc_id", "h1", "h2")), hits], names=["_uid", "doc_id", "h1", "h2", "hits"])

    return run


def benchmark_windows(bench: DataFrame, id_col: str = "item_id", text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """b_uid, item_id, n_words, b_pos, size, hash, b_slots, b_names: windows of every item; an item below the window's size is one window."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        canon = Canon()
        for batch in batches:
            for part in pieces(batch, "text"):
                w = Words(part.column("text"))
                out = []
                ids = list(zip(part.column("b_uid").to_pylist(), part.column("item_id").to_pylist(), strict=True))
                sizes = sorted({min(window, int(n)) for n in w.counts if n})
                for at, k, h, slots, names in _windows(w, canon, sizes):
                    for a, x in zip(at.tolist(), h.view(np.int64).tolist(), strict=True):
                        d = int(w.doc[a])
                        if k == min(window, int(w.counts[d])):
                            out.append((*ids[d], int(w.counts[d]), a - int(w.first[d]), k, x, slots[a : a + k].view(np.int64).tolist(), names[a : a + k].tolist()))
                cols = list(zip(*out, strict=True)) or [[]] * 8
                kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.bool_()))
                yield pa.RecordBatch.from_arrays([pa.array(list(c), type=t) for c, t in zip(cols, kinds, strict=True)], names=["b_uid", "item_id", "n_words", "b_pos", "size", "hash", "b_slots", "b_names"])

    frame = bench.select(F.monotonically_increasing_id().alias("b_uid"), column_or_null(bench, id_col, "long").alias("item_id"), column_or_null(bench, text_col, "string").alias("text"))
    return frame.mapInArrow(run, "b_uid long, item_id long, n_words int, b_pos int, size int, hash long, b_slots array<long>, b_names array<boolean>")


def _text_key(text: Column) -> list[Column]:
    """Two hashes by which a text is known; null is empty."""
    text = F.coalesce(text, F.lit(""))
    return [F.xxhash64(text).alias("h1"), F.xxhash64(text, F.lit(1)).alias("h2")]


def alignments(docs: DataFrame, bench: DataFrame, id_col: str = "doc_id", text_col: str = "text", few: int = FEW) -> tuple[DataFrame, DataFrame]:
    """(rows with _uid, doc_id and the text's h1, h2; alignments that cover enough with _uid, b_uid, item_id, covered)."""
    windows = written(benchmark_windows(bench))
    n = windows.count()
    sizes = sorted(r[0] for r in windows.select("size").distinct().collect())
    bits = bitmap(windows, "hash", min(MOST_BITS, max(LEAST_BITS, 1 << (16 * n).bit_length())))
    wanted = None
    if n <= few:
        wanted = docs.sparkSession.sparkContext.broadcast(np.sort(windows.select("hash").distinct().toPandas()["hash"].to_numpy(dtype=np.int64).view(np.uint64)))
    text = column_or_null(docs, text_col, "string")
    frame = docs.select(F.monotonically_increasing_id().alias("_uid"), column_or_null(docs, id_col, "long").alias("doc_id"), *_text_key(text), text.alias("text"))
    rows = written(frame.mapInArrow(_scan(sizes, bits, wanted), SCHEMA))
    hits = rows.filter(F.size("hits") > 0).select("_uid", F.explode("hits").alias("h")).select("_uid", "h.*")
    side = F.broadcast(windows) if n <= min(few, 100_000) else windows
    met = hits.join(side, ["hash", "size"]).withColumn("shift", F.col("pos") - F.col("b_pos"))
    key = ["_uid", "b_uid", "n_words", "shift"]
    # windows of one alignment overlap: the covered words are the union of their spans
    span = F.sequence("b_pos", F.col("b_pos") + F.col("size") - 1)
    union = lambda x: F.size(F.array_distinct(F.flatten(F.collect_set(x))))
    spans = met.groupBy(*key, "item_id").agg(union(span).alias("words"), union(F.when(F.col("slots") == F.col("b_slots"), span)).alias("literal"))
    slots = met.select(*key, "b_pos", F.posexplode(F.arrays_zip("slots", "b_slots", "b_names")).alias("i", "s")).filter("s.slots <> 0")
    places = slots.select(*key, (F.col("b_pos") + F.col("i")).alias("place"), F.col("s.slots").alias("d"), F.col("s.b_slots").alias("b"), F.col("s.b_names").alias("name")).distinct()
    pairs = places.groupBy(*key, "name", "d", "b").agg(F.count("*").alias("n"))
    of_d, of_b = Window.partitionBy(*key, "name", "d"), Window.partitionBy(*key, "name", "b")
    most = lambda x, w: 2 * x > F.sum("n").over(w)
    judged = pairs.select(
        *key, "n", (most(F.col("n"), of_d) & most(F.col("n"), of_b)).alias("fits"), (F.col("name") & ~(most(F.max("n").over(of_d), of_d) & most(F.max("n").over(of_b), of_b))).alias("other")
    )
    fits = judged.groupBy(*key).agg(F.sum(F.when(F.col("fits"), 0).otherwise(F.col("n"))).alias("lost"), F.max("other").alias("other"))
    covered = F.when(F.coalesce("other", F.lit(False)), F.col("literal")).otherwise(F.greatest(F.col("words") - F.coalesce("lost", F.lit(0)), F.col("literal"))).cast("int")
    good = spans.join(fits, key, "left").withColumn("covered", covered)
    enough = F.col("covered") >= F.least(F.lit(COVER), F.ceil(F.col("n_words") * SHARE))
    return rows.select("_uid", "doc_id", "h1", "h2"), good.filter(enough).select("_uid", "b_uid", "item_id", "covered")


def contamination(docs: DataFrame, bench: DataFrame, id_col: str = "doc_id", text_col: str = "text", **kw) -> DataFrame:
    """doc_id, leaked, n_items, item_ids (ascending, comma-joined; empty if none), covered (most words of one alignment).

    One row for every row, whatever its id or text; a null text leaks nothing, and so does an empty benchmark. Items without
    words or text can't be met; an item of one word leaks wherever that word stands. Items with a null id count, and are left
    out of item_ids. Where an item repeats a window, a text meets it once for each. Other columns aren't read. A task
    holds the longest text some twenty times over.
    """
    rows, good = alignments(docs, bench, id_col, text_col, **kw)
    found = good.groupBy("_uid").agg(F.array_sort(F.collect_set("item_id")).alias("items"), F.count_distinct("b_uid").alias("n"), F.max("covered").alias("covered"))
    return rows.join(found, "_uid", "left").select(
        "doc_id", F.col("items").isNotNull().alias("leaked"), F.coalesce("n", F.lit(0)).cast("long").alias("n_items"), F.coalesce(F.array_join("items", ","), F.lit("")).alias("item_ids"), F.coalesce("covered", F.lit(0)).alias("covered")
    )


def drop_contaminated(docs: DataFrame, bench: DataFrame, id_col: str = "doc_id", text_col: str = "text", **kw) -> DataFrame:
    """The rows whose text leaks nothing, with all their columns. Each row is judged by its own text, whatever its id; without a
    text column every row stays."""
    names = docs.columns
    packed = docs.select(*(F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(names)))
    text = F.col(f"c{names.index(text_col)}").cast("string") if text_col in names else F.lit(None).cast("string")
    made: list = []
    with cleaned(made):
        rows, good = alignments(packed.select(F.lit(None).cast("long").alias("doc_id"), text.alias("text")), bench, **kw)
        leaks = written(rows.join(good.select("_uid").distinct(), "_uid", "left_semi").select("h1", "h2").distinct())
        made.append(leaks)
    side = small(leaks, F.lit(0))
    kept = packed.select("*", *_text_key(text)).join(side, ["h1", "h2"], "left_anti")
    return kept.select(*(F.col(f"c{i}").alias(c) for i, c in enumerate(names)))
