"""Personal data: patterns, and terms that give protected entities away.

Base spans (email, ip, card, phone) are found by patterns. Corpus statistics then tell how much a word near an entity reveals
it: the information the word gives about the entity (their pointwise mutual information over documents) as a share of the
entity's own information. Small counts are discounted: the share is what bounds of confidence on both probabilities vouch for,
so one sighting tells much in a large corpus and little in a small one. Words whose share reaches the disclosure threshold get
spans wherever they stand, in any document: those of kind `term` are generalised by `sanitise`, and `strong` ones, that nearly
name an entity, are removed. Entities are replaced by their kind.

All counts are of distinct texts: those that hold an entity, an entity and a word near it, a word at all, and all of them. Only
words near some entity are counted, which a bitmap of fixed size tells apart in every task; what it lets through besides is
sorted out by joins. Another one tells texts that may have copies; their words travel with the text's hash, so that copies
count once.

Offsets are of code points. Bytes that aren't UTF-8 are read as U+FFFD, as Python's decoder replaces them.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lattica.llm.shared import bitmap, column_or_null, small, written
from lattica.llm.text import Words, pieces

KINDS = ("email", "ip", "card", "phone")
#: Kinds of all spans, in order.
ALL_KINDS = (*KINDS, "term", "strong")
#: Words on each side of an entity that may reveal it; share of the entity's information from which a word discloses it, and from
#: which it is a strong one; normal deviate of the one-sided bounds (99 %) on the probabilities that make up the share.
REACH, THRESHOLD, STRONG, DEVIATE = 6, 0.5, 0.8, 2.326
#: Bits of the bitmap of words near entities.
BITS = 1 << 23

_DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
_LOCAL_SET = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
#: A match can only begin at the first digit of a run of digits, since every match takes a run to its end.
_IP = re.compile(r"(?<![0-9])[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
_CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGITS = str.maketrans("", "", " -().+")
_DIGIT = re.compile("[0-9]")
_WORD = re.compile(r"[^\x20\x09-\x0D]+")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        v = ord(c) - 48
        total += v if i % 2 == 0 else (2 * v - 9 if v > 4 else 2 * v)
    return total % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost matches, found from their @: the local part is the run before it, back to the last match."""
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL_SET:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            done = m.end()
            yield start, done
        at = text.find("@", max(at + 1, done))


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end), in order of start, then kind as listed; code points, end exclusive."""
    out = []
    if "@" in text:
        out += [(a, 0, b) for a, b in _emails(text)]
    if "." in text:
        out += [(m.start(), 1, m.end()) for m in _IP.finditer(text) if all(len(p := x.lstrip("0")) <= 3 and int(p or 0) <= 255 for x in m[0].split("."))]
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 14:
            d = m[0].translate(_DIGITS)
            if 14 <= len(d) <= 19 and luhn(d):
                out.append((m.start(), 2, m.end()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 10 <= len(m[0].translate(_DIGITS)) <= 15:
                out.append((m.start(), 3, m.end()))
    return sorted(out)


def _key(data: bytes) -> int:
    return int.from_bytes(hashlib.blake2b(data, digest_size=8).digest(), "little", signed=True)


def _raw(part: pa.RecordBatch) -> list[bytes]:
    return [x or b"" for x in part.column("text").cast(pa.binary()).to_pylist()]


def _term(word: str) -> str:
    return word.strip(".,;:!?\"'()[]{}<>|*#$%&").lower()


def _around(text: str, spans: list[tuple[int, int, int]], reach: int) -> Iterator[tuple[int, int, int, list[tuple[int, int, str]]]]:
    """(start, kind, end) of each span with (start, end, term) of the words within reach of it: of the `reach` words that end before
    it and the `reach` that begin behind it, those that no span overlaps and that aren't bare numbers. Time is linear in text and spans."""
    if not spans:
        return
    words = [(m.start(), m.end()) for m in _WORD.finditer(text)]
    begin, end = [a for a, _ in words], [b for _, b in words]
    starts = [a for a, _, _ in spans]
    furthest = list(accumulate((b for _, _, b in spans), max))
    known: dict[int, str] = {}

    def term(i: int) -> str:
        if i not in known:
            before = bisect_left(starts, end[i])  # spans that start before the word ends
            known[i] = _term(text[begin[i] : end[i]]) if not before or furthest[before - 1] <= begin[i] else ""
        return known[i]

    for a, k, b in spans:
        left, right = bisect_right(end, a), bisect_left(begin, b)
        near = [*range(max(0, left - reach), left), *range(right, min(len(words), right + reach))]
        yield a, k, b, [(*words[i], t) for i in near if (t := term(i)) and not t.isdigit()]


_FOUND = "doc_id long, copy long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, base string, entities array<long>, terms array<long>"


def _find(reach: int):
    """Base spans of each text, and pairs of an entity and a word near it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        empty = hashlib.sha256(b"").hexdigest()
        for batch in batches:
            for part in pieces(batch, "text", 4 << 20):
                counts, digest, base, entities, terms = [], [], [], [], []
                for raw in _raw(part):
                    text = raw.decode("utf-8", "replace")
                    spans = base_spans(text) if "@" in text or _DIGIT.search(text) else []
                    counts.append([sum(k == i for _, k, _ in spans) for i in range(4)])
                    joined = ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)
                    base.append(joined)
                    digest.append(hashlib.sha256(joined.encode()).hexdigest() if joined else empty)
                    pairs = {(_key(f"{KINDS[k]}:{text[a:b]}".encode()), t) for a, k, b, near in _around(text, spans, reach) for *_, t in near}
                    keys = {t: _key(t.encode()) for _, t in pairs}
                    entities.append([e for e, _ in pairs])
                    terms.append([keys[t] for _, t in pairs])
                c = np.array(counts, dtype=np.int64).reshape(-1, 4)
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), part.column("copy"), *(pa.array(c[:, i]) for i in range(4)), pa.array(digest), pa.array(base), *(pa.array(x, type=pa.list_(pa.int64())) for x in (entities, terms))],
                    names=[x.split()[0] for x in _FOUND.split(", ")],
                )

    return run


class Terms:
    """Keys of the terms that words are, for those that a bitmap lets through; a bounded number is kept."""

    def __init__(self, bits: np.ndarray):
        self.bits, self.names = bits, {}

    def of(self, w: Words) -> np.ndarray:
        """For each word, the key of its term; 0 if the bitmap doesn't let it through."""
        distinct, first, inverse = np.unique(w.hash, return_index=True, return_inverse=True)
        out = np.zeros(len(distinct), dtype=np.int64)
        if len(self.names) > 400_000:
            self.names.clear()
        for i, (h, f) in enumerate(zip(distinct.tolist(), first.tolist(), strict=True)):
            t = self.names.get(h)
            if t is None:
                word = _term(w.data[w.starts[f] : w.ends[f]].tobytes().decode("utf-8", "replace"))
                t = _key(word.encode()) if word else 0
                self.names[h] = t = t if t and self.bits[t & (BITS - 1)] else 0
            out[i] = t
        return out[inverse]


def _hits(bits: np.ndarray):
    """(doc_id, copy, term, start, end) of the words that may be disclosing terms and that no base span overlaps."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms = Terms(bits)
        for batch in batches:
            for part in pieces(batch, "text"):
                w, raw = Words(part.column("text")), _raw(part)
                each = terms.of(w)
                hit = np.flatnonzero(each != 0)
                doc, start, end = w.doc[hit], w.starts[hit], w.ends[hit]
                cut = np.append(np.flatnonzero(np.diff(doc, prepend=-1)), len(doc))
                for lo, hi in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True):
                    text, low = raw[doc[lo]], int(w.offsets[doc[lo]])
                    at = seen = 0
                    for j in range(lo, hi):  # bytes to code points
                        a, b = int(start[j]) - low, int(end[j]) - low
                        start[j] = seen = seen + len(text[at:a].decode("utf-8", "replace"))
                        end[j] = seen = seen + len(text[a:b].decode("utf-8", "replace"))
                        at = b
                    spans = base_spans(text.decode("utf-8", "replace"))
                    if spans:
                        starts, furthest = [x for x, *_ in spans], list(accumulate((x for *_, x in spans), max))
                        for j in range(lo, hi):
                            before = bisect_left(starts, int(end[j]))
                            each[hit[j]] *= not before or furthest[before - 1] <= start[j]
                free = each[hit] != 0
                hit, doc, start, end = hit[free], doc[free], start[free], end[free]
                ids = part.column("doc_id").take(pa.array(doc))
                yield pa.RecordBatch.from_arrays([ids, part.column("copy").take(pa.array(doc)), pa.array(each[hit]), pa.array(start), pa.array(end)], names=["doc_id", "copy", "term", "start", "end"])

    return run


def _count(bits: np.ndarray, copied: np.ndarray):
    """(copy, term, texts of this task that hold it), for words that the bitmap lets through. Copy is null for texts without
    copies; of others, it is the text's hash, and each of them counts for itself."""
    kinds = (pa.int64(), pa.int64(), pa.int64())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms = Terms(bits)
        totals: dict[int, int] = {}
        seen: set[int] = set()

        def table(*columns) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(columns, kinds, strict=True)], names=["copy", "term", "n"])

        for batch in batches:
            for part in pieces(batch, "text"):
                w = Words(part.column("text"))
                keys = part.column("copy").to_numpy(zero_copy_only=False)
                again = copied[keys & (BITS - 1)]
                first_here = np.ones(len(keys), dtype=bool)
                for i in np.flatnonzero(again).tolist():
                    first_here[i] = int(keys[i]) not in seen
                    seen.add(int(keys[i]))
                if len(seen) > 400_000:
                    seen.clear()
                each = terms.of(w)
                hit = np.flatnonzero((each != 0) & first_here[w.doc])
                pairs = np.unique(np.stack([w.doc[hit], each[hit]], 1), axis=0) if len(hit) else np.zeros((0, 2), dtype=np.int64)
                twice = again[pairs[:, 0]]
                if twice.any():
                    yield table(keys[pairs[twice, 0]], pairs[twice, 1], np.ones(int(twice.sum()), dtype=np.int64))
                ts, n = np.unique(pairs[~twice, 1], return_counts=True)
                for t, k in zip(ts.tolist(), n.tolist(), strict=True):
                    totals[t] = totals.get(t, 0) + k
                if len(totals) > 300_000:
                    yield table([None] * len(totals), list(totals), list(totals.values()))
                    totals = {}
        yield table([None] * len(totals), list(totals), list(totals.values()))

    return run


def _bitmap(terms: DataFrame, column: str = "term") -> np.ndarray:
    """Bits of all terms, or texts."""
    return np.unpackbits(bitmap(terms, column, BITS), bitorder="little").astype(bool)


def _bound(hits, trials, deviate: float):
    """Wilson's bound on the probability of a hit; the lower one for a positive deviate, the upper one for a negative."""
    p, z2 = hits / trials, deviate * deviate
    middle = p + z2 / (2 * trials)
    return (middle - deviate * F.sqrt(p * (1 - p) / trials + z2 / (4 * trials * trials))) / (1 + z2 / trials)


def disclosing_terms(found: DataFrame, text: DataFrame, threshold: float = THRESHOLD, deviate: float = DEVIATE) -> DataFrame:
    """(entity, term, share): words that reveal an entity at least so much. Copies of a text count once, in every count."""
    near = found.filter(F.size("terms") > 0).select("copy", F.explode(F.arrays_zip(F.col("entities").alias("entity"), F.col("terms").alias("term"))).alias("t")).select("t.entity", "copy", "t.term").distinct()
    both = written(near.groupBy("entity", "term").agg(F.count("*").alias("n_both")))
    entities = near.select("entity", "copy").distinct().groupBy("entity").agg(F.count("*").alias("n_entity"))
    copies = written(found.groupBy("copy").agg(F.count("*").alias("n")))
    n_texts = F.lit(float(max(copies.count(), 2)))
    copied = _bitmap(copies.filter("n > 1"), "copy")
    held = text.mapInArrow(_count(_bitmap(both), copied), "copy long, term long, n long").groupBy("copy", "term").agg(F.sum("n").alias("n"))
    counted = held.groupBy("term").agg(F.sum(F.when(F.col("copy").isNull(), F.col("n")).otherwise(1)).alias("n_term"))
    joined = both.join(entities, "entity").join(counted, "term", "left")
    # a word that an entity touches without a space isn't counted as a word elsewhere
    n_term = F.greatest("n_both", F.coalesce("n_term", F.lit(0))).cast("double")
    given, prior = _bound(F.col("n_both"), n_term, deviate), _bound(F.col("n_entity"), n_texts, -deviate)
    share = F.when((prior < 1) & (given > 0), 1 - F.log(given) / F.log(prior)).otherwise(0.0)
    return joined.withColumn("share", share).filter(F.col("share") >= threshold).select("entity", "term", "share")


def _texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """doc_id, text and copy, a hash of the text."""
    text = docs.select(column_or_null(docs, id_col, "long").alias("doc_id"), column_or_null(docs, text_col, "string").alias("text"))
    return text.withColumn("copy", F.xxhash64(F.coalesce("text", F.lit(""))))


def find_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **kw) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_term for every row.

    spans: kind:start:end of base spans and disclosing terms by start, then kind (base kinds as listed, then term, strong);
    n_term: spans of the last two kinds. A term's share is its largest for any entity. Words that a base span overlaps aren't
    terms. A null text is empty; rows alike in id and text, null ids included, have the same result each. An empty table gives
    no rows. Other columns aren't read. A task holds the longest text some twenty times over.
    """
    return _spans(_texts(docs, id_col, text_col), **kw).drop("copy")


def _spans(text: DataFrame, reach: int = REACH, threshold: float = THRESHOLD, strong: float = STRONG, deviate: float = DEVIATE) -> DataFrame:
    found = written(text.mapInArrow(_find(reach), _FOUND))
    telling = written(disclosing_terms(found, text.select("copy", "text"), threshold, deviate).groupBy("term").agg(F.max("share").alias("share")))
    hits = text.mapInArrow(_hits(_bitmap(telling)), "doc_id long, copy long, term long, start long, end long")
    # a term by which an entity is known may stand in many texts: the short side is broadcast if its size allows
    kind = F.when(F.col("share") >= strong, ALL_KINDS.index("strong")).otherwise(ALL_KINDS.index("term"))
    spans = hits.join(small(telling, F.lit(24)), "term").select("doc_id", "copy", F.struct("start", kind.alias("kind"), "end").alias("s"))
    more = written(spans.groupBy("doc_id", "copy").agg(F.collect_set("s").alias("more"))).select(F.col("doc_id").alias("_id"), F.col("copy").alias("_copy"), "more")
    kinds = F.array(*(F.lit(k) for k in ALL_KINDS))

    def parse(x):
        p = F.split(x, ":")
        return F.struct(p[1].cast("long").alias("start"), (F.array_position(kinds, p[0]) - 1).cast("int").alias("kind"), p[2].cast("long").alias("end"))

    base = F.when(F.col("base") == "", F.array().cast("array<struct<start:bigint,kind:int,end:bigint>>")).otherwise(F.transform(F.split("base", ","), parse))
    every = F.array_sort(F.concat(base, "more"))
    joined = F.array_join(F.transform(every, lambda s: F.concat_ws(":", F.element_at(kinds, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")
    side = small(more, F.size("more") * 24)
    out = found.drop("entities", "terms").join(side, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("copy") == F.col("_copy")), "left")
    return out.select(
        "doc_id", "copy", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", F.when(F.col("more").isNull(), F.col("base")).otherwise(joined).alias("spans"), F.coalesce(F.size("more"), F.lit(0)).cast("long").alias("n_term")
    )


def generalised(word: str) -> str:
    """What kind of word it is."""
    bare = word.strip(".,;:!?\"'()[]{}<>|*#$%&")
    if any(c.isdigit() for c in bare):
        return "<number>" if not any(c.isalpha() for c in bare) else "<code>"
    if bare[:1].isupper():
        return "<abbreviation>" if bare.isupper() and len(bare) > 1 else "<name>"
    return "<word>" if any(c.isalpha() for c in bare) else "<mark>"


def sanitised(text: str | None, spans: str | None) -> str | None:
    """The text with entities replaced by their kind, telling words by the kind of word they are, and strong ones removed.
    Spans that overlap are replaced as one, by what the first of them calls for."""
    if not text or not spans:
        return text
    out, at = [], 0
    for part in spans.split(","):
        kind, a, b = part.split(":")
        a, b = int(a), int(b)
        if a >= at:
            out += [text[at:a], {"term": generalised(text[a:b]), "strong": ""}.get(kind, f"<{kind}>")]
        at = max(at, b)
    return "".join([*out, text[at:]])


def sanitise(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **kw) -> DataFrame:
    """doc_id, spans, text without what identifies, for every row. Rows meet their spans by id and text, null ids included, so
    repeated ids and rows are no harm; a null text stays null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, "text", 4 << 20):
                blank = part.column("text").is_null().to_pylist()
                texts = [None if n else sanitised(t.decode("utf-8", "replace"), s) for t, s, n in zip(_raw(part), part.column("spans").to_pylist(), blank, strict=True)]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("spans"), pa.array(texts, type=pa.string())], names=["doc_id", "spans", "text"])

    text = _texts(docs, id_col, text_col)
    spans = _spans(text, **kw).select(F.col("doc_id").alias("_id"), F.col("copy").alias("_copy"), "spans").dropDuplicates(["_id", "_copy"])
    met = text.join(spans, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("copy") == F.col("_copy")))
    return met.select("doc_id", "spans", "text").mapInArrow(run, "doc_id long, spans string, text string")
