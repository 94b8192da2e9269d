import hashlib
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from lattica.llm import decontaminate, lm_score, pii, quality, sentencepiece_codec
from lattica.llm.text import Words, span_hash

from .conftest import prose


def test_words_and_hashes():
    texts = ["a bb  a\n\x0bccc", None, "", "bb", "é x y"]
    w = Words(pa.array(texts))
    assert w.counts.tolist() == [4, 0, 0, 1, 2]
    assert w.hash[0] == w.hash[2] and w.hash[1] == w.hash[4] and len(set(w.hash.tolist())) == 5
    low = Words(pa.array(["AbC É", "abc é"]), lower=True)
    assert low.hash[0] == low.hash[2] and low.hash[1] != low.hash[3]
    v = np.arange(50, dtype=np.uint64)
    v[30:40] = v[10:20]
    h = span_hash(v, np.array([10, 30, 10]), np.array([20, 40, 19]))
    assert h[0] == h[1] != h[2]


# --- SentencePiece


def library():
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=sentencepiece_codec.default_model())


def unigram_file(path):
    """The same pieces and scores, read as a model of the unigram kind: field 3 of the trainer's settings is 1."""
    with open(sentencepiece_codec.default_model(), "rb") as f:
        raw = f.read()
    at = raw.rindex(b"\x12\x06tok_v0\x18\x02")
    path.write_bytes(raw[: at + 9] + b"\x01" + raw[at + 10 :])
    return str(path)


TEXTS = ["hello  world", "  lead", "a\nb", "x\t y ", "é ñ 漢字 ①", "", " ", "aaaaaaaaaa bbbb", "int main(){\r\n  return 0;\r\n}\r\n", "\n\n \n x", "internationalization of 12345 3.14", prose(300, 5)]


def test_bpe_equals_library():
    codec, sp = sentencepiece_codec.Codec.of(sentencepiece_codec.default_model()), library()
    assert codec.bpe
    for t, ids in zip(TEXTS, codec.encode(TEXTS), strict=True):
        assert ids.tolist() == sp.encode(t) and codec.decode(ids) == t
    for odd in ("a▁b ▁", "\ufdd0", "x\ufdd01▁\ufdd00 \ufdd0", "▁▁ \ufdd0▁0"):
        assert codec.decode(codec.encode([odd])[0]) == odd
    assert codec.decode(np.array(sp.encode("a\ufdd0b"), dtype=np.int32)) == "a\ufdd0b"


def test_other_normalisers_are_refused():
    spec = lambda *fields: bytes([0x1A, 2 * len(fields)]) + b"".join(bytes(f) for f in fields)
    sentencepiece_codec._check_normaliser(spec((0x20, 0)))
    for bad in (spec(), spec((0x20, 1)), spec((0x18, 0), (0x20, 0)), spec((0x20, 0), (0x28, 0)), b"\x1a\x05\x12\x01x\x20\x00"):
        with pytest.raises(ValueError):
            sentencepiece_codec._check_normaliser(bad)


def test_unigram_equals_library(tmp_path):
    import sentencepiece

    path = unigram_file(tmp_path / "u.model")
    codec, sp = sentencepiece_codec.Codec(path), sentencepiece.SentencePieceProcessor(model_file=path)
    assert not codec.bpe
    for t, ids in zip(TEXTS, codec.encode(TEXTS), strict=True):
        theirs = sp.encode(t)
        assert sum(codec.scores[i] for i in ids.tolist()) == pytest.approx(sum(codec.scores[i] for i in theirs)) and codec.decode(ids) == t


def test_codec_round_trip(docs, odd, empty, rows):
    got = sentencepiece_codec.encode_and_check(docs).collect()
    sp = library()
    text = {i: t or "" for i, t, *_ in rows}
    assert len(got) == len(rows) and all(r.round_trip for r in got)
    assert all(r.tokens_sha256 == hashlib.sha256(np.array(sp.encode(text[r.doc_id]), dtype=np.int32).tobytes()).hexdigest() for r in got)
    back = sentencepiece_codec.decode(sentencepiece_codec.encode(docs)).collect()
    assert sorted((r.doc_id, r.text) for r in back) == sorted((i, t or "") for i, t, *_ in rows)
    assert sentencepiece_codec.encode_and_check(odd, keep_ids=True).count() == odd.count() and sentencepiece_codec.encode(empty).count() == 0


def test_codec_of_odd_rows(odd):
    """By value: null and empty texts have no tokens, rows alike are alike, columns of other names are no harm."""
    sp = library()
    want = sorted((str(r.doc_id), hashlib.sha256(np.array(sp.encode(r.text or ""), dtype=np.int32).tobytes()).hexdigest()) for r in odd.collect())
    got = sentencepiece_codec.encode_and_check(odd).collect()
    assert sorted((str(r.doc_id), r.tokens_sha256) for r in got) == want and all(r.round_trip for r in got)


# --- quality


def junk(i):
    return " ".join(f"{w}***" if j % 2 else w.upper() + "!!" for j, w in enumerate(prose(60, i).split()))


def plain_statistics(text):
    """Word by word and character by character."""
    raw, words = (text or "").encode(), [w.encode() for w in re.findall(r"[^\x20\x09-\x0D]+", text or "")]
    size, n = max(len(raw), 1), max(len(words), 1)
    marks = [range(65, 91), range(97, 123), range(48, 58), b"!", b"|", b"#$%&*<>{}[]=@~^\\_+", b".,;:?", b"\n", range(128, 256)]
    is_letter = lambda b: 48 <= b < 58 or 65 <= b < 91 or 97 <= b < 123 or b >= 128
    same = [a == b for a, b in zip(words, words[1:])]
    runs, now = [0], 0
    for s in same:
        now = now + 1 if s else 0
        runs.append(now)
    caps = [sum(65 <= b < 91 for b in w) > 1 and not any(97 <= b < 123 for b in w) for w in words]
    return [
        *(sum(b in m for b in raw) / size for m in marks), np.log1p(len(words)), sum(map(len, words)) / n, sum(len(w) > 20 for w in words) / n, sum(not any(map(is_letter, w)) for w in words) / n,
        sum(w.endswith(b"!") for w in words) / n, sum(w[-1] in marks[5] for w in words) / n, sum(w[-1] in marks[6] for w in words) / n, sum(caps) / n, sum(same) / n, np.log1p(max(runs)),
        len(set(words)) / n / max(np.log1p(len(words)), 1), max(Counter(words).values(), default=0) / n, np.log1p(len(words) / (raw.count(b"\n") + 1)),
    ]


def test_statistics_equal_brute_force():
    texts = [prose(50, 1), junk(3), "", None, "a a a B B! ÉÉ É", "x\ny\n\n z | {} == ** 12", "A" * 30 + " bb" * 40, "  \t "]
    got = quality.statistics(pa.array(texts))
    assert got.shape == (len(texts), len(quality.FEATURES))
    for t, row in zip(texts, got, strict=True):
        assert np.allclose(row, plain_statistics(t)), t


def test_scores_of_odd_rows(spark, odd):
    """By value: a row's score is that of its text alone; a null id is never held out."""
    import zlib

    r = np.random.default_rng(3)
    x = r.random((300, len(quality.FEATURES))) * 3
    model = quality.fit(x, (x[:, 9] > 1.5).astype(float), trees=10)
    rows = odd.collect()
    scores = model.predict(quality.statistics(pa.array([r.text for r in rows])))
    held = [r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 4 == 2 for r in rows]
    want = sorted((str(r.doc_id), h, round(s, 9), int(s >= 0.7)) for r, h, s in zip(rows, held, scores.tolist(), strict=True))
    got = sorted((str(r.doc_id), r.held_out, round(r.score, 9), r.predicted) for r in quality.score(odd, model).collect())
    assert got == want
    kept = sorted(str(r) for r, s in zip(rows, scores, strict=True) if s >= 0.7)
    assert sorted(map(str, quality.keep_good(odd, model).collect())) == kept


def test_learning_takes_one_text_of_an_id(spark):
    """Whatever the order of rows."""
    rows = [(i, junk(i) if i % 3 else prose(40, i)) for i in range(60)] + [(i, prose(30, 500 + i)) for i in range(60)]
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(60)], "doc_id long, quality int")
    models = [quality.train(spark.createDataFrame(r, "doc_id long, text string").repartition(n), labels) for r, n in ((rows, 2), (rows[::-1], 5))]
    assert all(np.array_equal(getattr(models[0], c), getattr(models[1], c)) for c in ("feature", "threshold", "leaf"))


def test_trees_learn(spark, empty, odd):
    rows = [(i, junk(i) if i % 4 == 0 else prose(40 + i % 50, i), int(i % 4 != 0)) for i in range(600)]
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, q) for i, _, q in rows] * 2 + [(None, 1), (5000, None)], "doc_id long, quality int")
    model = quality.train(docs, labels)
    got = {r.doc_id: r for r in quality.score(docs, model).collect()}
    import zlib

    held = [i for i, _, _ in rows if zlib.crc32(str(i).encode()) % 4 == 2]
    assert [i for i in got if got[i].held_out] and all(got[i].held_out for i in held)
    assert np.mean([got[i].predicted == rows[i][2] for i in held]) > 0.98
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in got.values())
    kept = {r.doc_id for r in quality.keep_good(docs, model).collect()}
    assert kept == {i for i in got if got[i].predicted}
    assert quality.score(odd, model).count() == odd.count() and quality.score(empty, model).count() == 0
    assert quality.keep_good(odd, model).columns == odd.columns
    none = quality.train(docs, labels.limit(0))
    assert quality.keep_good(docs, none).count() == len(rows)


def test_trees_flat_walk_equals_recursion():
    r = np.random.default_rng(0)
    x = r.random((500, 5))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.3)).astype(float)
    m = quality.fit(x, y, trees=20, depth=3)

    def one(row):
        total = m.base
        for f, t, v in zip(m.feature, m.threshold, m.leaf, strict=True):
            n = 0
            while n < len(f):
                n = 2 * n + (2 if row[f[n]] > t[n] else 1)
            total += v[n - len(f)]
        return 1 / (1 + np.exp(-total))

    assert np.allclose(m.predict(x), [one(v) for v in x]) and ((m.predict(x) > 0.5) == y).mean() > 0.95


# --- benchmark

#: A sentence's first word is taken literally, so the name that must stay consistent stands inside.
BENCH = [(0, "Once Anna has 12 apples and gives 5 apples to Ben so how many apples does Anna have now after that"), (1, prose(40, 71)), (2, "too short"), (3, None), (4, "seven words only stand in this item")]


def test_contamination(spark, empty, odd):
    bench = spark.createDataFrame(BENCH, "item_id long, text string")
    pad = lambda i: prose(30, 800 + i)
    rows = [
        (0, pad(0) + " " + BENCH[1][1] + " " + pad(1)),
        (1, "we know once Carl has 31 apples and gives 7 apples to Dora so how many apples does Carl have now after that " + pad(2)),  # new names and numbers
        (2, pad(3)), (3, None), (4, ""), (5, " ".join(BENCH[1][1].split()[10:16]) + " " + pad(4)),
        (6, "xx once Carl has 31 apples and gives 7 apples to Dora so how many apples does Edna have now after that"),  # Anna stands for two
        (7, "then seven words only stand in this item again"), (1, pad(9)),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for few in (4_000_000, 0):  # by a filter in the tasks, and by a shuffle
        got = {(r.doc_id, r.leaked, r.item_ids) for r in decontaminate.contamination(docs, bench, few=few).collect()}
        assert got == {(0, True, "1"), (1, True, "0"), (1, False, ""), (2, False, ""), (3, False, ""), (4, False, ""), (5, False, ""), (6, False, ""), (7, True, "4")}, few
    kept = decontaminate.drop_contaminated(docs, bench)
    assert {r.doc_id for r in kept.collect()} == {1, 2, 3, 4, 5, 6}  # another row of id 1 leaks
    assert decontaminate.contamination(empty, bench).count() == 0
    assert decontaminate.contamination(docs, bench.limit(0)).filter("leaked").count() == 0
    assert decontaminate.drop_contaminated(odd, bench).columns == odd.columns
    blank = spark.createDataFrame([(None, rows[0][1]), (None, "fine"), (9, "fine")], "doc_id long, text string")
    assert sorted(str(r.text) for r in decontaminate.drop_contaminated(blank, bench).collect()) == ["fine", "fine"]


def test_one_odd_slot_vetoes_nothing(spark):
    """Parameters equal by chance on one side, and copies with one of two equal numbers changed."""
    ask = lambda a, b, c: f"we buy {a} apples and also {b} pears at the market so how many fruits do we carry home for {c}"
    long = " ".join(f"7 {w}" if i in (8, 30) else w for i, w in enumerate(prose(40, 72).split()))
    bench = spark.createDataFrame([(0, ask(4, 4, "Anna")), (1, ask(3, 5, "Anna").replace("market", "harbour").replace("buy", "sell").replace("home", "away")), (2, long), (3, "here Anna saw Ben and later Anna told Ben that Anna and Ben were late")], "item_id long, text string")
    rows = [(0, "xx " + ask(3, 7, "Carl")), (1, "xx " + ask(4, 4, "Carl").replace("market", "harbour").replace("buy", "sell").replace("home", "away")), (2, "xx " + long[::-1].replace("7", "9", 1)[::-1]), (3, "xx here Carl saw Dora and later Edna told Finn that Gina and Hugo were late"), (4, prose(60, 73))]
    got = {r.doc_id: (r.leaked, r.item_ids) for r in decontaminate.contamination(spark.createDataFrame(rows, "doc_id long, text string"), bench).collect()}
    assert got == {0: (True, "0"), 1: (True, "1"), 2: (True, "2"), 3: (False, ""), 4: (False, "")}


def test_items_without_literals(spark):
    """Copies of items that are mostly slots are found word for word, other numbers and names in the same places aren't."""
    sums, names, short = "12 7 19 and 3 14 42 then 8 5 3 9 81 729 6561", "we met Anna Ben Carl Dora Edna Finn Gina Hugo Ida Jon Kim Lea Max", "1 1 2 3 5 8"
    other = re.sub(r"[0-9]+", lambda m: str(int(m[0]) + 11), sums)
    bench = spark.createDataFrame([(0, sums), (1, names), (2, short), (3, "17 23 42 99 108 7 7 7 7 7")], "item_id long, text string")
    rows = [(0, f"{prose(20, 1)} {sums} {prose(20, 2)}"), (1, f"{prose(9, 3)} {names} {prose(9, 4)}"), (2, f"so {short} go"), (3, f"xx {other}"), (4, "xx we met Olga Paul Carl Dora Rita Sam Tom Uwe Ida Jon Kim Vera Max")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for few in (4_000_000, 0):
        got = {r.doc_id: r.item_ids for r in decontaminate.contamination(docs, bench, few=few).collect()}
        assert got == {0: "0", 1: "1", 2: "2", 3: "", 4: ""}, few
    assert {r.doc_id for r in decontaminate.drop_contaminated(docs, bench).collect()} == {3, 4}


def test_short_and_number_heavy_items(spark):
    """Every item that stands in a document word for word is found, however short it is and whatever its words are taken for."""
    items = ["What is 17 * 23 ?", "Add 12 34 56 78 90 11 to 5 7 9", "What year was it", "Zweiundvierzig", "1 2", "Der Hund sieht das Haus und die Katze am Abend im Garten", "Anna Ben Carl", "7"]
    bench = spark.createDataFrame([*enumerate(items), (50, ""), (51, None), (52, "  ")], "item_id long, text string")
    rows = [(i, f"{prose(12, 60 + i)} so {t} {prose(9, 90 + i)}") for i, t in enumerate(items)]
    rows += [(100, "what year was he"), (101, "add 13 35 57 79 91 12 to 6 8 8"), (102, "2 1"), (103, None), (104, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    for few in (4_000_000, 0):
        got = {r.doc_id: set(r.item_ids.split(",")) - {""} for r in decontaminate.contamination(docs, bench, few=few).collect()}
        assert all(str(i) in got[i] for i in range(len(items))), got
        assert not any(got[i] for i in range(100, 105)), got
    assert {r.doc_id for r in decontaminate.drop_contaminated(docs, bench).collect()} >= {100, 103, 104}


def test_names_and_nouns():
    kinds = lambda t: decontaminate.Canon().of(Words(pa.array([t])))[2].tolist()
    lit, name = decontaminate.LITERALS, decontaminate.NAME
    assert kinds("wir sehen das Haus von Anna und die Katze") == [lit, lit, lit, lit, lit, name, lit, lit, lit]
    assert kinds("Once Anna ran. Then Ben NASA 5 km") == [lit, name, lit, lit, name, lit, decontaminate.NUMBER, decontaminate.UNIT]


def brute_contamination(rows, items):
    """All displacements of all items over all documents, place by place."""
    from math import ceil

    def tokens(t):
        w = Words(pa.array([t or ""]))
        template, slots, kind, value = decontaminate.Canon().of(w)
        return template.tolist(), slots.tolist(), kind.tolist(), value.tolist()

    out = {}
    told = [(j, tokens(t)) for j, t in items]
    for i, t in rows:
        dt, ds, dk, dv = tokens(t)
        found = {}
        for j, (bt, bs, bk, bv) in told:
            k = min(decontaminate.WINDOW, len(bt))
            for shift in range(-len(bt), len(dt)) if k else []:
                words, literal = set(), set()
                for b in range(len(bt) - k + 1):
                    d = b + shift
                    if d < 0 or d + k > len(dt):
                        continue
                    if dv[d : d + k] == bv[b : b + k]:
                        literal |= set(range(b, b + k))
                        words |= set(range(b, b + k))
                    if bt[b : b + k] == dt[d : d + k] and sum(x == 0 for x in bk[b : b + k]) >= decontaminate.LITERAL:
                        words |= set(range(b, b + k))
                        if ds[d : d + k] == bs[b : b + k]:
                            literal |= set(range(b, b + k))
                        for p in range(b, b + k):
                            if ds[p + shift]:
                                found.setdefault(("places", j, shift), set()).add((p, ds[p + shift], bs[p], bk[p] == decontaminate.NAME))
                places = found.pop(("places", j, shift), set())
                pairs = Counter((n, d, b) for _, d, b, n in places)
                most = lambda x, total: 2 * x > total
                of_d, of_b = Counter(), Counter()
                for (n, d, b), c in pairs.items():
                    of_d[n, d] += c
                    of_b[n, b] += c
                lost = sum(c for (n, d, b), c in pairs.items() if not (most(c, of_d[n, d]) and most(c, of_b[n, b])))
                other = any(n and not (most(max(c for (m, x, _), c in pairs.items() if (m, x) == (n, d)), of_d[n, d]) and most(max(c for (m, _, y), c in pairs.items() if (m, y) == (n, b)), of_b[n, b])) for n, d, b in pairs)
                covered = len(literal) if other else max(len(words) - lost, len(literal))
                if covered >= min(decontaminate.COVER, ceil(len(bt) * decontaminate.SHARE)) and covered:
                    found[j] = max(found.get(j, 0), covered)
        out[i] = (",".join(map(str, sorted(found))), max(found.values(), default=0))
    return out


def test_contamination_equals_brute_force(spark):
    import random

    r = random.Random(31)
    word = lambda: r.choice(["Anna", "Ben", "Carl", "7", "12", "km", "the", "Hund", "w1", "w2", "w3", "w4", "w5", "w6.", "w7", "sees"])
    items = [(j, " ".join(word() for _ in range(r.choice([1, 3, 6, 9, 14, 25])))) for j in range(12)]
    rows = []
    for i in range(60):
        words = items[r.randrange(12)][1].split() if i % 3 else [word() for _ in range(30)]
        swap = {w: word() for w in ("Anna", "Ben", "7", "12")} if i % 2 else {}
        words = [swap.get(w, w) if r.random() < 0.95 else word() for w in words]
        rows.append((i, " ".join(["x", *words, "y"] + [word() for _ in range(i % 4)])))
    want = brute_contamination(rows, items)
    docs, bench = spark.createDataFrame(rows, "doc_id long, text string").repartition(3), spark.createDataFrame(items, "item_id long, text string")
    got = {x.doc_id: (x.item_ids, x.covered) for x in decontaminate.contamination(docs, bench).collect()}
    key = lambda v: (",".join(sorted(v[0].split(","), key=int)) if v[0] else "", v[1])
    assert {i: key(v) for i, v in got.items()} == {i: key(v) for i, v in want.items()}
    assert 10 < sum(bool(v[0]) for v in want.values())


def test_contamination_of_odd_rows(spark, odd):
    """Null and repeated ids, of documents and items, and rows of one id with different texts."""
    item = prose(20, 7)  # the first words of the odd table's text
    bench = spark.createDataFrame([(None, item), (5, item), (5, "wholly other words that nobody wrote")], "item_id long, text string")
    got = sorted((str(r.doc_id), r.leaked, r.n_items, r.item_ids) for r in decontaminate.contamination(odd, bench).collect())
    text = {r.text for r in odd.collect() if r.text and item in r.text}
    assert got == sorted((str(r.doc_id), r.text in text, 2 if r.text in text else 0, "5" if r.text in text else "") for r in odd.collect())
    kept = decontaminate.drop_contaminated(odd, bench)
    assert kept.columns == odd.columns and sorted(map(str, kept.collect())) == sorted(str(r) for r in odd.collect() if r.text not in text)
    both = spark.createDataFrame([(1, f"a {item} b"), (1, "clean"), (1, None), (None, item), (None, "clean")], "doc_id long, text string")
    assert sorted((str(r.doc_id), str(r.text)) for r in decontaminate.drop_contaminated(both, bench).collect()) == [("1", "None"), ("1", "clean"), ("None", "clean")]
    assert decontaminate.drop_contaminated(both.select("doc_id"), bench).count() == 5


# --- personal data

KINDS = [("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"), ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]")]


def plain(text):
    out = []
    for k, (kind, pattern) in enumerate(KINDS):
        for m in re.finditer(pattern, text):
            d = re.sub("[^0-9]", "", m[0])
            ok = {"email": True, "ip": kind != "ip" or all(int(p) <= 255 for p in m[0].split(".")), "card": 14 <= len(d) <= 19 and pii.luhn(d), "phone": 10 <= len(d) <= 15}[kind]
            if ok:
                out.append((m.start(), k, m.end()))
    return sorted(out)


def test_base_spans_equal_patterns():
    import random

    r = random.Random(4)
    texts = ["a@b.c@d.e.f", "x@y @z.w a..b@c-d.e", "1.2.3.4.5.6.7.8", "256.1.1.1 1.1.1.1", "4111 1111 1111 1111 and 4111-1111-1111-1112", "+1 (555) 123-4567 +12345678901234567", "é a@b.co +4 ..  5"]
    texts += ["".join(r.choice("a1.@+- 4(") for _ in range(60)) for _ in range(3000)]
    texts += ["".join(r.choice("0123456789 -.") for _ in range(80)) for _ in range(1000)]
    for t in texts:
        assert pii.base_spans(t) == plain(t), t
    assert pii.base_spans("a" * 200_000 + "1" * 200_000) == []


def near_words(text, spans, reach):
    """By looking at every word for every span."""
    words = [(m.start(), m.end()) for m in re.finditer(r"[^\x20\x09-\x0D]+", text)]
    out = []
    for a, k, b in spans:
        near = [w for w in words if w[1] <= a][-reach:] + [w for w in words if w[0] >= b][:reach]
        named = [(x, y, text[x:y].strip(".,;:!?\"'()[]{}<>|*#$%&").lower()) for x, y in near if not any(c < y and x < d for c, _, d in spans)]
        out.append((a, k, b, [n for n in named if n[2] and not n[2].isdigit()]))
    return out


def test_words_around_entities():
    import random
    import time

    r = random.Random(9)
    for _ in range(300):
        text = " ".join(r.choice(["a@b.co", "+1 555 123 4567", "4111 1111 1111 1111", "1.2.3.4", "word", "Other,", "x" * 300, "7", "...", "(a@b.co)"]) for _ in range(25))
        spans = pii.base_spans(text)
        assert list(pii._around(text, spans, 3)) == near_words(text, spans, 3)
    # many entities, with and without spaces between them, and one endless word
    for text in ("|".join(["a@b.co"] * 30_000), "a@b.co " * 30_000, "a@b.co " + "y" * 1_000_000):
        started = time.time()
        assert sum(1 for _ in pii._around(text, pii.base_spans(text), 6)) == text.count("@")
        assert time.time() - started < 20


def brute_pii(rows, reach=pii.REACH, threshold=pii.THRESHOLD, strong=pii.STRONG, z=pii.DEVIATE):
    """All columns of find_pii by plain loops over distinct texts."""
    from math import log, sqrt

    def bound(hits, n, z):
        p = hits / n
        return (p + z * z / (2 * n) - z * sqrt(p * (1 - p) / n + z * z / (4 * n * n))) / (1 + z * z / n)

    texts = {t or "" for _, t in rows}
    holds, near, has = Counter(), Counter(), Counter()
    for t in texts:
        pairs = {(f"{k}:{t[a:b]}", w) for a, k, b, around in near_words(t, plain(t), reach) for *_, w in around}
        near.update(pairs)
        holds.update({e for e, _ in pairs})
        has.update({w.strip(".,;:!?\"'()[]{}<>|*#$%&").lower() for w in re.findall(r"[^\x20\x09-\x0D]+", t)})
    share = {}
    for (e, w), n in near.items():
        given, prior = bound(n, max(n, has[w]), z), bound(holds[e], max(len(texts), 2), -z)
        s = 1 - log(given) / log(prior) if prior < 1 and given > 0 else 0
        share[w] = max(share.get(w, -9), s)
    names = [k for k, _ in KINDS] + ["term", "strong"]
    out = []
    for i, t in rows:
        base = plain(t or "")
        joined = ",".join(f"{names[k]}:{a}:{b}" for a, k, b in base)
        more = []
        for m in re.finditer(r"[^\x20\x09-\x0D]+", t or ""):
            s = share.get(m[0].strip(".,;:!?\"'()[]{}<>|*#$%&").lower(), -9)
            if s >= threshold and not any(c < m.end() and m.start() < d for c, _, d in base):
                more.append((m.start(), 5 if s >= strong else 4, m.end()))
        out.append((i, *(sum(k == j for _, k, _ in base) for j in range(4)), hashlib.sha256(joined.encode()).hexdigest(), ",".join(f"{names[k]}:{a}:{b}" for a, k, b in sorted(base + more)), len(more)))
    return out


def test_pii_equals_brute_force(spark):
    import random

    r = random.Random(12)
    entities = [f"p{i}@mail{i % 3}.org" for i in range(12)] + ["+49 30 1234567", "10.0.0.7", "4111 1111 1111 1111"]
    rows = []
    for i in range(500):
        words = prose(r.randrange(0, 60), i, vocab=150).split()
        if i % 5 == 0:
            e = r.randrange(len(entities))
            at = r.randrange(len(words) + 1)
            words[at:at] = [f"Name{e}", entities[e], r.choice([f"Ort{e},", "é", "7"])]
        if i % 7 == 0:
            words.append(f"name{r.randrange(len(entities))}")
        rows.append((i, " ".join(words)))
    rows += [rows[5], (None, rows[5][1]), (None, None), (7, ""), (9, rows[10][1]), (9, rows[15][1])]
    want = brute_pii(rows)
    got = [tuple(x) for x in pii.find_pii(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)
    assert any("term:" in x[6] for x in want) and any("strong:" in x[6] for x in want)
    # a term without its entity in the text
    assert any(x[7] and not sum(x[1:5]) for x in want)


def test_pii_of_odd_texts(spark):
    zeros = "0" * 5000
    rows = [(0, f"x {zeros}.1.2.3 y"), (1, "1." * 3 + "9" * 6000), (2, "a@b.co " + "z" * 400_000)]
    got = {x.doc_id: x for x in pii.find_pii(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[0].n_ip == 1 and got[1].n_ip == 0 and got[2].n_email == 1
    # bytes that aren't UTF-8
    bad = spark.sql("SELECT 1L AS doc_id, cast(X'FF2061406222E280'||X'2078406A2E636F20FE' AS string) AS text")
    one = pii.find_pii(bad).first()
    assert (one.n_email, one.spans.split(",")[0]) == (1, "email:8:14")
    assert pii.sanitise(bad).first().text.count("<email>") == 1
    same = spark.createDataFrame([(None, "mail a@b.co now"), (None, "mail a@b.co now"), (1, None), (1, "mail a@b.co now"), (1, "plain")], "doc_id long, text string")
    assert sorted(str(x.text) for x in pii.sanitise(same).collect()) == sorted(["None", "plain", *["mail <email> now"] * 3])


def test_generalised_words():
    assert [pii.generalised(w) for w in ("Rotterdam,", "1,234", "AB-12", "NATO", "office", "--")] == ["<name>", "<number>", "<code>", "<abbreviation>", "<word>", "<mark>"]


def test_disclosing_terms(spark, empty, odd):
    rows = [(i, f"{prose(8, i)} shared{i} clearly Rotterdam office writes boss@secret.org about {prose(8, 50 + i)}") for i in range(8)]
    rows += [(100 + i, prose(20, 900 + i) + " clearly nothing") for i in range(150)]
    rows += [(300, None), (301, ""), (302, "plain words x1@y.zz here")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r for r in pii.find_pii(df).collect()}
    text = dict(rows)
    assert len(got) == len(rows) and got[300].base_sha256 == hashlib.sha256(b"").hexdigest()
    for i in range(8):
        words = {text[i][int(a) : int(b)] for k, a, b in (s.split(":") for s in got[i].spans.split(",")) if k in ("term", "strong")}
        assert {"Rotterdam", "office", "writes"} <= words and "clearly" not in words
        assert [s for s in got[i].spans.split(",") if s.startswith("email")] == [f"email:{a}:{b}" for a, k, b in plain(text[i])]
    assert all(got[i].n_term == 0 for i in got if i >= 100)
    clean = {r.doc_id: r.text for r in pii.sanitise(df).collect()}
    assert "Rotterdam" not in clean[0] and "boss@" not in clean[0] and "<email>" in clean[0] and clean[100] == text[100] and clean[300] is None
    assert len(clean) == len(rows)
    assert pii.find_pii(empty).count() == 0 and pii.find_pii(odd).count() == odd.count()


def term_words(row, text):
    return {text[int(a) : int(b)] for k, a, b in (s.split(":") for s in row.spans.split(",")) if k in ("term", "strong")}


def test_single_sightings_disclose(spark):
    """A name that stands beside one e-mail only, once in the corpus; the words around it are everywhere."""
    rows = [(i, prose(40, i, vocab=60)) for i in range(3000)]
    rows.append((3000, f"{prose(8, 1, vocab=60)} w1 w2 w3 Rotterdam one@lone.org w4 w5 w6 {prose(8, 2, vocab=60)}"))
    got = {r.doc_id: r for r in pii.find_pii(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert term_words(got[3000], dict(rows)[3000]) == {"Rotterdam"} and got[3000].n_term == 1
    assert all(got[i].n_term == 0 for i in range(3000))


def test_copies_hide_no_disclosure(spark):
    """Four texts about an entity, each copied many times over: all counts are of texts, so the verdict is that without copies."""
    rows = [(i, prose(30, i, vocab=60)) for i in range(600)]
    told = [(600 + i, f"{prose(8, 700 + i, vocab=60)} Rotterdam boss@secret.org {prose(8, 800 + i, vocab=60)}") for i in range(4)]
    copies = [(1000 + 100 * k + i, told[i][1]) for k in range(300) for i in range(4)]
    for more in ([], copies):
        df = spark.createDataFrame(rows + told + more, "doc_id long, text string").repartition(4)
        got = pii.find_pii(df).filter("doc_id >= 600").collect()
        text = dict(told + more)
        assert len(got) == len(text) and all(term_words(r, text[r.doc_id]) == {"Rotterdam"} for r in got)


# --- language model


def two_tongues(n=240, words=80):
    """Texts in two languages that share no word but the frequent ones of each, and rare words of either."""
    import random

    r = random.Random(5)
    out = []
    for i in range(n):
        own = "ab"[i % 2]
        out.append(" ".join(f"{own}{r.randrange(12)}" if r.random() < 0.5 else f"{own}rare{r.randrange(4000)}" for _ in range(words)))
    return out


def test_lm_beats_unigrams_on_held_out_texts(spark):
    """With production parameters."""
    from pyspark.sql import functions as F

    df = spark.createDataFrame(list(enumerate(two_tongues())), "doc_id long, text string").repartition(3)
    coded, mass = lm_score.coded_texts(df)
    net = lm_score.train(coded.filter("doc_id % 5 > 0"), mass)
    flat = lm_score.Network.new(len(mass), 4, 2, np.log((mass + 1) / (mass + 1).sum()))
    flat.out[:] = 0
    mean = lambda n: lm_score.score_coded(coded.filter("doc_id % 5 = 0"), n, mass).agg(F.sum("class_likelihood") / F.sum("n_words")).first()[0]
    assert mean(net) > mean(flat) + 0.4


def test_lm_score_equals_brute_force(spark, odd, empty):
    texts = two_tongues(60, 40) + ["", None, "one", " ".join(["a1"] * 30), two_tongues(1, 40)[0]]
    rows = list(enumerate(texts))
    df = spark.createDataFrame([*rows, (None, texts[3]), rows[4]], "doc_id long, text string").repartition(4)
    coded, mass = lm_score.coded_texts(df, per_pack=200)
    net = lm_score.train(coded, mass)
    got = sorted(map(tuple, lm_score.score_coded(coded, net, mass).collect()), key=str)
    counts, classes = Counter(), {}
    for t in [*texts, texts[3], texts[4]]:
        counts.update((t or "").split())
    of = {r.doc_id: (r.classes, r.log_counts) for r in coded.filter("doc_id IS NOT NULL").collect()}
    for i, t in rows:
        for w, c in zip((t or "").split(), of[i][0], strict=True):
            assert classes.setdefault(w, c) == c
        assert of[i][1] == pytest.approx(sum(np.log(counts[w]) for w in (t or "").split()))
    total = Counter()
    for w, n in counts.items():
        total[classes[w]] += n
    assert all(mass[c] == total[c] for c in range(len(mass)))
    top = {w for w, _ in counts.most_common(lm_score.OWN // 2)}
    assert len({classes[w] for w in top}) == len(top) and all(classes[w] < lm_score.OWN for w in top)

    def one(text):
        c, by_class, within = [classes[w] for w in (text or "").split()], 0.0, 0.0
        for i, w in enumerate((text or "").split()):
            near = [c[j] if 0 <= j < len(c) else len(mass) for j in (i - 2, i - 1, i + 1, i + 2)]
            h = np.tanh(net.bias + sum(net.place[p][x] for p, x in enumerate(near)))
            z = h @ net.out + net.prior
            by_class += z[c[i]] - np.log(np.exp(z).sum())
            within += np.log(counts[w] / total[c[i]])
        return len(c), by_class + within, (by_class + within) / max(len(c), 1), by_class

    want = sorted([(i, *one(t)) for i, t in [*rows, (None, texts[3]), rows[4]]], key=str)
    assert [x[:2] for x in got] == [x[:2] for x in want]
    assert np.allclose([x[2:] for x in got], [x[2:] for x in want], atol=1e-3)
    again = sorted(map(tuple, lm_score.score_coded(coded.repartition(7), net, mass).collect()), key=str)
    assert np.allclose([x[2:] for x in got], [x[2:] for x in again], atol=1e-4)  # whatever the batches
    assert lm_score.score(empty).count() == 0
    strange = lm_score.score(odd).collect()
    assert sorted((str(x.doc_id), x.n_words) for x in strange) == sorted((str(x.doc_id), len((x.text or "").split())) for x in odd.collect())
    assert all(x.log_likelihood == 0 == x.per_word for x in strange if not x.n_words)


def test_votes_and_company_equal_brute_force(spark):
    texts = two_tongues(20, 50) + ["", None, "a1"]
    w = Words(pa.array(texts))
    counts = np.bincount(lm_score.cells_of(w.hash), minlength=lm_score.CELLS)
    table = lm_score.probe_table(counts, 10)
    probe = table[lm_score.cells_of(w.hash)]
    near = lm_score.company(spark.createDataFrame([(t,) for t in texts], "text string").repartition(3), table, 10, 3)
    want = np.zeros((10, 10))
    for i in range(len(texts)):
        mine = [p for p in probe[w.first[i] : w.first[i + 1]].tolist() if p < 10]
        for x in range(len(mine)):
            for y in range(x + 1, min(len(mine), x + 4)):
                want[mine[x], mine[y]] += 1
                want[mine[y], mine[x]] += 1
    assert (near == want).all()
    speaks = lm_score.contexts(near, 4)
    got = lm_score.votes(w, probe, speaks, 3)
    for i in range(len(texts)):
        lo, hi = int(w.first[i]), int(w.first[i + 1])
        at = [j for j in range(lo, hi) if probe[j] < 10]
        for j in range(lo, hi):
            before = sum(x < j for x in at)
            assert got[j] == speaks[probe[at[max(0, before - 3) : before + 4]]].sum(0).argmax()


def test_rounds_mask_every_place():
    """With production parameters: each place is a target once, and a pair of words isn't always met in the same round."""
    w = Words(pa.array([prose(400, i, vocab=20) for i in range(20)] + ["", "one", None]))
    seeds = span_hash(w.hash, w.first[:-1], w.first[1:])
    rounds = [lm_score.masked(seeds, w.counts, lm_score.MASK, r) for r in range(lm_score.ROUNDS)]
    assert sorted(np.concatenate(rounds).tolist()) == list(range(len(w.doc)))
    pair = lambda i: (int(w.hash[i]), int(w.hash[i + 1]))
    seen = Counter(pair(i) for i in range(len(w.doc) - 1))
    often = {p for p, n in seen.items() if n >= 16}
    assert len(often) > 50 and all(often <= {pair(i) for i in at if i + 1 < len(w.doc)} for at in rounds)


def test_gradient_is_right():
    r = np.random.default_rng(1)
    net = lm_score.Network.new(5, 4, 1, np.zeros(5))
    net = lm_score.Network(*(a.astype(np.float64) for a in net.arrays()))
    ctx, y = r.integers(0, 6, (2, 7)), r.integers(0, 5, 7)
    moved, before = net.gradients(ctx, y), [a.copy() for a in net.arrays()]
    for which in range(4):
        for spot in list(np.ndindex(before[which].shape))[:6]:
            def loss(e, which=which, spot=spot):
                arrays = [a.copy() for a in before]
                arrays[which][spot] += e
                return -lm_score.Network(*arrays).log_probabilities(ctx, y).mean()

            assert moved[which][spot] == pytest.approx((loss(1e-5) - loss(-1e-5)) / 2e-5, abs=1e-6)
