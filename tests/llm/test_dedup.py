import hashlib
import re
from collections import Counter, defaultdict

import pytest

from lattica.llm import exact_dedup, fm_dedup, jaccard_join, repeats, sharding, suffix_dedup
from lattica.llm.components import connected

from .conftest import prose

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def test_patricia_trie_spills_by_subtree():
    import random

    r = random.Random(1)
    keys = [bytes(r.choice(b"ab") for _ in range(r.randrange(0, 9))) for _ in range(3000)] + [b"prefix" * 50 + bytes([i]) for i in range(200)]
    trie = exact_dedup.PatriciaTrie(lambda a, b: a + b, budget=3000)
    for k in keys:
        trie.insert(k, 1)
    assert trie.spilled
    got = list(trie.items())
    assert len(got) == len({k for k, _ in got}) and dict(got) == Counter(keys)


@pytest.mark.parametrize("keep", ["max", "min"])
@pytest.mark.parametrize("limits", [{}, {"flush_rows": 7, "trie_bytes": 4000}, {"flush_rows": 1, "hot": 1}])
def test_exact_groups(docs, rows, keep, limits):
    got = exact_dedup.exact_groups(docs, keep=keep, **limits).collect()
    groups = defaultdict(list)
    for i, t, *_ in rows:
        groups[t or ""].append(i)
    assert len(got) == len(rows)
    text = {i: t or "" for i, t, *_ in rows}
    best = max if keep == "max" else min
    for r in got:
        t = text[r.doc_id]
        assert (r.keep_id, r.group_size, r.text_sha256) == (best(groups[t]), len(groups[t]), hashlib.sha256(t.encode()).hexdigest())
        assert not r.kept or r.doc_id == r.keep_id
    assert sum(r.kept for r in got) == len(groups)


def test_exact_odd_and_empty(odd, empty):
    got = exact_dedup.exact_groups(odd).collect()
    assert len(got) == odd.count() and sum(r.kept for r in got) == len({r.text_sha256 for r in got})
    assert next(r for r in got if r.kept and r.group_size == 4).doc_id == 1
    kept = exact_dedup.drop_exact_duplicates(odd)
    assert kept.columns == odd.columns and kept.count() == 4
    assert exact_dedup.exact_groups(empty).count() == 0 and exact_dedup.drop_exact_duplicates(empty).count() == 0


def shingles(text):
    w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def components(rows):
    sets = [(i, shingles(t)) for i, t, *_ in rows]
    root = list(range(len(sets)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(sets)):
        for b in range(a):
            x, y = sets[a][1], sets[b][1]
            if x and y and 100 * len(x & y) >= 75 * len(x | y):
                root[max(find(a), find(b))] = min(find(a), find(b))
    low = defaultdict(list)
    for k, (i, _) in enumerate(sets):
        low[find(k)].append(i)
    return sorted((i, len(s), i if not s else min(low[find(k)])) for k, (i, s) in enumerate(sets))


@pytest.mark.parametrize("options", [{}, {"block": 200}, {"bands": jaccard_join.Bands(small=8, slack=1.0)}, {"bands": jaccard_join.Bands(small=400)}])
def test_jaccard_equals_brute_force(docs, rows, options):
    """Also with tiny blocks, with so few segments that bands must be indexed by shingle, and with deletions throughout."""
    got = sorted(map(tuple, jaccard_join.jaccard_groups(docs, **options).collect()))
    assert got == components(rows)


@pytest.mark.parametrize("block", [1 << 19, 700, 90])
def test_large_groups_in_blocks(spark, block):
    """A chain in which only neighbours are linked, a family around one text, and texts that share much with either and are
    linked with none: whatever the blocks, no link is lost and none is made."""
    import random

    r = random.Random(2)
    words = [f"c{i}" for i in range(900)]
    texts = [" ".join(words[9 * i : 9 * i + 100]) for i in range(40)]
    base = prose(120, 77, 5000).split()
    for i in range(40):
        v = list(base)
        for _ in range(i % 4):
            v[r.randrange(len(v))] = f"e{r.randrange(10**6)}"
        texts.append(" ".join(v))
    texts += [" ".join(base[:70] + [f"z{i}{j}" for j in range(30)]) for i in range(6)] + [" ".join(words[100:160] + [f"y{j}" for j in range(40)])]
    r.shuffle(texts)
    rows = [(i, t, "", "", 0) for i, t in enumerate(texts)]
    df = spark.createDataFrame([x[:2] for x in rows], "doc_id long, text string").repartition(3)
    assert sorted(map(tuple, jaccard_join.jaccard_groups(df, block=block).collect())) == components(rows)


def test_sets_that_share_a_name(docs, rows):
    """With names of so few bits, many sets share one."""
    got = sorted(map(tuple, jaccard_join.jaccard_groups(docs, name_bits=7).collect()))
    assert got == components(rows)


def mirrored(levels):
    """Two words of the letters a and b that every polynomial hash modulo 2**64 takes for one."""
    x, y = "a", "b"
    for _ in range(levels):
        x, y = x + y, y + x
    return x, y


def test_words_built_to_collide(spark):
    x, y = mirrored(11)
    base = [f"w{i}" for i in range(60)]
    texts = [" ".join(z if i in (10, 30, 50) else w for i, w in enumerate(base)) for z in (x, y)]
    rows = [(0, texts[0], "", "", 0), (1, texts[1], "", "", 0), (2, texts[0] + " end", "", "", 0)]
    df = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    for operator in (fm_dedup.fm_dedup, suffix_dedup.suffix_dedup):
        assert sorted(map(tuple, operator(df, 35, 8).collect())) == brute_repeats(rows, 35)
        assert [r.n_removed for r in operator(df.filter("doc_id < 2")).collect()] == [0, 0]
    assert sorted(map(tuple, jaccard_join.jaccard_groups(df).collect())) == components(rows)


def test_rows_with_one_key_are_compared():
    import numpy as np

    words = np.array([1, 2, 3, 1, 2, 4, 1, 2, 3, 9, 9, 1, 2], dtype=np.uint32)
    key = np.array([5, 5, 5, 5, 7, 5])
    at, which = repeats.alike(key, words, np.array([0, 3, 6, 9, 9, 11]), np.array([3, 3, 3, 2, 2, 2]))
    assert len(at) == 5 and which[0] == which[2] and len({*which.tolist()}) == 5 and (which[at] == np.arange(5)).all()


def test_segments_of_parts_of_a_text():
    """A long text is looked at in parts: every window has the anchor that it has in one go."""
    import numpy as np
    import pyarrow as pa

    texts = pa.array([prose(300, 1, vocab=30), None, prose(5, 2), prose(200, 3, vocab=20)])

    def windows(s):
        return {(d, w): (int(s.anchor[i]), int(s.hash[i])) for i, d in enumerate(s.doc.tolist()) for w in range(s.first[i], s.last[i] + 1)}

    whole = repeats.Segments(texts, 20, 5)
    for span in (7, 50, 181):
        parts = repeats.Segments(texts, 20, 5, span)
        assert windows(parts) == windows(whole) and len(parts.first) >= len(whole.first)
        assert all((np.diff(parts.number[parts.doc == d]) == 1).all() for d in range(4))


def test_unlinked_sets_meet_few_blocks(spark, monkeypatch):
    """Texts that share one passage, too much to be told apart by segments and too little to be linked, are one large group. Verification gets each set a bounded number of times, and links within the group are found."""
    passage = prose(128, 900, 10**6)
    texts = [f"{prose(64, 700 + i, 10**6)} {passage}" for i in range(40)]
    texts += [t + " end" for t in texts[::10]]
    rows = list(enumerate(texts))
    sent, linked = [], jaccard_join._linked

    def counted(sets, percent):
        sent.append(sets.count())
        return linked(sets, percent)

    monkeypatch.setattr(jaccard_join, "_linked", counted)
    got = jaccard_join.jaccard_groups(spark.createDataFrame(rows, "doc_id long, text string"), block=400)
    assert sorted(map(tuple, got.collect())) == components(rows)
    assert len(sent) == 3 and sent[0] > 30 and sent[2] <= 4 * len(rows)


def test_only_wanted_texts_are_shuffled(spark, docs, rows, monkeypatch):
    """Beyond the number of classes that are broadcast, texts without candidates are left out before the join."""
    through, let = [], jaccard_join._let_through

    def counted(*args):
        through.append(let(*args))
        return through[0]

    monkeypatch.setattr(jaccard_join, "WANTED", 0)
    monkeypatch.setattr(jaccard_join, "_let_through", counted)
    assert sorted(map(tuple, jaccard_join.jaccard_groups(docs).collect())) == components(rows)
    assert 0 < through[0].count() < len(rows) * 0.75


def test_jaccard_odd_and_empty(odd, empty):
    got = jaccard_join.jaccard_groups(odd)
    assert got.count() == odd.count()
    assert {(r.doc_id, r.component_id) for r in got.filter("n_shingles > 10").collect()} == {(None, 1), (1, 1), (4, 4)}
    assert jaccard_join.jaccard_groups(empty).count() == 0
    kept = jaccard_join.one_of_each(odd)
    assert kept.columns == odd.columns and kept.count() == odd.count()


def test_jaccard_without_ids(spark):
    text = " ".join(f"w{i}" for i in range(80))
    df = spark.createDataFrame([(None, text), (None, text + " more words at end"), (7, "other text of some words here")], "doc_id long, text string")
    assert sorted((r.n_shingles, r.component_id) for r in jaccard_join.jaccard_groups(df).collect()) == [(2, 7), (76, None), (80, None)]


def test_one_of_each_keeps_smallest(docs, rows):
    want = {c for _, _, c in components(rows)}
    assert {r.doc_id for r in jaccard_join.one_of_each(docs).collect()} == want


def test_one_of_each_judges_texts_that_share_an_id(spark):
    """One id with a near copy of a smaller id's text and a text of its own: only the near copy goes."""
    near, alone, shared = prose(80, 21), prose(80, 22), prose(80, 23)
    rows = [(1, near), (2, near + " end"), (2, alone), (2, None), (3, shared + " end"), (2, shared), (4, near), (5, prose(40, 24))]
    kept = jaccard_join.one_of_each(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id, r.text or "") for r in kept) == sorted([(1, near), (2, alone), (2, ""), (2, shared), (5, rows[7][1])])


def test_link_sets_sides():
    import numpy as np

    a = np.arange(40, dtype=np.uint64)
    links = jaccard_join.link_sets([1, 2, 3], [a, a[:35], a[:34]], [0, 0, 1])
    assert {frozenset(x) for x in links} <= {frozenset((1, 3)), frozenset((2, 3))} and len(links) == 2


def test_components(spark):
    edges = [(i, i + 1) for i in range(0, 40)] + [(100, 101), (102, 101), (7, 7), (200, 201)]
    frame = spark.createDataFrame(edges, "u long, v long")
    got = {r.node: r.root for r in connected(frame).collect()}
    assert {r.node: r.root for r in connected(frame, heavy=3).collect()} == got
    assert {r.node: r.root for r in connected(frame, heavy=1, most=4, local=5).collect()} == got
    assert {r.node: r.root for r in connected(frame, heavy=3, local=9).collect()} == got
    assert all(got[i] == 0 for i in range(41)) and got[102] == 100 and got[201] == 200 and len(got) == 41 + 3 + 2
    assert connected(spark.createDataFrame([], "u long, v long")).count() == 0


def brute_repeats(rows, length):
    words = [(t or "").encode().split() for _, t, *_ in rows]
    seen = Counter(tuple(w[i : i + length]) for w in words for i in range(len(w) - length + 1))
    out = []
    for (doc_id, *_), w in zip(rows, words, strict=True):
        gone = set()
        for i in range(len(w) - length + 1):
            if seen[tuple(w[i : i + length])] > 1:
                gone.update(range(i, i + length))
        kept = b" ".join(x for i, x in enumerate(w) if i not in gone)
        out.append((doc_id, len(w), len(gone), hashlib.sha256(kept).hexdigest()))
    return sorted(out)


@pytest.mark.parametrize("operator", [fm_dedup.fm_dedup, suffix_dedup.suffix_dedup])
@pytest.mark.parametrize("length, anchor, hot", [(35, 8, 2000), (12, 3, 3), (40, 10, 1)])
def test_repeats_equal_brute_force(docs, rows, operator, length, anchor, hot):
    got = sorted(map(tuple, operator(docs, length, anchor, hot=hot).collect()))
    assert got == brute_repeats(rows, length)
    assert any(r[2] for r in got)


@pytest.mark.parametrize("operator", [fm_dedup.fm_dedup, suffix_dedup.suffix_dedup])
@pytest.mark.parametrize("hot, per_pack", [(2000, 1), (5, 40)])
def test_repeats_of_a_hot_passage_in_many_packs(spark, operator, hot, per_pack):
    passage = " ".join(f"p{i}" for i in range(30))
    rows = [(i, f"{i} a{i} {passage} b{i % 7} " + (f"{passage} {passage}" if i % 5 == 0 else "")) for i in range(90)]
    rows += [rows[4], rows[4], (200, passage), (201, passage)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = sorted(map(tuple, operator(df, 12, 4, hot=hot, per_pack=per_pack).collect()))
    assert got == brute_repeats(rows, 12) and all(r[2] for r in got)


@pytest.mark.parametrize("operator", [fm_dedup.fm_dedup, suffix_dedup.suffix_dedup])
def test_repeats_within_a_text_and_odd(spark, odd, empty, operator):
    lines = " ".join(["a b c d"] * 30)
    df = spark.createDataFrame([(1, lines), (2, "a b c " + "z " * 300)], "doc_id long, text string")
    want = brute_repeats([(1, lines), (2, "a b c " + "z " * 300)], 10)
    assert sorted(map(tuple, operator(df, 10, 3).collect())) == want
    full = operator(odd, 20, 5, with_text=True).collect()
    assert len(full) == odd.count() and next(r for r in full if r.doc_id == 4).kept_text == odd.filter("doc_id = 4").first().text
    assert operator(empty).count() == 0


def test_fm_index_ranges():
    import numpy as np

    r = np.random.default_rng(0)
    symbols = r.integers(1, 6, 400)
    n = np.array([100, 150, 150])
    index = fm_dedup.FMIndex(symbols, np.array([0, 100, 250]), n, 5)
    texts = [symbols[:100].tolist(), symbols[100:250].tolist(), symbols[250:].tolist()]
    for _ in range(60):
        p = r.integers(1, 6, r.integers(1, 5)).tolist()
        lo, hi = np.array([0]), np.array([index.n])
        for s in reversed(p):
            lo, hi = index.extend(np.array([s]), lo, hi)
        assert hi[0] - lo[0] == sum(t[i : i + len(p)] == p for t in texts for i in range(len(t)))


@pytest.mark.parametrize("shards", [1, 5, 24])
def test_sharding_rows_law(docs, rows, shards):
    got = sharding.assign_shards(docs, shards).collect()
    assert len(got) == len(rows)
    by = defaultdict(list)
    for r in got:
        by[r.shard].append(r.slot)
    sizes = [len(by[s]) for s in range(shards)]
    assert max(sizes) - min(sizes) <= 1 and all(sorted(v) == list(range(len(v))) for v in by.values())
    import zlib

    text = {i: t or "" for i, t, *_ in rows}
    assert all((r.size, r.text_crc32) == (len(text[r.doc_id].encode()) + 8, zlib.crc32(text[r.doc_id].encode())) for r in got)


def test_sharding_bounded_loads_move_little(spark, odd, empty):
    df = spark.range(4000).selectExpr("id AS doc_id", "'t' AS text")
    a = {r.doc_id: r.shard for r in sharding.assign_shards(df, 10, epsilon=0.25).collect()}
    b = {r.doc_id: r.shard for r in sharding.assign_shards(df, 11, epsilon=0.25).collect()}
    loads = Counter(a.values())
    assert max(loads.values()) <= 500 and sum(a[i] != b[i] for i in a) < 1600
    assert sharding.assign_shards(odd, 3).count() == odd.count()
    assert sharding.assign_shards(empty, 3).count() == 0


def test_sharding_of_odd_rows(odd):
    """By value: sizes and checksums of null and empty texts, null ids spread, slots gapless."""
    import zlib

    got = sharding.assign_shards(odd, 4).collect()
    text = lambda r: (r.text or "").encode()
    assert sorted((str(r.doc_id), r.size, r.text_crc32) for r in got) == sorted((str(r.doc_id), len(text(r)) + 8, zlib.crc32(text(r))) for r in odd.collect())
    by = defaultdict(list)
    for r in got:
        by[r.shard].append(r.slot)
    assert sorted(map(len, by.values())) == [2, 2, 2, 3] and all(sorted(v) == list(range(len(v))) for v in by.values())


def test_long_texts(spark):
    """One text of some megabytes beside short ones, with a passage that they share."""
    passage = prose(60, 5)
    long = " ".join(f"v{i % 99991}" for i in range(400_000)) + " " + passage
    rows = [(0, long, "", "", 0), (1, f"a b {passage} c", "", "", 0), (2, long + " end", "", "", 0), (3, long, "", "", 0)]
    df = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    assert sorted(map(tuple, suffix_dedup.suffix_dedup(df).collect())) == brute_repeats(rows, 40)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.jaccard_groups(df).collect()}
    assert {i: c for i, (_, c) in got.items()} == {0: 0, 1: 1, 2: 0, 3: 0} and got[0][0] == len(shingles(long))
    assert {r.doc_id: (r.keep_id, r.group_size) for r in exact_dedup.exact_groups(df).collect()} == {0: (3, 2), 1: (1, 1), 2: (2, 1), 3: (3, 2)}


def test_one_more_shard_moves_little_without_slack(spark):
    """The law `rows` leaves no slack: counts are at most one apart for 24 and for 25 shards."""
    df = spark.range(20_000).selectExpr("id AS doc_id", "'t' AS text")
    a, b = ({r.doc_id: r.shard for r in sharding.assign_shards(df, n).collect()} for n in (24, 25))
    assert all(max(c) - min(c) <= 1 for c in (Counter(a.values()).values(), Counter(b.values()).values()))
    assert sum(a[i] != b[i] for i in a) < 0.15 * len(a)


def test_ring_replay_equals_key_by_key():
    counts = {(c, 0): n for c, n in zip(range(0, 64, 3), [5, 0, 9, 1, 30, 2, 2, 8, 1, 1, 4, 4, 0, 7, 3, 3, 3, 9, 1, 2, 2, 2], strict=True) if n}
    total = sum(counts.values())
    caps = sharding.capacities(total, 5, 0.0)
    pieces = sharding.place(counts, 5, caps, nodes=4, cells=64)
    stops = sharding.ring(5, 4, 64)
    used, want = [0] * 5, []
    for (cell, part), n in sorted(counts.items()):
        for rank in range(n):
            line = [(c, s) for c in [*range(cell, 64), *range(cell)] for s in stops[c]]
            s = next(s for _, s in line if used[s] < caps[s])
            want.append((cell, part, rank, s))
            used[s] += 1
    got = [(c, p, r, s) for c, p, a, b, s, _ in pieces for r in range(a, b)]
    assert sorted(got) == sorted(want)
