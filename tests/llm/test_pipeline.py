import hashlib
from collections import defaultdict

import numpy as np
import pytest

import corpus_pipeline
from lattica.llm import quality, queries
from lattica.llm.sentencepiece_codec import Codec, default_model

from .conftest import SCHEMA, corpus, prose
from .test_dedup import components, shingles
from .test_text import junk

BENCH = [(i, prose(30, 40_000 + i)) for i in range(4)]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("sf"))
    rows = [r for r in dict((r[0], r) for r in corpus(5, 150)).values()]
    n = len(rows)
    rows += [(n + i, junk(i), "en", "s", 0) for i in range(60)]
    rows += [(n + 60 + i, f"{prose(50, 7000 + i)} {BENCH[i % 4][1]} {prose(40, 8000 + i)}", "en", "s", 0) for i in range(10)]
    labels = [(r[0], int("!!" not in (r[1] or ""))) for r in rows]
    spark.createDataFrame(rows, SCHEMA).repartition(4).write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(*x, 0) for x in labels], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    spark.createDataFrame(BENCH, "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    return d


def test_stages_equal_brute_force(spark, folder, tmp_path):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    model = quality.train(docs, spark.read.parquet(f"{folder}/labels.parquet"))
    scores = {r.doc_id: r.predicted for r in quality.score(docs, model).collect()}
    now = {r.doc_id: tuple(r) for r in docs.collect()}
    assert np.mean([scores[i] == int("!!" not in (now[i][1] or "")) for i in now]) > 0.97
    want = [dict(), dict(), dict(), dict()]
    want[0] = {i: r for i, r in now.items() if scores[i]}
    groups = defaultdict(list)
    for i, r in want[0].items():
        groups[r[1] or ""].append(i)
    want[1] = {max(v): want[0][max(v)] for v in groups.values()}
    low = {i: c for i, _, c in components(list(want[1].values()))}
    want[2] = {i: r for i, r in want[1].items() if low[i] == i}
    grams = {tuple(t.lower().split()[k : k + 8]) for _, t in BENCH for k in range(23)}
    leaks = lambda t: any(tuple(w[k : k + 8]) in grams for w in [(t or "").lower().split()] for k in range(len(w) - 7))
    want[3] = {i: r for i, r in want[2].items() if not leaks(r[1])}
    assert len(want[3]) < len(want[2]) < len(want[1]) < len(want[0]) < len(now)
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, folder)
        if k < 4:
            assert out.columns == docs.columns
            out.write.parquet(f"{tmp_path}/{name}")
            docs = spark.read.parquet(f"{tmp_path}/{name}")
            assert {r.doc_id: tuple(r) for r in docs.collect()} == want[k], name
    codec = Codec.of(default_model())
    for r in out.collect():
        ids = codec.encode([want[3][r.doc_id][1] or ""])[0]
        assert r.token_ids == ids.tolist() and r.round_trip and r.tokens_sha256 == hashlib.sha256(ids.tobytes()).hexdigest()
    assert sorted(r.doc_id for r in corpus_pipeline.run(spark, folder).collect()) == sorted(want[3])
    assert shingles("a b") == {("a", "b")}


@pytest.mark.parametrize("name", sorted(queries.table()))
def test_queries_give_a_row_for_each_document(spark, folder, name):
    out = queries.table()[name](spark, folder)
    n = spark.read.parquet(f"{folder}/documents.parquet").count()
    rows = out.collect()
    if name == "op8_sharding":
        assert {(r.law, r.grown_shard) for r in rows} == {("rows", None)} and {r.shard for r in rows} <= set(range(24))
    assert len(rows) == n and len({r.doc_id for r in rows}) == n


def test_entry_registers_all():
    import __spark_entry__

    names = __spark_entry__.queries()
    assert {int(n[2:].split("_")[0]) for n in names if n.startswith("op")} == set(range(1, 11)) and "pipeline" in names
    assert set(__spark_entry__.oracle_sql()) <= set(names)
