import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def prose(n, seed, vocab=400):
    r = random.Random(seed)
    return " ".join(f"w{r.randrange(vocab)}{'.' if r.random() < 0.1 else ''}" for _ in range(n))


def corpus(seed=3, n=120):
    """Texts with exact copies, near copies, shared passages, short and empty texts, nulls and repeated rows."""
    r = random.Random(seed)
    base = [prose(r.randrange(1, 160), seed * 1000 + i) for i in range(n)]
    passage = prose(60, 99)
    out = list(base)
    for t in base[:30]:
        out.append(t)
        w = t.split()
        for _ in range(2):
            v = list(w)
            for _ in range(max(1, len(v) // 60)):
                v[r.randrange(len(v))] = f"edit{r.randrange(10**6)}"
            out.append(" ".join(v))
    for i in range(12):
        out.append(f"{prose(20, 5000 + i)} {passage}\n{prose(15, 6000 + i)}")
    out += ["", "   \n\t ", None, None, "one", "ONE", "one two three", "One Two three", "a b c d", "é ñ 漢字 ①", "x" * 3000, prose(9000, 12)]
    r.shuffle(out)
    rows = [(i, t, "en", f"s{i % 3}", len(t or "")) for i, t in enumerate(out)]
    return rows + [rows[0], rows[0], rows[5]]


@pytest.fixture(scope="session")
def rows():
    return corpus()


@pytest.fixture(scope="session")
def docs(spark, rows, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("docs") / "d.parquet")
    spark.createDataFrame(rows, SCHEMA).repartition(5).write.parquet(path)
    return spark.read.parquet(path)


@pytest.fixture(scope="session")
def odd(spark):
    """Null ids, null everything, and extra columns whose names operators use inside."""
    extra = ["key", "_uid", "kept", "p", "cid", "spans", "_row", "keep_id", "score", "shard", "slot", "hits", "c0"]
    text = prose(60, 7)
    data = [(None, text), (None, text), (1, text), (1, text), (2, None), (None, None), (None, ""), (3, "hello world"), (4, prose(50, 8))]
    return spark.createDataFrame([(*d, *(["x"] * len(extra))) for d in data], "doc_id long, text string, " + ", ".join(f"{c} string" for c in extra))


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)
