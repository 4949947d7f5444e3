import time
import tracemalloc
from datetime import datetime, timedelta

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from pyspark.sql.classic.dataframe import DataFrame

from presswork.operators import retrieval
from presswork.sources.tables import save_bucketed

NOW = datetime(2024, 3, 10)
EPOCH = datetime(1970, 1, 1)


@pytest.fixture(scope="module")
def world(spark):
    rnd = np.random.default_rng(4)
    articles = [
        (a, int(rnd.integers(1, 4)), int(rnd.integers(1, 4)), NOW - timedelta(hours=int(rnd.integers(500))),
         bool(rnd.random() < 0.9), bool(rnd.random() < 0.1))
        for a in range(80)
    ]
    same = [float(x) for x in rnd.normal(size=6)]
    chunks = []
    for c in range(300):
        vec = [float(x) for x in rnd.normal(size=6)]
        if c % 4 == 0:
            vec = same  # many exact copies
        if c == 17:
            vec = [0.0] * 6
        chunks.append((c, c % 80, f"text {c}", None if c % 29 == 28 else vec))
    queries = [(q, q % 5, same if q == 3 else [float(x) for x in rnd.normal(size=6)]) for q in range(12)]
    queries.append((12, 0, [0.0] * 6))
    prefs = [(u, c, int(rnd.integers(1, 11))) for u in range(4) for c in (1, 2)]
    return {
        "articles": articles, "chunks": chunks, "queries": queries, "prefs": prefs,
        "args": (
            spark.createDataFrame(chunks, "chunk_id long, article_id long, content string, embedding array<float>").repartition(5),
            spark.createDataFrame(
                articles,
                "article_id long, source_id int, category_id int, published_at timestamp_ntz, is_processed boolean, is_duplicate boolean",
            ).select("*", F.concat(F.lit("t"), "article_id").alias("title"), F.lit("u").alias("url")),
            spark.createDataFrame([(c, f"c{c}") for c in (1, 2, 3)], "category_id int, name string"),
            spark.createDataFrame([(s, 1, f"s{s}_x") for s in (1, 2, 3)], "source_id int, category_id int, name string"),
            spark.createDataFrame(prefs, "user_id long, category_id int, weight int"),
            spark.createDataFrame(queries, "query_id long, user_id long, vector array<float>"),
            NOW,
        ),
    }


def expected(w, k):
    weights = {(u, c): x for u, c, x in w["prefs"]}
    shown = {a[0]: a for a in w["articles"] if a[4] and not a[5]}
    out = {}
    for q, user, vector in w["queries"]:
        v = np.float32(vector).astype(float)
        scored = []
        for c, article, _, vec in w["chunks"]:
            if vec is None or article not in shown:
                continue
            e = np.float32(vec).astype(float)
            norms = np.linalg.norm(v) * np.linalg.norm(e)
            a = shown[article]
            sim = v @ e / norms if norms else None
            score = None
            if sim is not None:
                recency = (a[3] - EPOCH).total_seconds() / (NOW - EPOCH).total_seconds()
                score = sim * 0.7 + weights.get((user, a[2]), 5) / 10 * 0.2 + recency * 0.1
            key = float("inf") if score is None else -round(score, 12)
            scored.append((key, c, sim))
        out[q] = [(c, None if s is None else round(s, 6)) for _, c, s in sorted(scored, key=lambda x: x[:2])[:k]]
    return out


def collected(rows):
    out = {}
    for r in sorted(rows.collect(), key=lambda r: (r.query_id, r["rank"])):
        found = out.setdefault(r.query_id, [])
        assert r["rank"] == len(found) + 1
        found.append((r.chunk_id, None if r.similarity is None else round(r.similarity, 6)))
    return out


@pytest.mark.parametrize("k", [1, 5, 400])
def test_broadcast(world, k):
    assert collected(retrieval.retrieve(*world["args"], k=k)) == expected(world, k)


@pytest.mark.parametrize("questions, chunks", [(5, 7), (1, 4096), (1024, 1)])
def test_tiles(world, monkeypatch, questions, chunks):
    monkeypatch.setattr(retrieval, "QUESTION_TILE", questions)
    monkeypatch.setattr(retrieval, "CHUNK_TILE", chunks)
    assert collected(retrieval.retrieve(*world["args"], k=5)) == expected(world, 5)


@pytest.mark.parametrize("tile_bytes", [4 * 6 * 20, 1 << 20])
@pytest.mark.parametrize("per_block", [1, 4])
def test_many_questions_never_reach_the_driver(world, per_block, tile_bytes, monkeypatch):
    """No question is lost, however many blocks and tiles it takes."""

    def no_driver(*_):
        raise AssertionError("rows on the driver")

    monkeypatch.setattr(DataFrame, "toArrow", no_driver)
    monkeypatch.setattr(DataFrame, "toPandas", no_driver)
    size = per_block * (8 * 6 + 16)
    got = retrieval.retrieve(*world["args"], k=5, query_bytes=size, tile_bytes=tile_bytes)
    assert collected(got) == expected(world, 5)


def test_weights_count_as_bytes_of_questions(world):
    *_, prefs, queries, _ = world["args"]
    n, size = retrieval._size(retrieval._with_weights(queries, prefs))
    weighted = sum(2 for q in world["queries"] if q[1] < 4)
    assert (n, size) == (13, 13 * (8 * 6 + 16) + 16 * weighted)


def test_scores_do_not_depend_on_batches(world):
    """Bit for bit, so that equal scores rank by chunk id everywhere."""
    chunks, *rest = world["args"]
    rows = [
        sorted(map(tuple, retrieval.retrieve(chunks.repartition(n), *rest, k=9).collect()), key=repr)
        for n in (1, 7)
    ]
    assert rows[0] == rows[1]


def test_no_questions(world):
    *args, queries, now = world["args"]
    assert retrieval.retrieve(*args, queries.limit(0), now).count() == 0


def test_cost_follows_the_matrix_product():
    """Many questions against few chunks: no more than a few times the product itself."""
    rnd = np.random.default_rng(1)
    n, dim = 20_000, 64
    table = pa.table(
        {
            "query_id": np.arange(n),
            "vector": pa.array(list(rnd.normal(size=(n, dim))), pa.list_(pa.float64())),
            "weights": pa.nulls(n, pa.map_(pa.int32(), pa.int32())),
        }
    )
    batches = [
        pa.table(
            {
                "chunk_id": np.arange(at, at + 100),
                "article_id": np.arange(at, at + 100),
                "embedding": pa.array(list(rnd.normal(size=(100, dim))), pa.list_(pa.float64())),
                "category_id": np.ones(100, np.int32),
                "epoch": np.ones(100),
            }
        )
        for at in range(0, 600, 100)
    ]
    best = retrieval._Best(retrieval._Questions(table), 5, 1.0)
    start = time.process_time()
    for batch in batches:
        best.add(batch)
    assert best.hits().num_rows == 5 * n
    spent = time.process_time() - start
    start = time.process_time()
    for _ in range(10):
        best.questions.unit @ rnd.normal(size=(dim, 600))
    assert spent < 10 * (time.process_time() - start) + 5


def test_memory_does_not_follow_questions_times_chunks():
    """Ten times the questions against the same chunks: no matrix of all of them is held."""
    rnd = np.random.default_rng(2)
    peaks = []
    for n in (3_000, 30_000):
        weights = pa.array([[(1, 9)] if i % 2 else None for i in range(n)], pa.map_(pa.int32(), pa.int32()))
        vectors = pa.array(list(rnd.normal(size=(n, 4))), pa.list_(pa.float64()))
        table = pa.table({"query_id": np.arange(n), "vector": vectors, "weights": weights})
        chunks = pa.table(
            {
                "chunk_id": np.arange(4096),
                "article_id": np.arange(4096),
                "embedding": pa.array(list(rnd.normal(size=(4096, 4))), pa.list_(pa.float64())),
                "category_id": (np.arange(4096) % 3).astype(np.int32),
                "epoch": np.ones(4096),
            }
        )
        tracemalloc.start()
        best = retrieval._Best(retrieval._Questions(table), 5, 1.0)
        best.add(chunks)
        peaks.append(tracemalloc.get_traced_memory()[1])
        tracemalloc.stop()
        assert best.hits().num_rows == 5 * n
    assert peaks[1] - peaks[0] < 27_000 * 4096


def test_weights_by_question_and_category():
    weights = pa.array([[(3, 7), (1, 2)], None, [], [(2, 9), (3, 1)]], pa.map_(pa.int32(), pa.int32()))
    vectors = pa.array([[1.0]] * 4)
    found = retrieval._Questions(pa.table({"query_id": range(4), "vector": vectors, "weights": weights}))
    categories = np.array([3, 5, 1, 3])
    want = [[7, 5, 2, 7], [5, 5, 5, 5], [5, 5, 5, 5], [1, 5, 5, 1]]
    assert found.preference(categories, slice(0, 4)).tolist() == want
    assert found.preference(categories, slice(3, 7)).tolist() == want[3:]


def test_bucketed_chunks_stay_where_they_are(spark, world):
    chunks, articles, *rest = world["args"]
    save_bucketed(chunks, "presswork_r_chunks", buckets=4)
    save_bucketed(articles, "presswork_r_articles", buckets=4)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        pool = retrieval.scoring_pool(
            spark.table("presswork_r_chunks"), spark.table("presswork_r_articles"), *rest[:2]
        )
        plan = pool._jdf.queryExecution().executedPlan().toString()
        assert "hashpartitioning" not in plan and "SortMergeJoin" in plan
        got = retrieval.retrieve(
            spark.table("presswork_r_chunks"), spark.table("presswork_r_articles"), *rest, k=5
        )
        assert collected(got) == expected(world, 5)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.sql("DROP TABLE presswork_r_chunks")
        spark.sql("DROP TABLE presswork_r_articles")


def test_sources_keep_each_article_once(world):
    found = retrieval.retrieve(*world["args"], k=40)
    want = {}
    for r in sorted(found.collect(), key=lambda r: (r.query_id, r["rank"])):
        ids = want.setdefault(r.query_id, [])
        if r.article_id not in ids:
            ids.append(r.article_id)
    got = {}
    for r in sorted(retrieval.answer_sources(found).collect(), key=lambda r: (r.query_id, r["rank"])):
        got.setdefault(r.query_id, []).append(r.article_id)
        assert r["rank"] == len(got[r.query_id])
    assert got == want


def test_prompts(spark):
    found = spark.createDataFrame(
        [(1, 2, "Second", "s2_x", datetime(2024, 1, 2), "body 2"), (1, 1, "First", "s1_x", None, "body 1")],
        "query_id long, rank int, title string, source_name string, published_at timestamp_ntz, content string",
    )
    history = spark.createDataFrame(
        [(i, "a", "user" if i % 2 else "assistant", f"m{i}", datetime(2024, 1, 1, 0, i)) for i in range(8)],
        "chat_id long, session_id string, role string, message string, created_at timestamp_ntz",
    )
    questions = spark.createDataFrame(
        [(1, "a", "Why?"), (2, "b", "Nothing known?")], "query_id long, session_id string, question string"
    )
    got = {r.query_id: r for r in retrieval.build_prompts(questions, found, history).collect()}
    talk = "\n\n".join(f"[{'USER' if i % 2 else 'ASSISTANT'}]\nm{i}" for i in range(2, 8))
    assert got[1].prompt == (
        "[SYSTEM]\n" + retrieval.SYSTEM_PROMPT
        + "[1] First (s1_x, )\nbody 1\n\n[2] Second (s2_x, 2024-01-02)\nbody 2\n\n"
        + talk + "\n\n[USER]\nWhy?"
    )
    assert got[1].reply is None
    assert got[2].prompt is None and got[2].reply == retrieval.NOTHING_FOUND
