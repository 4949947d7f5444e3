import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from presswork.llm import forest

SF = "/root/testdata/sf0.01"


def brute(rows, k, wanted):
    """Exact lists: query id -> [(score, id)]."""
    ids = np.array([i for i, _ in rows])
    x = np.array([v for _, v in rows], np.float64)
    out = {}
    for q in np.flatnonzero([wanted(i) for i in ids]):
        scores = np.array([math.fsum(p) for p in x * x[q]])
        order = [j for j in np.lexsort((ids, -scores)) if ids[j] != ids[q]][:k]
        out[int(ids[q])] = [(scores[j], int(ids[j])) for j in order]
    return out


def found(df):
    out = {}
    for r in df.orderBy("query_id", "rank").collect():
        mine = out.setdefault(r.query_id, [])
        assert r["rank"] == len(mine) + 1
        mine.append((r.score, r.vec_id))
    return out


def recall(got, want):
    shares = [len({i for _, i in got.get(q, [])} & {i for _, i in w}) / len(w) for q, w in want.items() if w]
    return sum(shares) / len(shares)


@pytest.mark.parametrize("block_rows", [16_384, 40])
def test_recall_and_exact_scores(spark, block_rows):
    table = spark.read.parquet(f"{SF}/embeddings.parquet")
    rows = [(r.vec_id, r.embedding) for r in table.collect()]
    want = brute(rows, 20, lambda i: i % 20 == 0)
    got = found(forest.nearest(table, F.col("id") % 20 == 0, 20, block_rows=block_rows))
    assert set(got) == set(want)
    assert recall(got, want) >= 0.9
    vec = {i: np.array(v, np.float64) for i, v in rows}
    for q, mine in got.items():
        assert len(mine) == 20 and mine == sorted(mine, key=lambda x: (-x[0], x[1]))
        for score, i in mine:
            assert score == pytest.approx(float(vec[q] @ vec[i]), abs=1e-12) and i != q


def test_clusters_of_any_norm(spark):
    """Where there is structure few candidates are enough, also for unequal norms."""
    rng = np.random.default_rng(4)
    centres = rng.standard_normal((60, 24)) * 3
    x = np.repeat(centres, 50, axis=0) + rng.standard_normal((3_000, 24)) * 0.4
    x *= rng.uniform(0.5, 2.0, (3_000, 1))
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    want = brute(rows, 10, lambda i: i % 20 == 0)
    got = found(forest.nearest(df, F.col("id") % 20 == 0, 10, block_rows=200))
    assert recall(got, want) >= 0.9


def test_odd_vectors(spark):
    rng = np.random.default_rng(5)
    good = [(i, rng.standard_normal(6).tolist()) for i in range(100)]
    same = [(200 + i, [1.0, 2.0, 3.0, 0.0, 0.0, 1.0]) for i in range(70)]
    rows = good + same + [good[3], same[0]]
    odd = [
        (300, None), (320, [0.0] * 6), (340, [1.0, None, 0.0, 0.0, 0.0, 0.0]),
        (360, [float("nan")] * 6), (380, [float("inf")] + [0.0] * 5), (400, [1.0, 2.0]), (420, []),
        (None, [1.0] * 6),
    ]
    schema = "vec_id long, embedding array<double>"
    df = spark.createDataFrame(rows + odd, schema).withColumns(
        {c: F.lit(1) for c in ("id", "key", "vec", "rank", "hash")}
    )
    want = brute(good + same, 20, lambda i: i % 20 == 0)
    got = found(forest.nearest(df, F.col("id") % 20 == 0, 20, target=1.0))
    assert set(got) == set(want)
    assert recall(got, want) >= 0.99
    # A group of equal vectors ranks by id, without the query itself.
    assert [i for _, i in got[200]] == [i for _, i in want[200]]
    assert [i for _, i in got[220]] == [i for _, i in want[220]]
    for part in (df.filter(F.lit(False)), df.filter("vec_id = 320"), df.filter("vec_id = 300")):
        assert forest.nearest(part, F.col("id") % 20 == 0, 20).count() == 0
    few = forest.nearest(df.filter("vec_id in (0, 1, 2)"), F.col("id") % 20 == 0, 20)
    assert [(r.query_id, r["rank"]) for r in few.orderBy("rank").collect()] == [(0, 1), (0, 2)]


def test_tiles_change_nothing(spark, monkeypatch):
    rng = np.random.default_rng(6)
    rows = [(i, rng.standard_normal(8).tolist()) for i in range(400)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    want = brute(rows, 5, lambda i: i % 2 == 0)
    monkeypatch.setattr(forest, "MAX_BLOCK_BITS", 2)
    got = found(forest.nearest(df, F.col("id") % 2 == 0, 5, target=1.0, block_rows=10))
    assert recall(got, want) >= 0.97


def test_common_bits():
    a = np.array([0, 0, 0, 2**64 - 1], np.uint64)
    b = np.array([0, 1, 2**63, 2**64 - 2], np.uint64)
    assert forest._common_bits(a, b).tolist() == [64, 63, 0, 63]
