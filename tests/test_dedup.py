"""Duplicates against the rule run one article at a time."""

import random
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from presswork.operators import audit, dedup, similarity
from presswork.operators.tables import apply_duplicates

SCHEMA = T.StructType(
    [
        T.StructField("article_id", T.LongType()),
        T.StructField("category_id", T.IntegerType()),
        T.StructField("source_id", T.IntegerType()),
        T.StructField("published_at", T.TimestampNTZType()),
        T.StructField("vec", T.ArrayType(T.FloatType())),
    ]
)
START = datetime(2024, 3, 1)


def one_at_a_time(rows, t):
    out = {}
    for category in {r[1] for r in rows}:
        reps = []
        for r in sorted((r for r in rows if r[1] == category), key=lambda r: (r[3], r[0])):
            v = np.array(r[4], dtype=np.float32).astype(float)
            v = v / (np.linalg.norm(v) or 1)
            hit = next((a for a, s, w in reps if s != r[2] and w @ v >= t), None)
            if hit is None:
                reps.append((r[0], r[2], v))
            else:
                out[r[0]] = hit
    return out


def clustered(n, clusters, dim, sources, noise, seed, copies=0.3, times=50):
    """Noisy clusters, many exact copies of one vector, equal times and a zero vector."""
    rnd = np.random.default_rng(seed)
    centres = rnd.normal(size=(clusters, dim))
    hot = centres[0] / np.linalg.norm(centres[0])
    rows = []
    for i in range(n):
        v = hot if rnd.random() < copies else centres[rnd.integers(clusters)] + noise * rnd.normal(size=dim)
        if i == 5:
            v = np.zeros(dim)
        rows.append(
            (
                i,
                int(rnd.integers(1, 3)),
                int(rnd.integers(1, sources + 1)),
                START + timedelta(minutes=int(rnd.integers(times))),
                [float(x) for x in v],
            )
        )
    return rows


@pytest.mark.parametrize(
    "tile_rows, pivots, t, noise",
    [(10_000, 256, 0.75, 0.5), (16, 256, 0.75, 0.5), (16, 5, 0.6, 1.0), (16, 256, 0.95, 0.2), (7, 3, 0.2, 2.0)],
)
def test_equals_sequential_rule(spark, monkeypatch, tile_rows, pivots, t, noise):
    monkeypatch.setattr(similarity, "MAX_TILE_ROWS", tile_rows)
    monkeypatch.setattr(similarity, "MAX_PIVOTS", pivots)
    monkeypatch.setattr(similarity, "_STEP", 9)
    rows = clustered(300, 12, 8, 4, noise, seed=tile_rows + pivots)
    got = dedup.elect_duplicates(spark.createDataFrame(rows, SCHEMA), t).collect()
    assert {r.duplicate_id: r.representative_id for r in got} == one_at_a_time(rows, t)
    assert len(got) == len({r.duplicate_id for r in got})


@pytest.mark.parametrize("listed, links", [(1, 0), (2, 500_000), (3, 40), (16, 0)])
def test_short_lists_and_rounds_change_nothing(spark, monkeypatch, listed, links):
    monkeypatch.setattr(dedup, "LISTED", listed)
    monkeypatch.setattr(dedup, "SETTLE_LINKS", links)
    monkeypatch.setattr(similarity, "MAX_TILE_ROWS", 40)
    rows = clustered(160, 9, 8, 4, 0.6, seed=listed)
    got = dedup.elect_duplicates(spark.createDataFrame(rows, SCHEMA), 0.6).collect()
    assert {r.duplicate_id: r.representative_id for r in got} == one_at_a_time(rows, 0.6)


def test_long_chain_is_settled_on_ids(spark, monkeypatch):
    """2,000 articles, each like its neighbours in time only; vectors are compared once."""
    rnd = np.random.default_rng(7)
    steps = rnd.normal(size=(2001, 256))
    vecs = (steps[:-1] + steps[1:]).astype(np.float32).tolist()
    rows = [(i, 1, i % 2 + 1, START + timedelta(minutes=i), v) for i, v in enumerate(vecs)]
    compared = []
    plain = dedup.first_neighbours
    monkeypatch.setattr(dedup, "first_neighbours", lambda *a: compared.append(1) or plain(*a))
    monkeypatch.setattr(dedup, "first_hits", None)
    got = dedup.elect_duplicates(spark.createDataFrame(rows, SCHEMA), 0.3).collect()
    assert {r.duplicate_id: r.representative_id for r in got} == {i: i - 1 for i in range(1, 2000, 2)}
    assert compared == [1]


@pytest.mark.parametrize("pivots", [1, 256])
def test_each_pair_of_nodes_meets_once(spark, monkeypatch, pivots):
    monkeypatch.setattr(similarity, "MAX_TILE_ROWS", 10)
    monkeypatch.setattr(similarity, "MAX_PIVOTS", pivots)
    rows = clustered(150, 6, 8, 4, 1.0, seed=31, copies=0.0)
    nodes = dedup._distinct_copies(dedup._keyed(spark.createDataFrame(rows, SCHEMA)))
    placed = similarity.place(nodes, 0.3)
    sides = []
    monkeypatch.setattr(similarity, "_meet", lambda left, right, _: sides.append((left, right)) or left)
    monkeypatch.setattr(similarity, "_first", lambda hits, _: hits)
    similarity.first_neighbours(placed, 0.3, True)
    left, right = (side.select(*similarity._KEY, "node_id").collect() for side in sides[0])
    tiles = {}
    for r in right:
        tiles.setdefault(tuple(r)[:5], []).append(r.node_id)
    met = {}
    for r in left:
        for other in tiles.get(tuple(r)[:5], []):
            pair = (min(r.node_id, other), max(r.node_id, other))
            met[pair] = met.get(pair, 0) + (1 if pair[0] != other or not (r.own and r.anchor_tile == r.probe_tile) else 0)
    assert max(met.values()) == 1


def test_similar_pairs(spark, monkeypatch):
    monkeypatch.setattr(similarity, "MAX_TILE_ROWS", 20)
    rows = clustered(200, 10, 8, 3, 0.8, seed=3)
    unit = {r[0]: np.float32(r[4]).astype(float) / (np.linalg.norm(np.float32(r[4]).astype(float)) or 1) for r in rows}
    want = {}
    for r in rows:
        earlier = sorted(
            (
                (o[3], o[0])
                for o in rows
                if o[1] == r[1] and o[2] != r[2] and (o[3], o[0]) < (r[3], r[0])
                and unit[o[0]] @ unit[r[0]] >= 0.7
            )
        )
        if earlier:
            want[r[0]] = (earlier[0][1], round(unit[earlier[0][1]] @ unit[r[0]], 6))
    got = dedup.similar_pairs(spark.createDataFrame(rows, SCHEMA), 0.7).collect()
    assert {r.article_id: (r.first_similar_id, round(r.similarity, 6)) for r in got} == want


def test_cells_rule_out_work(spark, monkeypatch):
    """Tight clusters: probes visit few of the cells, and still nothing is missed."""
    monkeypatch.setattr(similarity, "MAX_TILE_ROWS", 10)
    rows = clustered(400, 30, 16, 4, 0.05, seed=11, copies=0.0)
    nodes = dedup._distinct_copies(dedup._keyed(spark.createDataFrame(rows, SCHEMA)))
    placed = similarity.place(nodes, 0.9)
    n_cells = placed.select("anchor.cell").distinct().count()
    visits = placed.agg(F.avg(F.size("visits"))).first()[0]
    assert n_cells > 20 and visits < 0.5 * n_cells


def test_hot_copies_shrink_to_one_node_per_source(spark):
    vec = [0.6, 0.8]
    rows = [(i, 1, i % 3, START + timedelta(minutes=i), vec) for i in range(3000)]
    df = spark.createDataFrame(rows, SCHEMA)
    assert dedup._distinct_copies(dedup._keyed(df)).count() == 3
    got = {r.duplicate_id: r.representative_id for r in dedup.elect_duplicates(df, 0.75).collect()}
    # Source 0 is first: its own later copies are not compared with it.
    assert got == {i: 0 for i in range(3000) if i % 3}


def test_chain_takes_many_rounds(spark):
    """Each article resembles only its neighbours in time: every second one is a duplicate."""
    rows = []
    for i in range(24):
        angle = i * 0.5
        rows.append((i, 1, i % 2 + 1, START + timedelta(minutes=i), [float(np.cos(angle)), float(np.sin(angle))]))
    rows = rows[:12]  # under one turn
    got = dedup.elect_duplicates(spark.createDataFrame(rows, SCHEMA), 0.85).collect()
    assert {r.duplicate_id: r.representative_id for r in got} == one_at_a_time(rows, 0.85)


def test_threshold_is_checked(spark):
    df = spark.createDataFrame(clustered(10, 2, 4, 2, 0.1, 1), SCHEMA)
    with pytest.raises(ValueError):
        dedup.elect_duplicates(df, 0.0)


def test_result_properties_and_second_run(spark):
    rows = clustered(200, 8, 8, 4, 0.4, seed=21)
    df = spark.createDataFrame(rows, SCHEMA)
    pairs = dedup.elect_duplicates(df, 0.75)
    by_id = {r[0]: r for r in rows}
    got = pairs.collect()
    duplicates = {r.duplicate_id for r in got}
    for r in got:
        d, rep = by_id[r.duplicate_id], by_id[r.representative_id]
        assert rep[0] not in duplicates
        assert (rep[3], rep[0]) < (d[3], d[0]) and rep[2] != d[2] and rep[1] == d[1]
    flags = df.selectExpr(
        "article_id", "false as is_duplicate", "cast(null as bigint) as representative_id"
    )
    once = apply_duplicates(flags, pairs)
    twice = apply_duplicates(once, pairs)
    assert sorted(map(tuple, once.collect())) == sorted(map(tuple, twice.collect()))
    assert once.filter("is_duplicate").count() == len(duplicates)
    assert audit.representative_chains(once).count() == 0


def test_random_order_of_input_does_not_matter(spark):
    rows = clustered(120, 6, 8, 3, 0.5, seed=5)
    shuffled = rows[:]
    random.Random(1).shuffle(shuffled)
    a, b = (
        {(r.duplicate_id, r.representative_id) for r in dedup.elect_duplicates(spark.createDataFrame(x, SCHEMA), 0.7).collect()}
        for x in (rows, shuffled)
    )
    assert a == b
