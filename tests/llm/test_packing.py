import random

import pytest
from pyspark.sql import functions as F

from presswork.llm import packing
from tests.llm import cases

COSTS = {x: packing.default_cost(x) for x in packing.LENGTHS}


def brute_pack(sizes, costs):
    """Each limit in turn, with a plain search for the tightest bin; cost of the best."""
    best = None
    for limit in sorted(costs):
        bins, rest = [], sum(sizes)
        for size in sizes:
            open_ = [(b[0] - b[1], i) for i, b in enumerate(bins) if b[0] - b[1] >= size]
            if open_:
                bins[min(open_)[1]][1] += size
            else:
                fit = [c for c in sorted(costs) if c >= size]
                allowed = [c for c in fit if c <= limit] or fit[:1]
                length = min(allowed, key=lambda c: (costs[c] / min(c, rest), c))
                bins.append([length, size])
            rest -= size
        cost = sum(min(costs[c] for c in costs if c >= fill) for _, fill in bins)
        best = cost if best is None else min(best, cost)
    return best


@pytest.mark.parametrize("seed", range(12))
def test_cost_is_that_of_a_plain_search(seed):
    rnd = random.Random(seed)
    costs = COSTS if seed % 2 else {7: 8.0, 10: 10.5, 20: 23.0}
    top = max(costs)
    sizes = sorted((rnd.randint(1, rnd.choice([top, top // 4])) for _ in range(150)), reverse=True)
    bins, capacity, fills = packing.pack_pieces(sizes, costs)
    own = [0] * len(fills)
    for at, size in zip(bins, sizes):
        own[at] += size
    assert own == fills and all(f <= c for f, c in zip(fills, capacity))
    for fill, c in zip(fills, capacity):
        assert costs[c] == min(costs[x] for x in costs if x >= fill)
    assert sum(costs[c] for c in capacity) == pytest.approx(brute_pack(sizes, costs))


def check_plan(rows, docs, costs):
    want = sorted((d, n or 0) for d, n in docs)
    pieces, bins = {}, {}
    for r in rows:
        pieces.setdefault(r.doc_id, []).append(r)
        if r.bin_id is not None:
            bins.setdefault(r.bin_id, []).append(r)
    got = sorted((d, sum(r.n_tokens for r in rs)) for d, rs in pieces.items())
    assert got == want
    for rs in pieces.values():
        at = 0
        for r in sorted(rs, key=lambda r: r.piece):
            assert r.start == at
            at += r.n_tokens
    for rs in bins.values():
        at = 0
        for r in sorted(rs, key=lambda r: r.bin_start):
            assert r.bin_start == at and r.capacity == rs[0].capacity and r.fill == rs[0].fill
            at += r.n_tokens
        assert at == rs[0].fill <= rs[0].capacity
        assert rs[0].capacity == min((c for c in costs if c >= at), key=lambda c: costs[c])
    assert all((r.bin_id is None) == (r.n_tokens == 0) for r in rows)


@pytest.mark.parametrize("per_task", [50, 100_000])
def test_plan(spark, per_task):
    rnd = random.Random(1)
    docs = [(i, rnd.choice([0, 3, 100, 511, 512, 700, 5_000, 8_192, 8_193, 40_000])) for i in range(400)]
    docs += [(1_000, None), (1_001, -5)]
    df = spark.createDataFrame(docs, "doc_id long, n_tokens long")
    rows = packing.pack(df, per_task=per_task).collect()
    check_plan(rows, [(d, max(n or 0, 0)) for d, n in docs], COSTS)
    if per_task == 100_000:
        sizes = sorted((r.n_tokens for r in rows if r.n_tokens), reverse=True)
        cost = sum(COSTS[c] for c in {r.bin_id: r.capacity for r in rows if r.bin_id is not None}.values())
        assert cost == pytest.approx(brute_pack(sizes, COSTS))


def test_odd_rows(spark):
    docs = cases.clashing(spark, ["piece", "start", "bin_id", "total", "at"]).withColumn(
        "n_tokens", F.length("text").cast("long")
    )
    rows = packing.pack(docs).collect()
    used = sum(len(r[1] or "") for r in cases.ROWS)
    assert sum(r.n_tokens for r in rows) == used
    # Repeated rows are packed as often as they occur.
    assert len([r for r in rows if r.doc_id == 2]) == 2
    assert packing.pack(docs.filter("doc_id = 4")).collect()[0].bin_id is None
    assert packing.pack(docs.filter(F.lit(False))).count() == 0


def test_query_is_well_packed(spark):
    from presswork.llm.queries import QUERIES

    rows = QUERIES["op8_pack"](spark, "/root/testdata/sf0.01").collect()
    bins = {r.bin_id: (r.fill, r.capacity) for r in rows if r.bin_id is not None}
    assert sum(f for f, _ in bins.values()) / sum(c for _, c in bins.values()) > 0.97
