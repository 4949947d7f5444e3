"""Chains and loops of representatives against walking them one by one."""

import random

import pytest

from presswork.operators import audit

SCHEMA = "article_id long, is_duplicate boolean, representative_id long"


def walk(rows):
    following = {a: r for a, _, r in rows if r is not None}
    out = {}
    for start, first in following.items():
        path, at = [], start
        while at in following and at not in path:
            path.append(at)
            at = following[at]
        if at in following:
            loop = path[path.index(at):]
            out[start] = (first, min(loop), None, True)
        else:
            out[start] = (first, at, len(path), False)
    return out


def tables():
    rnd = random.Random(3)
    chain = [(i, True, i + 1) for i in range(1, 30)] + [(30, False, None)]
    tree = [(100 + i, True, 100 + i // 2) for i in range(1, 60)] + [(100, False, None)]
    loops = [(201, True, 202), (202, True, 203), (203, True, 201), (204, True, 203), (205, True, 204), (206, True, 206)]
    hot = [(1000 + i, True, 7) for i in range(500)]
    missing = [(300, True, 9999), (301, True, 300)]
    wild = [(i, True, rnd.randint(1, 80)) for i in range(1, 81)]
    return [chain + tree + loops + hot + missing, wild, [(1, False, None)], []]


@pytest.mark.parametrize("rows", tables())
def test_final_representatives(spark, rows):
    got = audit.final_representatives(spark.createDataFrame(rows, SCHEMA)).collect()
    assert {r.article_id: (r.representative_id, r.final_id, r.hops, r.looped) for r in got} == walk(rows)
    assert len(got) == len({r.article_id for r in got})


@pytest.mark.parametrize("rows", tables()[:2])
def test_repairs_leave_no_chain(spark, rows):
    fixes = {r.article_id: tuple(r) for r in audit.chain_repairs(spark.createDataFrame(rows, SCHEMA)).collect()}
    mended = [fixes.get(r[0], r) for r in rows]
    known = spark.createDataFrame(mended, SCHEMA)
    assert audit.representative_chains(known).count() == 0 and audit.chain_repairs(known).count() == 0
    old, new = walk(rows), {a: r for a, _, r in mended}
    assert all(new[a] == (None if a == end else end) for a, (_, end, _, _) in old.items())
