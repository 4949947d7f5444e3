import hashlib
import math
from collections import Counter

import pytest
from pyspark.sql import functions as F

from presswork.llm import mixing
from tests.llm import cases


def poisson(u, mean):
    k, term, total = 0, math.exp(-mean), math.exp(-mean)
    while total <= u and k < 200:
        k += 1
        term *= mean / k
        total += term
    return k


def brute_copies(rows, weights, other, total, seed):
    chars = Counter()
    for r in rows:
        chars[r[3]] += len(r[1] or "")
    share = {s: weights.get(s, other) for s, n in chars.items() if n}
    wanted = sum(chars.values()) if total is None else total
    out = Counter()
    for r in rows:
        if not chars[r[3]]:
            continue
        rate = share[r[3]] / sum(share.values()) * wanted / chars[r[3]]
        parts = max(1, math.ceil(rate / 16))
        key = str(r[0]) if r[0] is not None else "text:" + hashlib.md5((r[1] or "").encode()).hexdigest()
        for i in range(1, parts + 1):
            u = int(hashlib.md5(f"{seed}/{key}/{i}".encode()).hexdigest()[:13], 16) / 2**52
            out[(r[0], r[1], r[3])] += poisson(u, rate / parts)
    return +out


@pytest.mark.parametrize("total", [None, 40_000, 30_000_000])
def test_copies_against_a_plain_statement(spark, total):
    rows = [*cases.ROWS, *[(100 + i, cases.ENGLISH * (1 + i % 5), "en", f"s{i % 7}", 1) for i in range(300)]]
    docs = cases.clashing(spark, ["copy", "shuffle_key", "cdf", "parts", "rate"], rows)
    weights = {"a": 3.0, "s1": 0.0, "unknown": 5.0}
    got = mixing.replicate(docs, weights, 1.0, total, seed=3)
    counted = {
        (r.doc_id, r.text, r.source): r["count"]
        for r in got.groupBy("doc_id", "text", "source").count().collect()
    }
    assert counted == brute_copies(rows, weights, 1.0, total, 3)


def test_draws_in_blocks_are_the_same(spark, monkeypatch):
    rows = [*cases.ROWS, *[(100 + i, cases.ENGLISH, "en", f"s{i % 7}", 1) for i in range(40)]]
    docs = cases.clashing(spark, ["copy", "draw_block", "first_copy", "n_drawn", "k"], rows)
    columns = ["doc_id", "text", "source", "copy", "shuffle_key"]
    want = mixing.replicate(docs, {}, 1.0, 3_000_000, seed=3).select(*columns).collect()
    monkeypatch.setattr(mixing, "PARTS_AT_ONCE", 2)
    got = mixing.replicate(docs, {}, 1.0, 3_000_000, seed=3).select(*columns).collect()
    assert sorted(got, key=repr) == sorted(want, key=repr)


def test_a_row_at_a_very_high_rate(spark):
    docs = cases.documents(spark, [(1, "ab", "en", "a", 2), (2, "cd " * 1000, "en", "b", 3000)])
    mixed = mixing.replicate(docs, {"a": 1.0, "b": 0.0}, total=4_000_000, seed=5)
    got = mixed.groupBy("doc_id").agg(F.count("*"), F.min("copy"), F.max("copy"), F.countDistinct("copy"))
    [(doc_id, n, low, high, distinct)] = got.collect()
    assert (doc_id, low, high, distinct) == (1, 1, n, n)
    assert n == brute_copies([(1, "ab", "en", "a")], {}, 1.0, 4_000_000, 5)[(1, "ab", "a")]


def test_rate_and_order(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    mixed = mixing.replicate(docs, {"src0": 5.0}, 1.0, total=20_000_000, seed=1)
    rows = mixed.select("doc_id", "copy", "source", "shuffle_key", F.length("text").alias("n")).collect()
    keys = [r.shuffle_key for r in rows]
    assert keys == sorted(keys) and len(set(keys)) == len(keys)
    chars = Counter()
    for r in rows:
        chars[r.source] += r.n
    n = len(chars)
    assert sum(chars.values()) == pytest.approx(20_000_000, rel=0.05)
    assert chars["src0"] / sum(chars.values()) == pytest.approx(5 / (n + 4), rel=0.1)
    copies = Counter(r.doc_id for r in rows)
    assert sorted(r.copy for r in rows if r.doc_id == max(copies, key=copies.get)) == list(
        range(1, max(copies.values()) + 1)
    )
    again = mixing.replicate(docs.repartition(3), {"src0": 5.0}, 1.0, total=20_000_000, seed=1)
    assert sorted(r.shuffle_key for r in again.select("shuffle_key").collect()) == keys
    other = mixing.replicate(docs, {"src0": 5.0}, 1.0, total=20_000_000, seed=2)
    assert {r.shuffle_key for r in other.select("shuffle_key").collect()}.isdisjoint(keys)


def test_no_rows_and_no_text(spark):
    empty = cases.documents(spark, [])
    assert mixing.replicate(empty, {}).columns == [*empty.columns, "copy", "shuffle_key"]
    assert mixing.replicate(empty, {}).count() == 0
    assert mixing.replicate(cases.documents(spark, [(1, None, "en", "a", 0)]), {}).count() == 0
