import hashlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from presswork.llm import warc
from presswork.session import scratch_path
from tests.llm import cases

PAGES = "/root/testdata/sf0.01/pages.parquet"
SCHEMA = "file long, offset long, record string"


def brute_audit(left, right):
    """Places as multisets of records; see ``audit`` for what pairs up."""
    digest = lambda r: None if r is None else hashlib.sha256(r.encode()).hexdigest()
    out = []
    for place in {r[:2] for r in left + right}:
        a, b = (Counter(r[2] for r in side if r[:2] == place) for side in (left, right))
        gone, new = a - b, b - a
        if len(gone) == len(new) == 1:
            (x, n), (y, m) = *gone.items(), *new.items()
            out.append((*place, "changed", digest(x), digest(y), max(n, m)))
            continue
        out += [(*place, "missing", digest(r), None, n) for r, n in gone.items()]
        out += [(*place, "extra", None, digest(r), n) for r, n in new.items()]
    return sorted(out, key=repr)


def replica(n, size=9_000):
    rows, at = [], 0
    for i in range(n):
        record = f"record {i} " * (1 + i * 7919 % size // 10)
        rows.append((i % 3, at, record))
        at += len(record) + 1
    return rows


@pytest.mark.parametrize("range_bytes", [1, 700, 1 << 16])
def test_damage_is_located(spark, range_bytes, monkeypatch):
    monkeypatch.setattr(warc, "RANGE_BYTES", range_bytes)
    left = replica(60 if range_bytes == 1 else 400)
    right = [r for i, r in enumerate(left) if i % 37]
    right = [(f, o, r + "!") if i % 29 == 3 else (f, o, r) for i, (f, o, r) in enumerate(right)]
    right += [(7, 0, "new file"), (0, 999_999_999, "far away")]
    got = warc.audit(spark.createDataFrame(left, SCHEMA), spark.createDataFrame(right, SCHEMA))
    assert cases.as_set(got) == brute_audit(left, right)


def test_only_damaged_branches_are_read(spark):
    left = spark.createDataFrame(replica(3_000), SCHEMA)
    nodes = warc.tree(warc.leaves(left), 2)
    assert nodes[0].count() > 16 * nodes[2].count()
    changed = left.withColumn("record", F.when(F.col("offset") == 0, "x").otherwise(F.col("record")))
    other = warc.tree(warc.leaves(changed), 2)
    for a, b in zip(nodes, other):
        assert a.exceptAll(b).count() == 1


def test_equal_and_empty_replicas(spark):
    left = spark.createDataFrame(replica(50), SCHEMA)
    assert warc.audit(left, left.repartition(7)).count() == 0
    assert warc.audit(left.limit(0), left.limit(0)).count() == 0
    twice = warc.audit(left.unionByName(left), left)
    assert {(r.status, r.copies) for r in twice.collect()} == {("missing", 1)} and twice.count() == 50
    assert {r.status for r in warc.audit(left, left.limit(0)).collect()} == {"missing"}


@pytest.mark.parametrize("range_bytes", [5, 1 << 16])
def test_repeated_places_and_nulls(spark, range_bytes, monkeypatch):
    monkeypatch.setattr(warc, "RANGE_BYTES", range_bytes)
    left = [
        (0, 0, "same"), (0, 9, "a"), (0, 9, "z"), (0, 20, "b"), (0, 20, "b"), (0, 30, None), (0, 40, ""),
        (None, 0, "old"), (None, None, "x"), (1, None, "p"), (1, None, "q"), (2, 5, "u"), (3, -1, "n"),
    ]
    right = [
        (0, 0, "same"), (0, 0, "zzz"), (0, 9, "a"), (0, 9, "y"), (0, 20, "b"), (0, 30, ""), (0, 40, None),
        (None, 0, "new"), (None, None, "x"), (None, None, "x"), (1, None, "r"), (2, 5, "v"), (2, 5, "w"),
        (3, -1, "m"),
    ]
    frames = [spark.createDataFrame(x, SCHEMA) for x in (left, right)]
    got = warc.audit(*frames)
    assert cases.as_set(got) == brute_audit(left, right)
    assert got.schema["file"].dataType.simpleString() == "bigint"
    for x in frames:
        assert warc.audit(x, x).count() == 0


def test_files_read_back(spark):
    pages = spark.read.parquet(PAGES)
    odd = [(None, None, None), (1, "http://a\r\nb", "x\r\n\r\nWARC/1.1\r\n\n"), (1, "u", ""), (1, "u", "")]
    pages = pages.unionByName(spark.createDataFrame(odd, pages.schema)).withColumns(
        {"file": F.lit("f"), "mark": F.lit(1), "offset": F.lit("o")}
    )
    records = warc.to_records(pages, per_file=40)
    assert records.count() == pages.count()
    path = scratch_path(spark, "warc")
    warc.write_warc(records, path)
    back = warc.read_warc(spark, path)
    columns = ["file", "offset", "record"]
    assert cases.as_set(back.select(columns)) == cases.as_set(records.select(columns))
    assert warc.audit(records, back).count() == 0
    sizes = records.groupBy("file").agg(F.max("offset")).count()
    assert sizes == -(-records.count() // 40)
    assert warc.to_records(pages.limit(0)).count() == 0
