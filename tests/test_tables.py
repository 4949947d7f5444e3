from datetime import datetime

import pytest
from pyspark.sql import functions as F

from presswork.operators import audit, ingest, joins, tables
from presswork.schemas import CATEGORIES, NEWS_SOURCES
from presswork.sources import keyed, seeds
from presswork.sources.tables import (
    read_jdbc_range,
    save_articles,
    save_bucketed,
    update_articles,
)

T0 = datetime(2024, 1, 1)


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_ids_are_consecutive_and_repeatable(spark):
    new = spark.range(5000).select(F.concat(F.lit("u"), "id").alias("url"))
    old = spark.createDataFrame([(41,), (7,)], "article_id long")
    a = joins.assign_ids(new.repartition(7), ["url"], "article_id", old)
    b = joins.assign_ids(new.repartition(2), ["url"], "article_id", old)
    ids = sorted(r.article_id for r in a.collect())
    assert ids == list(range(42, 5042))
    assert rows(a) == rows(b)
    fresh = joins.assign_ids(new, ["url"], "article_id", old.limit(0))
    assert fresh.agg(F.min("article_id"), F.max("article_id")).first() == (1, 5000)


def item(i, url, title="t", d="d" * 60):
    return (i, 1, 1, title, d, url, T0)


ITEMS = "item_id long, source_id int, category_id int, title string, description string, url string, published_at timestamp_ntz"


def test_insert_if_absent(spark):
    items = spark.createDataFrame(
        [item(1, "a", "first"), item(2, "a", "second"), item(3, "b"), item(4, "c"), item(5, "d", "")], ITEMS
    )
    stored = spark.createDataFrame([(10, "b")], "article_id long, url string")
    judged = ingest.with_reject_reason(items)
    new = ingest.insert_if_absent(ingest.valid(judged), stored, [F.asc("item_id")], T0)
    assert {(r.url, r.title) for r in new.collect()} == {("a", "first"), ("c", "t")}
    assert sorted(r.article_id for r in new.collect()) == [11, 12]
    again = ingest.insert_if_absent(
        ingest.valid(judged), stored.unionByName(new.select("article_id", "url")), [F.asc("item_id")], T0
    )
    assert again.count() == 0
    stats = ingest.ingest_stats(judged, new).collect()
    assert [tuple(s) for s in stats] == [(1, 5, 2, 3)]


def test_reject_reasons(spark):
    cases = [
        item(1, "u"), item(2, ""), item(3, "u", ""), item(4, "u", d="d" * 49), item(5, "u", d="  " + "d" * 50 + "\n"),
        item(6, "u", d="  " + "d" * 49 + "\n"), item(7, "u", d=None), (8, 1, 1, "t", "d" * 60, "u", None),
    ]
    df = ingest.with_reject_reason(spark.createDataFrame(cases, ITEMS))
    got = {r.item_id: r.reject_reason for r in df.collect()}
    short, missing = ingest.SHORT_DESCRIPTION, ingest.MISSING_FIELD
    assert got == {1: None, 2: missing, 3: missing, 4: short, 5: None, 6: short, 7: short, 8: missing}


def test_append_chunks_twice(spark):
    schema = "chunk_id long, article_id long, chunk_index int, content string"
    stored = spark.createDataFrame([(3, 1, 0, "x")], schema)
    new = spark.createDataFrame([(1, 0, "again"), (1, 1, "y"), (2, 0, "z")], "article_id long, chunk_index int, content string")
    added = tables.append_chunks(stored, new, T0)
    assert sorted((r.article_id, r.chunk_index) for r in added.collect()) == [(1, 1), (2, 0)]
    assert sorted(r.chunk_id for r in added.collect()) == [4, 5]
    assert tables.append_chunks(stored.unionByName(added.drop("created_at")), new, T0).count() == 0


def test_mark_and_embed(spark):
    articles = spark.createDataFrame([(1, False), (2, False), (3, True)], "article_id long, is_processed boolean")
    done = spark.createDataFrame([(2,), (2,)], "article_id long")
    assert rows(tables.mark_processed(articles, done)) == [(1, False), (2, True), (3, True)]
    chunks = spark.createDataFrame([(1, [1.0]), (2, None)], "chunk_id long, embedding array<float>")
    encoded = spark.createDataFrame([(1, [9.0]), (2, [2.0])], "chunk_id long, embedding array<float>")
    assert rows(tables.write_embeddings(chunks, encoded)) == [(1, [1.0]), (2, [2.0])]


def test_upsert_prefs(spark):
    prefs = spark.createDataFrame([(5, 1, 1, 3), (6, 1, 2, 4)], "pref_id long, user_id long, category_id int, weight int")
    changes = spark.createDataFrame(
        [(1, 1, 9, 0), (1, 1, 8, 1), (2, 1, 7, 2)], "user_id long, category_id int, weight int, seq long"
    )
    once = tables.upsert_prefs(prefs, changes, T0)
    assert {tuple(r[c] for c in ("pref_id", "user_id", "category_id", "weight")) for r in once.collect()} == {
        (5, 1, 1, 8), (6, 1, 2, 4), (7, 2, 1, 7)
    }
    twice = tables.upsert_prefs(once, changes, T0)
    assert rows(twice.select(*sorted(twice.columns))) == rows(once.select(*sorted(once.columns)))


def test_upsert_sessions_keeps_owner(spark):
    day = lambda d: datetime(2024, 1, d)
    old = spark.createDataFrame([("s", 1, day(1), day(1))], "session_id string, user_id long, created_at timestamp_ntz, updated_at timestamp_ntz")
    touches = spark.createDataFrame(
        [("s", 2, day(3)), ("n", 4, day(5)), ("n", 3, day(4))], "session_id string, user_id long, touched_at timestamp_ntz"
    )
    assert rows(tables.upsert_sessions(old, touches)) == [
        ("n", 3, day(4), day(5)), ("s", 1, day(1), day(3))
    ]


def test_append_sources(spark):
    new = spark.createDataFrame([(1, 7, 1, 0.5), (1, 8, 2, 0.4)], "chat_id long, article_id long, rank int, similarity double")
    added = tables.append_sources(None, new)
    assert sorted(r.id for r in added.collect()) == [1, 2]
    more = tables.append_sources(added, new)
    assert sorted(r.id for r in more.collect()) == [3, 4]


@pytest.mark.parametrize("stored", [[], [(1, "other"), (5, seeds.SEED_CATEGORIES[1])]])
def test_seeds_are_added_once(spark, stored):
    """By name and address, with ids that nothing stored has."""
    categories = seeds.add_categories(spark.createDataFrame(stored, CATEGORIES))
    ids = {r.name: r.category_id for r in categories.collect()}
    assert set(ids) == {n for _, n in stored} | set(seeds.SEED_CATEGORIES)
    assert len(set(ids.values())) == len(ids) and all(ids[n] == i for i, n in stored)
    assert rows(seeds.add_categories(categories)) == rows(categories)
    known = [(3, 1, "p_s", seeds.SEED_SOURCES[4][1], True)] if stored else []
    sources = seeds.add_sources(spark.createDataFrame(known, NEWS_SOURCES), categories)
    got = {r.rss_url: r for r in sources.collect()}
    assert len(got) == sources.count() == 12
    assert len({r.source_id for r in got.values()}) == 12
    for name, url, section in seeds.SEED_SOURCES:
        if not known or url != known[0][3]:
            assert got[url].name == name
            assert got[url].category_id == ids[seeds.SEED_CATEGORIES[section - 1]]
    assert rows(seeds.add_sources(sources, categories)) == rows(sources)


def test_hot_key_join_by_shuffle(spark, monkeypatch):
    many = spark.range(2000).select("id", F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") % 50).alias("k"))
    few = spark.range(40).select(F.col("id").alias("k"), (F.col("id") * 2).alias("v"))
    small = rows(joins.join_hot_key(many, few, ["k"], "left"))
    monkeypatch.setattr(joins, "is_small", lambda df: False)
    assert rows(joins.join_hot_key(many, few, ["k"], "left")) == small


def test_jdbc_ranges(spark):
    url = "jdbc:derby:memory:presswork;create=true"
    ids = spark.range(1, 101).select(F.col("id").alias("ARTICLE_ID"))
    ids.write.jdbc(url, "ARTICLES", mode="overwrite")
    df = read_jdbc_range(spark, url, "SELECT ARTICLE_ID FROM ARTICLES WHERE ARTICLE_ID > 10", "ARTICLE_ID", 6)
    assert df.rdd.getNumPartitions() == 6
    assert sorted(r[0] for r in df.collect()) == list(range(11, 101))
    none = read_jdbc_range(spark, url, "SELECT ARTICLE_ID FROM ARTICLES WHERE ARTICLE_ID > 999", "ARTICLE_ID", 6)
    assert none is None


def test_jdbc_ranges_hold_equal_counts_despite_gaps(spark):
    url = "jdbc:derby:memory:presswork;create=true"
    dense, sparse = spark.range(1, 901), spark.range(1, 101).selectExpr("id * 1000000 AS id")
    ids = dense.unionByName(sparse).unionByName(spark.range(50).selectExpr("7L AS id"))
    ids.select(F.col("id").alias("ARTICLE_ID")).write.jdbc(url, "GAPPED", mode="overwrite")
    df = read_jdbc_range(spark, url, "SELECT ARTICLE_ID FROM GAPPED", "ARTICLE_ID", 8)
    assert rows(df) == rows(ids)
    sizes = df.groupBy(F.spark_partition_id()).count().collect()
    assert len(sizes) == 8 and max(r["count"] for r in sizes) < 2 * 1050 / 8


def test_bucketed_tables_join_without_shuffle(spark):
    left = spark.range(1000).select(F.col("id").alias("article_id"), F.lit("a").alias("a"))
    save_bucketed(left, "presswork_articles", buckets=4)
    save_bucketed(left.withColumnRenamed("a", "b"), "presswork_chunks", buckets=4)
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
        joined = spark.table("presswork_articles").join(spark.table("presswork_chunks"), "article_id")
        assert "Exchange" not in joined._jdf.queryExecution().executedPlan().toString()
        assert joined.count() == 1000
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.sql("DROP TABLE presswork_articles")
        spark.sql("DROP TABLE presswork_chunks")


def test_day_layout_prunes(spark, tmp_path):
    from datetime import timedelta

    df = spark.createDataFrame([(i, T0 + timedelta(hours=i)) for i in range(96)], "article_id long, published_at timestamp_ntz")
    path = str(tmp_path / "articles")
    save_articles(df, path)
    back = spark.read.parquet(path)
    assert back.count() == 96 and back.select("published_day").distinct().count() == 4
    one = back.filter(F.col("published_day") == F.lit(T0.date()))
    assert one.count() == 24
    scanned = one._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(published_day" in scanned
    files = {r[0] for r in one.select(F.input_file_name()).distinct().collect()}
    assert files and all(f"published_day={T0.date()}" in f for f in files)


def test_only_changed_days_are_rewritten(spark, tmp_path):
    from datetime import timedelta

    rows = [(i, T0 + timedelta(hours=i), "old") for i in range(96)]
    schema = "article_id long, published_at timestamp_ntz, state string"
    path = str(tmp_path / "articles")
    save_articles(spark.createDataFrame(rows, schema), path, files_per_day=2)

    def files():
        names = spark.read.parquet(path).select("published_day", F.input_file_name().alias("f")).distinct()
        out = {}
        for r in names.collect():
            out.setdefault(str(r.published_day), set()).add(r.f)
        return out

    before = files()
    day = T0.date() + timedelta(days=1)
    inside = [r for r in rows if r[1].date() == day][3]
    changed = spark.createDataFrame([(inside[0], inside[1], "new"), (500, inside[1], "added")], schema)
    for _ in range(2):  # once more changes nothing
        update_articles(spark, path, changed, files_per_day=2)
        got = {r.article_id: r.state for r in spark.read.parquet(path).collect()}
        assert got == {r[0]: "old" for r in rows} | {inside[0]: "new", 500: "added"}
    after = files()
    assert after.keys() == before.keys()
    assert {d for d in before if before[d] != after[d]} == {str(day)}


def test_rows_without_a_time_are_replaced_like_others(spark, tmp_path):
    path = str(tmp_path / "articles")
    schema = "article_id long, state string, published_at timestamp_ntz"
    save_articles(
        spark.createDataFrame([(1, "old", None), (2, "old", None), (3, "old", T0)], schema), path, 2
    )
    changed = spark.createDataFrame([(2, "new", None), (4, "added", None)], schema)
    for _ in range(2):
        update_articles(spark, path, changed, files_per_day=2)
        got = {r.article_id: r.state for r in spark.read.parquet(path).collect()}
        assert got == {1: "old", 2: "new", 3: "old", 4: "added"}


def test_first_chunks_have_their_own_folder(spark, tmp_path):
    from presswork.sources.tables import first_chunks, save_chunks

    schema = "chunk_id long, article_id long, chunk_index int, content string, embedding array<float>"
    chunks = spark.createDataFrame(
        [(1, 1, 0, "a", [1.0]), (2, 1, 1, "b", [2.0]), (3, 2, 0, "c", None), (4, 3, 0, "d", [3.0])], schema
    )
    path = str(tmp_path / "chunks")
    save_chunks(chunks, path)
    back = spark.read.parquet(path)
    assert rows(first_chunks(back)) == rows(first_chunks(chunks)) == [(1, 0, [1.0]), (3, 0, [3.0])]
    plan = first_chunks(back)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(first_chunk" in plan


def bucket_files(path):
    """Data files by bucket folder."""
    found = {}
    for folder in (path / "rows").glob("bucket=*"):
        found[folder.name] = {f.name for f in folder.glob("*.parquet")}
    return found


PREFS = "pref_id long, user_id long, category_id int, weight int"
CHANGES = "user_id long, category_id int, weight int, seq long"


def prefs_store(spark, path, rows, buckets=16, files=1):
    df = spark.createDataFrame(rows, PREFS)
    key = ["user_id", "category_id"]
    store = keyed.KeyedTable(spark, str(path), df.schema, key, buckets, files)
    store.add(df)
    return store, df


@pytest.mark.parametrize("files", [1, 3])
def test_stored_prefs_as_a_whole_table(spark, tmp_path, files):
    store, df = prefs_store(
        spark, tmp_path, [(i + 1, i // 4, i % 4, 1 + i % 10) for i in range(2_000)], files=files
    )
    assert rows(store.read()) == rows(df)
    changes = spark.createDataFrame(
        [(7, 1, 9, 0), (7, 1, 8, 1), (9_000, 2, 7, 2), (9_001, 2, 6, 3), (None, 1, 5, 4)], CHANGES
    )
    before = bucket_files(tmp_path)
    keyed.store_prefs(store, changes, T0)
    after = bucket_files(tmp_path)
    assert rows(store.read()) == rows(tables.upsert_prefs(df, changes, T0))
    moved = {b for b in after if after[b] != before.get(b)}
    assert 0 < len(moved) <= 4 < len(after)  # four keys, so at most four folders are new
    # Run again: nothing new, no id given out twice.
    once = rows(store.read())
    keyed.store_prefs(store, changes.filter("user_id is not null"), T0)
    assert rows(store.read()) == once
    keyed.store_prefs(store, spark.createDataFrame([(9_002, 1, 3, 1)], CHANGES), T0)
    ids = [r.pref_id for r in store.read().collect()]
    assert len(ids) == len(set(ids)) and max(ids) == 2_004


def test_ids_reserved_by_a_failed_change_are_not_given_again(spark, tmp_path, monkeypatch):
    store, _ = prefs_store(spark, tmp_path, [(1, 1, 1, 1)])

    def lost(self, rows, mode):
        raise OSError("lost")

    with monkeypatch.context() as m:
        m.setattr(keyed.KeyedTable, "_write", lost)
        with pytest.raises(OSError):
            keyed.store_prefs(store, spark.createDataFrame([(2, 1, 3, 1)], CHANGES), T0)
    assert rows(store.read()) == [(1, 1, 1, 1)]
    keyed.store_prefs(store, spark.createDataFrame([(2, 1, 3, 1)], CHANGES), T0)
    assert rows(store.read()) == [(1, 1, 1, 1), (3, 2, 1, 3)]


def test_change_reads_only_touched_buckets(spark, tmp_path):
    store, df = prefs_store(spark, tmp_path, [(i, i, 1, 1) for i in range(500)])
    one = df.filter("user_id = 3")
    touched = store.touched(one)
    assert len(touched.inputFiles()) >= 1
    read = touched.select(F.input_file_name().alias("f")).distinct().collect()
    assert len(read) == 1 and "3" in {str(r.user_id) for r in touched.collect()}
    assert store.touched(df.limit(0)).count() == 0


def test_stored_sessions(spark, tmp_path):
    day = lambda d: datetime(2024, 1, d)
    schema = "session_id string, user_id long, created_at timestamp_ntz, updated_at timestamp_ntz"
    old = spark.createDataFrame([(f"s{i}", i, day(1), day(1)) for i in range(100)], schema)
    touches = spark.createDataFrame(
        [("s7", 2, day(3)), ("n", 4, day(5)), ("n", 3, day(4))],
        "session_id string, user_id long, touched_at timestamp_ntz",
    )
    store = keyed.KeyedTable(spark, str(tmp_path), old.schema, ["session_id"], 16)
    keyed.store_sessions(store, touches.limit(0))  # nothing stored, nothing to do
    assert store.read().count() == 0
    store.add(old)
    for _ in range(2):
        keyed.store_sessions(store, touches)
        assert rows(store.read()) == rows(tables.upsert_sessions(old, touches))


def test_stored_vectors_are_appended_and_merged_on_read(spark, tmp_path):
    schema = "chunk_id long, embedding array<float>"
    chunks = spark.createDataFrame([(i, [9.0] if i == 4 else None) for i in range(60)], schema)
    store = keyed.KeyedTable(spark, str(tmp_path), chunks.schema, ["chunk_id"], 8)
    assert rows(keyed.chunks_with_vectors(chunks, store)) == rows(chunks)

    def encoded(ids, value):
        return spark.createDataFrame([(i, [value]) for i in ids] + [(99, None)], schema)

    keyed.store_vectors(store, encoded(range(30), 1.0))
    first = bucket_files(tmp_path)
    keyed.store_vectors(store, encoded(range(20, 40), 2.0))  # ten of them are there
    second = bucket_files(tmp_path)
    assert all(first[b] <= second[b] for b in first)
    want = [(i, [9.0] if i == 4 else [1.0] if i < 30 else [2.0] if i < 40 else None) for i in range(60)]
    assert rows(keyed.chunks_with_vectors(chunks, store)) == sorted(want, key=str)
    stored_before = rows(store.read())
    store.compact(chunks)
    assert rows(store.read()) == stored_before
    assert all(len(f) == 1 for f in bucket_files(tmp_path).values())


def test_a_key_that_many_rows_of_a_batch_share(spark, tmp_path):
    """Half of all changes are to one pair; the last of them counts."""
    store, _ = prefs_store(spark, tmp_path, [(1, 1, 1, 1)])
    changes = spark.range(4_000).selectExpr(
        "if(id % 2 = 0, 1, id) as user_id", "1 as category_id", "cast(1 + id % 10 as int) as weight", "id as seq"
    )
    keyed.store_prefs(store, changes, T0)
    got = {(r.user_id, r.category_id): r.weight for r in store.read().collect()}
    assert len(got) == 2_000 and got[1, 1] == 1 + 3_998 % 10
