"""Plan shapes, partition independence, the hourly run and the shared folder."""

import os
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from presswork import session
from presswork.functions.encoder import EncoderSpec, HashedNgrams
from presswork.operators import feed, ingest, recommend
from presswork.operators.joins import top_per_group
from presswork.plans.hourly import run_hourly, store_hourly
from presswork.schemas import ARTICLE_CHUNKS, ARTICLES
from presswork.sources.tables import save_articles, save_chunks
from tests.compare import _cell

SF = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(entry.queries()))
def test_no_cross_joins_or_row_udfs(spark, name):
    text = plan(entry.queries()[name](spark, SF))
    for bad in ("CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython"):
        assert bad not in text


def test_entry(spark):
    df = entry.entry(spark)
    assert df.count() > 0 and df.schema == entry.entry(spark).schema


@pytest.mark.parametrize(
    "name",
    ["recommend_excluding_seen", "elect_duplicates", "insert_if_absent", "append_chunks", "retrieve_topk", "other_press"],
)
def test_result_does_not_depend_on_partitions(spark, name):
    def rows(partitions):
        spark.conf.set("spark.sql.shuffle.partitions", partitions)
        df = entry.queries()[name](spark, SF)
        return sorted(tuple(_cell(v) for v in r) for r in df.collect())

    try:
        assert rows(1) == rows(8)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", 8)


def test_top_k_is_cut_before_the_shuffle(spark):
    df = spark.range(100).select((F.col("id") % 3).alias("k"), "id")
    text = plan(top_per_group(df, ["k"], [F.asc("id")], 5))
    assert text.index("Final") < text.index("Exchange") < text.index("Partial")


def test_gates_reach_the_scan(spark, tmp_path):
    now = datetime(2024, 3, 1)
    schema = "article_id long, title string, description string, published_at timestamp_ntz, is_processed boolean, is_duplicate boolean"
    path = str(tmp_path / "a")
    spark.createDataFrame([(1, "t", "d" * 30, now, True, False)], schema).write.parquet(path)
    stored = spark.read.parquet(path)
    recent = feed.published_within(feed.servable(stored), now, 24).select("article_id")
    text = recent._jdf.queryExecution().explainString(
        spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted")
    )
    assert "GreaterThan(published_at" in text and "EqualTo(is_processed,true)" in text
    assert "title" not in text.split("ReadSchema")[1].splitlines()[0]
    assert ingest.unprocessed_count(stored).first()[0] == 0


def test_hourly_run(spark):
    now = datetime(2024, 3, 1, 12)
    base = "The council agreed on a new budget for schools after a long debate in the evening. "
    other = "Heavy rain closed several mountain roads and delayed trains in the north today. "
    rows = [
        (1, 1, 1, "Budget", base * 3, "u1", now - timedelta(hours=5), False, False, None, now),
        (2, 2, 1, "Budget", base * 3, "u2", now - timedelta(hours=4), False, False, None, now),
        (3, 2, 1, "Rain", other * 3, "u3", now - timedelta(hours=3), False, False, None, now),
        (4, 3, 1, "Budget", base * 3, "u4", now - timedelta(hours=30), False, False, None, now),
        (5, 3, 2, "Budget", base * 3, "u5", now - timedelta(hours=1), False, False, None, now),
        (6, 3, 1, "Short", "too short", "u6", now - timedelta(hours=1), False, False, None, now),
    ]
    articles = spark.createDataFrame(rows, ARTICLES)
    chunks = spark.createDataFrame(
        [], "article_id long, chunk_index int, content string, embedding array<float>, chunk_id long"
    )
    first = run_hourly(articles, chunks, now, encoder=EncoderSpec(lambda: HashedNgrams(64)))
    state = {r.article_id: r for r in first.articles.collect()}
    assert {i for i, r in state.items() if r.is_processed} == {1, 2, 3, 4, 5}
    # 4 is outside the window, 5 in another category.
    assert {(i, r.representative_id) for i, r in state.items() if r.is_duplicate} == {(2, 1)}
    assert first.new_chunks.select("article_id", "chunk_index").distinct().count() == first.new_chunks.count()
    assert first.articles.columns == articles.columns and len(state) == 6
    assert {r.article_id for r in first.changed.collect()} == {1, 2, 3, 4, 5}
    assert run_hourly(first.articles, first.new_chunks, now) is None


def test_hourly_run_is_stored_and_can_be_repeated(spark, tmp_path):
    now = datetime(2024, 3, 1, 12)
    text = "The council agreed on a new budget for schools after a long debate. " * 3
    old = [(i, 1, 1, "Old", text, f"o{i}", now - timedelta(days=9, hours=i), True, False, None, now) for i in (1, 2)]
    new = [(i, i, 1, "New", text, f"n{i}", now - timedelta(hours=i), False, False, None, now) for i in (3, 4)]
    articles, chunks = str(tmp_path / "articles"), str(tmp_path / "chunks")
    save_articles(spark.createDataFrame(old + new, ARTICLES), articles, files_per_day=2)
    first = [(1, 1, 0, "An old chunk.", [1.0] + [0.0] * 63, now)]
    save_chunks(spark.createDataFrame(first, ARTICLE_CHUNKS), chunks)
    encoder = EncoderSpec(lambda: HashedNgrams(64))
    kept = {f for f in os.listdir(articles) if "02-2" in f}
    files = {f: sorted(os.listdir(f"{articles}/{f}")) for f in kept}

    assert store_hourly(spark, articles, chunks, now, encoder=encoder)
    state = {r.article_id: r for r in spark.read.parquet(articles).collect()}
    assert len(state) == 4 and all(r.is_processed for r in state.values())
    assert {(i, r.representative_id) for i, r in state.items() if r.is_duplicate} == {(3, 4)}
    stored_chunks = spark.read.parquet(chunks)
    n = stored_chunks.count()
    assert n > 1 and {r[0] for r in stored_chunks.select("created_at").distinct().collect()} == {now}
    assert not store_hourly(spark, articles, chunks, now, encoder=encoder)
    assert spark.read.parquet(chunks).count() == n
    # Days without a change keep their files.
    assert files and {f: sorted(os.listdir(f"{articles}/{f}")) for f in kept} == files


def test_shared_folder_follows_the_session(spark, monkeypatch, tmp_path):
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        assert session.shared_folder(spark) == named.rstrip("/")
        assert session.scratch_path(spark, "x").startswith(named.rstrip("/"))
    assert session.scratch_path(spark, "x") != session.scratch_path(spark, "x")


def test_a_cluster_without_shared_folder_is_refused():
    class Conf:
        def get(self, key, default):
            return default

    class Context:
        master = "yarn"

    class Session:
        conf, sparkContext = Conf(), Context()

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        session.shared_folder(Session())


def test_stored_table_reads_back(spark):
    df = session.stored(spark.range(10), "numbers")
    assert df.count() == 10 and "FileScan parquet" in plan(df)


def test_newest_articles_are_found_in_the_newest_days(spark, tmp_path, monkeypatch):
    """The feed reads the days it needs and shows what the whole table would."""
    start = datetime(2024, 3, 1)
    rows = [
        (i, 1, 1 + i % 2, f"t{i}", "d", f"u{i}", start + timedelta(hours=i), i % 5 != 0, i % 7 == 0, None, start)
        for i in range(24 * 20)
    ]
    # The second category has not been written about for a week.
    rows = [r for r in rows if r[2] == 1 or r[6] < start + timedelta(days=13)]
    plain = spark.createDataFrame(rows, ARTICLES)
    path = str(tmp_path / "articles")
    save_articles(plain, path, files_per_day=1)
    laid_out = spark.read.parquet(path)
    categories = spark.createDataFrame([(1, "a"), (2, "b")], "category_id int, name string")
    sources = spark.createDataFrame([(1, 1, "p_s")], "source_id int, category_id int, name string")
    read = []
    wide = feed.newest_days

    def noted(articles, enough):
        part = wide(articles, enough)
        read.append(part.select("published_day").distinct().count())
        return part

    monkeypatch.setattr(feed, "newest_days", noted)
    for options, days in [({}, 4), ({"category_id": 2, "limit": 5}, 8), ({"page": 9}, 20), ({"page": 99}, 20)]:
        got = feed.latest(laid_out, categories, sources, **options).select("article_id").collect()
        monkeypatch.setattr(feed, "newest_days", lambda articles, enough: articles)
        want = feed.latest(plain, categories, sources, **options).select("article_id").collect()
        monkeypatch.setattr(feed, "newest_days", noted)
        assert got == want
        assert read.pop() <= days
    users = spark.range(5).withColumnRenamed("id", "user_id")
    prefs = spark.createDataFrame([(u, c, 1 + u) for u in range(4) for c in (1, 2)], "user_id long, category_id int, weight int")
    seen = spark.createDataFrame([(1, i) for i in range(0, 480, 3)], "user_id long, article_id long")
    for extra in ({}, {"seen": seen}):
        pages = [
            sorted(map(tuple, recommend.recommend(df, categories, sources, users, prefs, **extra).select("user_id", "position", "article_id").collect()))
            for df in (laid_out, plain)
        ]
        assert pages[0] == pages[1] and pages[0]
