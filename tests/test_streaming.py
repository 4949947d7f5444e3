import json
import os
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from presswork.functions.encoder import EncoderSpec, HashedNgrams
from presswork.session import shared_folder
from presswork.sources import url_index
from presswork.streaming import jobs
from tests.test_sources import land

T0 = datetime(2024, 3, 1)


def feed(*entries):
    body = "".join(
        f"<item><title>{title}</title><link>{url}</link><description>{'d' * 60}</description>"
        f"<pubDate>{when}</pubDate></item>"
        for title, url, when in entries
    )
    return f"<rss><channel>{body}</channel></rss>"


def test_ingest_keeps_late_articles_and_urls_unique(spark, tmp_path):
    feeds, out, state = (str(tmp_path / n) for n in ("feeds", "out", "state"))
    sources = spark.createDataFrame([(1, 7, "p_s")], "source_id int, category_id int, name string")

    def run():
        jobs.stream_ingest(spark, feeds, sources, out, state, lambda: T0).awaitTermination()
        return {r.url: r for r in spark.read.parquet(out).collect()}

    land(tmp_path / "feeds", 1, feed(("one", "u1", "Fri, 01 Mar 2024 10:00:00 GMT"), ("bad", "u9", "never")), "a.xml")
    assert set(run()) == {"u1"}
    land(
        tmp_path / "feeds", 1,
        feed(("again", "u1", "Fri, 01 Mar 2024 11:00:00 GMT"), ("late", "u2", "Mon, 01 Jan 2024 10:00:00 GMT")),
        "b.xml",
    )
    got = run()
    assert set(got) == {"u1", "u2"} and got["u1"].title == "one"
    assert sorted(r.article_id for r in got.values()) == [1, 2]
    assert set(run()) == {"u1", "u2"}  # nothing new, nothing repeated
    assert spark.read.parquet(out).count() == 2
    assert {r.created_at for r in got.values()} == {T0}


def test_batches_look_up_urls_in_the_index(spark, tmp_path, monkeypatch):
    feeds, out, state = (str(tmp_path / n) for n in ("feeds", "out", "state"))
    sources = spark.createDataFrame([(1, 7, "p_s")], "source_id int, category_id int, name string")
    when = "Fri, 01 Mar 2024 10:00:00 GMT"
    whole = []
    plain = jobs._stored
    monkeypatch.setattr(jobs, "_stored", lambda *a: whole.append(1) or plain(*a))

    def run(number, *urls, checkpoint=state):
        land(tmp_path / "feeds", 1, feed(*[(f"t{u}", u, when) for u in urls]), f"{number}.xml")
        jobs.stream_ingest(spark, feeds, sources, out, checkpoint, lambda: T0).awaitTermination()
        found = spark.read.parquet(out).collect()
        assert sorted(r.article_id for r in found) == list(range(1, len(found) + 1))
        return sorted(r.url for r in found)

    many = [f"http://a.org/{i}" for i in range(200)]
    assert run(0, *many) == sorted(many) and len(whole) == 1
    # Later batches never read the articles, and only the buckets of their own urls.
    assert run(1, many[5], "http://b.org/1", "http://b.org/1") == sorted([*many, "http://b.org/1"])
    assert len(whole) == 1
    index = jobs.UrlIndex(spark, f"{out}_urls")
    one = url_index.with_key(spark.createDataFrame([("http://a.org/7",)], "url string")).first().bucket
    few = index.keys([one])
    few.collect()
    plan = few._jdf.queryExecution().executedPlan()
    assert "PartitionFilters: [" in plan.toString() and f"= {one})" in plan.toString()
    files = [r[0] for r in few.select(F.input_file_name()).distinct().collect()]
    assert len(files) == 1 and f"bucket={one}" in files[0]
    assert index.keys().select(F.input_file_name()).distinct().count() > 100
    index.compact(1)
    assert index.keys().count() == 201 and {r.batch for r in index.keys().collect()} == {1}
    assert run(2, many[9], "http://b.org/2") == sorted([*many, "http://b.org/1", "http://b.org/2"])
    assert len(whole) == 1
    # A replay from a lost checkpoint meets the marks and goes by the articles.
    again = run(3, "http://b.org/3", checkpoint=str(tmp_path / "state2"))
    assert again == sorted([*many, *[f"http://b.org/{i}" for i in (1, 2, 3)]])
    assert len(whole) == 2


def scratch_folders(spark):
    root = f"{shared_folder(spark)}/presswork/{spark.sparkContext.applicationId}"
    return {n for n in os.listdir(root.removeprefix("file:"))} if os.path.exists(root) else set()


def test_micro_batches_leave_no_scratch(spark, tmp_path):
    feeds, out, state = (str(tmp_path / n) for n in ("feeds", "out", "state"))
    sources = spark.createDataFrame([(1, 7, "p_s")], "source_id int, category_id int, name string")
    before = scratch_folders(spark)
    for n in range(3):
        land(tmp_path / "feeds", 1, feed((f"t{n}", f"u{n}", "Fri, 01 Mar 2024 10:00:00 GMT")), f"{n}.xml")
        jobs.stream_ingest(spark, feeds, sources, out, state, lambda: T0).awaitTermination()
    assert spark.read.parquet(out).count() == 3
    assert scratch_folders(spark) == before


ARTICLES = (
    "article_id long, source_id int, category_id int, title string, description string, url string, "
    "published_at timestamp_ntz, is_processed boolean, is_duplicate boolean"
)


@pytest.fixture
def dims(spark):
    return (
        spark.createDataFrame([(1, "c1"), (2, "c2")], "category_id int, name string"),
        spark.createDataFrame([(1, 1, "p_s")], "source_id int, category_id int, name string"),
        spark.createDataFrame([(10, 1, 5), (11, 2, 6), (11, 1, 1)], "user_id long, category_id int, weight int"),
    )


def article(i, category, minutes, processed=True):
    return (i, 1, category, f"t{i}", "d", f"u{i}", T0 + timedelta(minutes=minutes), processed, False)


def test_live_feed(spark, tmp_path, dims):
    stored, out, state = (str(tmp_path / n) for n in ("articles", "out", "state"))

    def add(*rows):
        df = spark.createDataFrame(list(rows), ARTICLES).coalesce(1)
        df.write.mode("append").parquet(stored)
        jobs.stream_live_feed(
            spark, stored, df.schema, *dims, out, state, since=T0 - timedelta(days=1),
            now=lambda: T0 + timedelta(hours=1), poll=None,
        ).awaitTermination()

    def batch(n):
        rows = jobs.deliver(spark, out, n).collect()
        return {r.user_id: json.loads(r.payload) for r in rows}

    add(article(1, 1, 0), article(2, 1, 5), article(3, 2, 3), article(4, 1, 9, processed=False))
    first = batch(0)
    assert [c["article_id"] for c in first[10]] == [2, 1]
    assert [c["article_id"] for c in first[11]] == [2, 3, 1]
    assert first[10][0]["published_ago"] == "55분 전" and first[10][0]["press_count"] is None
    assert len(first[10][0]) == 11
    # Older than, and as old as, what was already pushed: both are still delivered.
    add(article(5, 2, 5), article(6, 2, -30))
    second = batch(1)
    assert [c["article_id"] for c in second[11]] == [5, 6]
    assert second[10] == {"type": "heartbeat"}


def written(folder):
    return sum(
        os.path.getsize(os.path.join(at, f)) for at, _, files in os.walk(folder) for f in files if "part-" in f
    )


def test_outbox_grows_with_articles_plus_users(spark, tmp_path, dims):
    """Ten times the users add a row each; cards and lists stay as they are."""
    categories, sources, _ = dims
    news = [article(i, 1 + i % 2, i)[:4] + ("d" * 2_000,) + article(i, 1, i)[5:] for i in range(60)]
    df = spark.createDataFrame(news, ARTICLES)
    sizes = []
    for n_users in (200, 2_000):
        prefs = spark.range(n_users).selectExpr(
            "id AS user_id", "explode(slice(array(1, 2), 1, 1 + int(id % 2))) AS category_id", "int(id % 10) + 1 AS weight"
        )
        box = jobs.outbox(df, categories, sources, prefs, T0)
        assert box.cards.count() == 60 and box.lists.count() == 2 and box.users.count() == n_users
        path = str(tmp_path / f"box{n_users}")
        for name, part in zip(jobs.Outbox._fields, box):
            part.write.parquet(f"{path}/{name}/batch=0")
        sizes.append(written(path))
        got = jobs.deliver(spark, path, 0, users=spark.createDataFrame([(3,), (4,)], "user_id long"))
        assert {r.user_id: len(json.loads(r.payload)) for r in got.collect()} == {3: 60, 4: 30}
    assert sizes[1] - sizes[0] < 100 * 1_800


def test_quiet_poll_sends_heartbeats(spark, tmp_path, dims):
    stored, out, state = (str(tmp_path / n) for n in ("articles", "out", "state"))
    categories, sources, prefs = dims
    df = spark.createDataFrame([article(1, 1, 0)], ARTICLES)
    df.write.parquet(stored)

    def poll(number):
        return jobs.push_once(
            prefs, out, number, spark=spark, articles_path=stored, schema=df.schema,
            categories=categories, sources=sources, checkpoint=state,
            since=T0 - timedelta(days=1), now=lambda: T0,
        )

    assert poll(0) and not os.path.exists(f"{out}/idle=0")
    assert not poll(1)
    beats = spark.read.json(f"{out}/idle=1").collect()
    assert {(r.user_id, r.payload) for r in beats} == {(10, jobs.HEARTBEAT), (11, jobs.HEARTBEAT)}


def test_long_batches_are_split_into_messages(spark, dims, monkeypatch):
    monkeypatch.setattr(jobs, "EVENT_ARTICLES", 4)
    df = spark.createDataFrame([article(i, 1, i) for i in range(10)], ARTICLES)
    rows = jobs.live_messages(df, *dims, T0).filter(F.col("user_id") == 10).orderBy("part").collect()
    ids = [[c["article_id"] for c in json.loads(r.payload)] for r in rows]
    assert ids == [[9, 8, 7, 6], [5, 4, 3, 2], [1, 0]]


def test_chunks_once(spark, tmp_path):
    stored, out, state, other = (str(tmp_path / n) for n in ("articles", "out", "state", "state2"))
    text = "A sentence of some length. " * 20
    rows = [(i, 1, 1, f"Title {i}", text, f"u{i}", T0, i == 3, False) for i in range(4)]
    df = spark.createDataFrame(rows, ARTICLES)
    df.write.parquet(stored)

    def run(checkpoint):
        jobs.stream_chunks(
            spark, stored, df.schema, out, checkpoint, now=lambda: T0, encoder=EncoderSpec(lambda: HashedNgrams(16))
        ).awaitTermination()
        return spark.read.parquet(out)

    n = run(state).count()
    assert n > 3 and run(state).count() == n
    # A lost checkpoint replays every file; nothing is stored twice.
    again = run(other)
    assert again.count() == n
    assert again.select("chunk_id").distinct().count() == n
    assert again.select("article_id").distinct().count() == 3
