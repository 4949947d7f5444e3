"""What feeds of every user take when they are stored: a text once per run, not per user."""

import os
import random
import subprocess
import sys
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from presswork.operators import feed, joins
from presswork.streaming import jobs

T0 = datetime(2024, 3, 1)
N_USERS, N_ARTICLES, LENGTH = 120, 240, 8_000


@pytest.fixture(scope="module")
def news(spark):
    rnd = random.Random(5)
    rows = [
        (i, 1, 1 + i % 2, f"t{i}", rnd.randbytes(LENGTH // 2).hex(), f"u{i}", T0 + timedelta(minutes=i % 50), True, False)
        for i in range(N_ARTICLES)
    ]
    return (
        spark.createDataFrame(
            rows,
            "article_id long, source_id int, category_id int, title string, description string, "
            "url string, published_at timestamp_ntz, is_processed boolean, is_duplicate boolean",
        ),
        spark.createDataFrame([(1, "c1"), (2, "c2")], "category_id int, name string"),
        spark.createDataFrame([(1, 1, "p_s")], "source_id int, category_id int, name string"),
        spark.range(N_USERS).selectExpr(
            "id AS user_id", "explode(array(1, 2)) AS category_id", "int(id % 10) + 1 AS weight"
        ),
    )


def written(df, folder):
    df.write.parquet(folder)
    return sum(os.path.getsize(f"{folder}/{f}") for f in os.listdir(folder) if f.startswith("part-"))


def test_new_since(spark, news, tmp_path):
    rows = feed.new_since(*news, T0 - timedelta(days=1))
    assert rows.columns[:3] == ["category_id", "user_id", "category_weight"]
    size = written(rows, str(tmp_path / "rows"))
    assert spark.read.parquet(str(tmp_path / "rows")).count() == N_USERS * N_ARTICLES
    # All texts are 2 MB, and 230 MB with every user.
    assert size < 5 * N_ARTICLES * LENGTH


def test_new_since_readers_may_repeat_or_be_null(spark, news):
    *tables, _ = news
    prefs = spark.createDataFrame(
        [(1, 1, 5), (1, 1, 5), (None, 1, 3), (2, None, 1), (3, 9, 1)],
        "user_id long, category_id int, weight int",
    )
    got = feed.new_since(*tables, prefs, T0 - timedelta(days=1)).groupBy("user_id").count().collect()
    assert {(r.user_id, r["count"]) for r in got} == {(1, N_ARTICLES), (None, N_ARTICLES // 2)}


def test_messages_come_list_by_list(spark, news, tmp_path, monkeypatch):
    """Cards of all readers' messages, with lists of 80 KB as of ten times shorter texts."""
    monkeypatch.setattr(jobs, "EVENT_ARTICLES", 10)
    rows = jobs.live_messages(*news, T0 + timedelta(hours=1))
    cards = F.from_json("payload", "array<struct<article_id:bigint,description:string>>")
    cards = rows.select("user_id", "part", F.posexplode(cards).alias("pos", "card"))
    size = written(cards.select("user_id", "part", "pos", "card.*"), str(tmp_path / "cards"))
    stored = spark.read.parquet(str(tmp_path / "cards"))
    assert stored.count() == N_USERS * N_ARTICLES
    assert stored.groupBy("user_id").count().filter(F.col("count") == N_ARTICLES).count() == N_USERS
    assert size < 5 * N_ARTICLES * LENGTH


def test_one_list_for_many_readers_is_shared_out(spark, news):
    """Fewer lists than tasks: all readers still get each part once, from several tasks."""
    articles, *dims = news
    rows = jobs.live_messages(articles.limit(50), *dims, T0)
    got = rows.select("user_id", "part", F.spark_partition_id().alias("task")).collect()
    assert sorted((r.user_id, r.part) for r in got) == [(i, 1) for i in range(N_USERS)]
    assert len({r.task for r in got}) > 2


def test_merge_ranks_a_list_once(spark):
    """Against a plain statement; readers, screens and articles may repeat or be null."""
    shown = spark.createDataFrame(
        [(1, 7, 1), (1, 90, 2), (1, 7, 3), (2, 91, 1), (None, 5, 1), (4, 92, 1)],
        "user_id long, article_id long, position int",
    )
    arrived = spark.createDataFrame(
        [("a", 5, 1), ("a", 7, 2), ("a", 7, 3), ("a", 8, 4), ("b", 9, 1)],
        "list_id string, article_id long, position int",
    )
    readers = spark.createDataFrame(
        [(1, "a"), (2, "b"), (3, "a"), (None, "a"), (6, "c")], "user_id long, list_id string"
    )
    got = {}
    for r in feed.merge_shown(shown, arrived, readers).orderBy("position").collect():
        got.setdefault(r.user_id, []).append((r.article_id, r.position))
    want = {
        1: [5, 8, 7, 90, 7], 2: [9, 91], 3: [5, 7, 7, 8], None: [5, 7, 7, 8, 5], 4: [92],
    }
    assert got == {u: [(a, i) for i, a in enumerate(ids, 1)] for u, ids in want.items()}


def test_merge_shuffles_readers_not_rows(spark):
    """Ten times the arrived articles for the same readers: no more is shuffled by user."""
    readers, lists = feed.reader_lists(spark.range(50).selectExpr(
        "id AS user_id", "explode(array(1, 2)) AS category_id", "1 AS weight"
    ))
    assert lists.count() == 2 and readers.select("list_id").distinct().count() == 1
    shown = spark.range(50).selectExpr("id AS user_id", "id AS article_id", "1 AS position")
    arrived = readers.select("list_id").distinct().crossJoin(spark.range(3000)).selectExpr(
        "list_id", "id AS article_id", "int(id + 1) AS position"
    )
    merged = feed.merge_shown(shown, arrived, readers)
    plan = merged._jdf.queryExecution().optimizedPlan().toString()
    fresh = plan[: plan.index("Window")]
    assert "RepartitionBy" not in fresh and merged.count() == 50 * 3000
    assert [r.position for r in merged.filter("user_id = 5 and article_id in (4, 6, 5)").orderBy("position").collect()] == [5, 6, 3000]


# Run in a session of its own, with a heap that holds a small part of readers times texts.
IN_LITTLE_MEMORY = """
import sys, tempfile
from datetime import datetime, timedelta
from pyspark.sql import SparkSession, functions as F
from presswork.operators import feed
from presswork.streaming import jobs

spark = SparkSession.builder.master("local[2]").config(map={
    "spark.driver.memory": "640m", "spark.ui.enabled": "false", "spark.sql.session.timeZone": "UTC",
    "spark.sql.shuffle.partitions": "2", "spark.checkpoint.dir": tempfile.mkdtemp(dir=sys.argv[1]),
}).getOrCreate()
at = datetime(2024, 3, 1)
text = F.concat(F.col("id"), F.repeat(F.lit("long text "), F.lit(20_000)))
articles = spark.range(3).select(
    F.col("id").alias("article_id"), F.lit(1).alias("source_id"), F.lit(1).alias("category_id"),
    F.lit("t").alias("title"), text.alias("description"), F.lit("u").alias("url"),
    F.lit(at).cast("timestamp_ntz").alias("published_at"), F.lit(True).alias("is_processed"),
    F.lit(False).alias("is_duplicate"),
)
categories = spark.createDataFrame([(1, "c1")], "category_id int, name string")
sources = spark.createDataFrame([(1, 1, "p_s")], "source_id int, category_id int, name string")
prefs = spark.range(6_000).selectExpr("id AS user_id", "1 AS category_id", "int(id % 10) + 1 AS weight")
if sys.argv[2] == "new_since":
    rows = feed.new_since(articles, categories, sources, prefs, at - timedelta(days=1))
    rows = rows.select("user_id", "description")
else:
    rows = jobs.live_messages(articles, categories, sources, prefs, at)
    rows = rows.select("user_id", F.length("payload").alias("n"))
rows.write.parquet(sys.argv[1] + "/out")
print("ROWS", spark.read.parquet(sys.argv[1] + "/out").count())
"""


@pytest.mark.parametrize("made,n_rows", [("new_since", 18_000), ("live_messages", 6_000)])
def test_texts_of_all_readers_are_never_held_at_once(tmp_path, made, n_rows):
    """3.6 GB of texts, 1.2 GB of one article, in a heap of 640 MB."""
    root = os.path.dirname(os.path.dirname(os.path.abspath(feed.__file__)))
    env = os.environ | {"PYTHONPATH": os.path.dirname(root), "SPARK_LOCAL_IP": "127.0.0.1"}
    done = subprocess.run(
        [sys.executable, "-c", IN_LITTLE_MEMORY, str(tmp_path), made],
        env=env, cwd=tmp_path, capture_output=True, text=True, timeout=600,
    )
    assert f"ROWS {n_rows}" in done.stdout, done.stderr[-3000:]


def test_texts_of_a_task_fit_a_dictionary(spark):
    """Each task's articles are cut by size, and every article is in one task."""
    rows = spark.range(400).selectExpr(
        "id % 390 AS article_id", "int(id % 3) AS category_id", "repeat('x', int(20000 + id % 7 * 1000)) AS description"
    )
    sets, n = feed._task_sets(rows, "category_id")
    got = sets.select("_place", F.explode("_articles").alias("a")).select("_place", "a.*")
    by = got.groupBy("_place").agg(F.sum(F.length("description")).alias("n")).collect()
    assert got.count() == 400 and sorted(r["_place"] for r in by) == list(range(n))
    assert n > 10 and max(r.n for r in by) < feed.TASK_BYTES + 30_000


def test_readers_with_the_same_weights_share_messages(spark, news):
    """One row for readers who get the same, and one each for those who do not."""
    *tables, _ = news
    same = spark.range(100).selectExpr("id AS user_id", "1 AS category_id", "5 AS weight")
    other = spark.range(100, 107).selectExpr("id AS user_id", "1 AS category_id", "int(id - 100) AS weight")
    quiet = spark.createDataFrame([(900, 9, 1)], "user_id long, category_id int, weight int")
    prefs = same.unionByName(other.filter("weight != 5")).unionByName(quiet)
    box = jobs.outbox(tables[0].limit(30), *tables[1:], prefs, T0)
    box = jobs.Outbox(*(df.localCheckpoint() for df in box))
    mailed = jobs.mailed(box).collect()
    payloads = {r.payload for r in mailed}
    assert len(payloads) == 8 and jobs.HEARTBEAT in payloads
    assert max(len(r.readers) for r in mailed) > 5
    singly = sorted((u, r.part, r.payload) for r in mailed for u in r.readers)
    assert singly == sorted(map(tuple, jobs.delivered(box).collect()))
    assert [u for u, *_ in singly] == [*range(105), 106, 900]


def test_blocks_are_broadcast_in_turns(spark, monkeypatch):
    """Readers of more than one broadcast still meet every unit of their key once."""
    monkeypatch.setattr(joins, "BROADCAST_ROWS", 40)
    rows = spark.range(300).selectExpr("id % 2 AS k", "id AS user_id")
    blocks = joins.in_blocks(rows, "k", 7, "test-blocks")
    units, shares = joins.shared_out(spark.range(3).selectExpr("id AS k", "id AS unit"), blocks, "k", 3)
    met = joins.beside_blocks(units, blocks, "k", shares)
    got = met.select("k", "unit", F.explode("_rows.user_id").alias("user_id")).collect()
    assert shares > 1 and sorted(map(tuple, got)) == sorted((i % 2, i % 2, i) for i in range(300))


def test_merged_lists_repeat_from_reader_to_reader(spark, tmp_path):
    """1.5 million rows, at 1.3 bytes a row at most, with each reader's own gaps."""
    readers = spark.range(500).selectExpr("id AS user_id", "'a' AS list_id")
    shown = spark.range(500).selectExpr("id AS user_id", "id * 5 AS article_id", "1 AS position")
    arrived = spark.range(3000).selectExpr(
        "'a' AS list_id", "id * 1000003 % 3000 AS article_id", "int(id + 1) AS position"
    )
    merged = feed.merge_shown(shown, arrived, readers)
    size = written(merged, str(tmp_path / "merged"))
    stored = spark.read.parquet(str(tmp_path / "merged"))
    per_user = stored.groupBy("user_id").agg(
        F.count("*").alias("n"), F.countDistinct("article_id").alias("ids"), F.countDistinct("position").alias("places"),
        F.max("position").alias("last"), F.max_by("article_id", "position").alias("kept"),
    )
    assert per_user.filter("n = 3000 AND ids = 3000 AND places = 3000 AND last = 3000 AND kept = user_id * 5").count() == 500
    assert size < 2_000_000


def test_readers_go_on_in_runs_of_bounded_bytes(spark, news, monkeypatch):
    """The longer a list's cards are, the fewer of its readers go on together."""
    *tables, _ = news
    prefs = spark.range(300).selectExpr("id AS user_id", "1 AS category_id", "5 AS weight")
    box = jobs.outbox(tables[0].limit(20), *tables[1:], prefs, T0)
    box = jobs.Outbox(*(df.localCheckpoint() for df in box))
    card = box.cards.agg(F.sum(F.length("card")).alias("n")).first().n
    monkeypatch.setattr(jobs, "READERS_BYTES", 4 * card)
    mailed = jobs.mailed(box).collect()
    assert len({r.payload for r in mailed}) == 1
    assert 2 <= max(len(r.readers) for r in mailed) <= 8
    assert sorted(u for r in mailed for u in r.readers) == list(range(300))
