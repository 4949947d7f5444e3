"""Streaming forms of ingest, chunking and the live feed.

All run on checkpointed file streams. Sinks append through ``foreachBatch`` and look up
what is stored first, so a batch that is run again after a failure adds nothing twice.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from datetime import datetime
from typing import NamedTuple

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from presswork.functions.encoder import HASHED, EncoderSpec, embed
from presswork.operators.chunking import chunk_articles
from presswork.operators.feed import (
    article_card,
    dimensions,
    newest_first,
    published_after,
    servable,
    with_names,
)
from presswork.operators.ingest import awaiting_embedding, valid
from presswork.operators.joins import (
    assign_ids,
    beside_blocks,
    checked_broadcast,
    in_blocks,
    join_hot_key,
    one_by_one,
    shared_out,
)
from presswork.operators.tables import append_chunks
from presswork.plans.collect import insert_first, judge_entries
from presswork.session import scratch_scope, stored
from presswork.sources.rss import read_feed_files
from presswork.sources.url_index import UrlIndex

# How often the live feed looks for news, and the idle message.
POLL = "10 seconds"
HEARTBEAT = '{"type":"heartbeat"}'
# Articles per pushed message, so that no message grows without bound.
EVENT_ARTICLES = 100
# Readers of one message that go on together: at most so many, and so many bytes with their
# copies of the cards.
READERS = 1024
READERS_BYTES = 64 * 1024 * 1024

STORED_ARTICLES = (
    "article_id bigint, source_id int, category_id int, title string, description string, "
    "url string, published_at timestamp_ntz, is_processed boolean, is_duplicate boolean, "
    "representative_id bigint, created_at timestamp_ntz"
)
STORED_CHUNKS = (
    "article_id bigint, chunk_index int, content string, embedding array<float>, "
    "chunk_id bigint, created_at timestamp_ntz"
)


def _stored(spark: SparkSession, path: str, schema: str) -> DataFrame:
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def _start(
    stream: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str, poll: str | None
) -> StreamingQuery:
    writer = stream.writeStream.option("checkpointLocation", checkpoint).foreachBatch(sink)
    trigger = {"processingTime": poll} if poll else {"availableNow": True}
    return writer.trigger(**trigger).start()


def stream_ingest(
    spark: SparkSession,
    feed_path: str,
    sources: DataFrame,
    out_path: str,
    checkpoint: str,
    now: Callable[[], datetime],
    content_first: Sequence[int] = (),
    poll: str | None = None,
    index_path: str | None = None,
) -> StreamingQuery:
    """Append new articles from feed files as they land, created at ``now()``.

    A url is unique for good: each batch is checked against all that is stored, through a
    ``UrlIndex`` at ``index_path`` (by default beside the articles) of which only the buckets
    of the batch's urls are read. The articles themselves are read when the index is missing
    or behind, or when a batch is run again. A watermark would bound the check but also drop
    articles that arrive late.
    """
    items = read_feed_files(spark, feed_path, streaming=True)

    def sink(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        index = UrlIndex(spark, index_path or f"{out_path.rstrip('/')}_urls")
        with scratch_scope(spark):
            entries = stored(valid(judge_entries(batch, sources, content_first)), "entries")
            if index.is_current(number):
                before = index.head(number - 1)
                known, entries = before, index.unknown(entries)
            else:
                known = _stored(spark, out_path, STORED_ARTICLES)
                before = stored(known.select("url", "article_id"), "known-urls")
                index.add(before, number - 1, before)
            index.begin(number)
            added = stored(insert_first(entries, known, now()), "added")
            added.write.mode("append").parquet(out_path)
            index.add(added, number, before)

    return _start(items, sink, checkpoint, poll)


def stream_chunks(
    spark: SparkSession,
    articles_path: str,
    schema: StructType,
    out_path: str,
    checkpoint: str,
    now: Callable[[], datetime],
    encoder: EncoderSpec = HASHED,
    poll: str | None = None,
) -> StreamingQuery:
    """Chunk and embed articles as they are stored; (article, index) is written once."""
    rows = awaiting_embedding(spark.readStream.schema(schema).parquet(articles_path))

    def sink(batch: DataFrame, _: int) -> None:
        spark = batch.sparkSession
        with scratch_scope(spark):
            known = _stored(spark, out_path, STORED_CHUNKS)
            new = append_chunks(known, chunk_articles(batch), now())
            embed(new, "content", spec=encoder).write.mode("append").parquet(out_path)

    return _start(rows, sink, checkpoint, poll)


class Outbox(NamedTuple):
    """What one batch of news leaves to be delivered; its size is that of articles plus users.

    cards: article_id, category_id, published_at and the card as JSON, open at its end for
    the reader's weight. lists: article ids by set of categories (set_id, part, article_ids,
    newest first). users: user_id, set_id and weights by category.
    """

    cards: DataFrame
    lists: DataFrame
    users: DataFrame


def outbox(
    articles: DataFrame,
    categories: DataFrame,
    sources: DataFrame,
    prefs: DataFrame,
    as_of: datetime,
) -> Outbox:
    """One card per article, one list of ids per distinct set of categories, one row per user."""
    named = with_names(servable(articles), dimensions(categories, sources))
    shown = article_card(
        named.withColumn("_at", F.col("published_at")), as_of, "category_id", "_at"
    ).drop("category_weight")
    fields = [c for c in shown.columns if c not in ("category_id", "_at")]
    card = F.to_json(F.struct(*fields), {"ignoreNullFields": "false"})
    cards = shown.select(
        "article_id",
        "category_id",
        F.col("_at").alias("published_at"),
        F.substring(card, F.lit(1), F.length(card) - 1).alias("card"),
    )
    # A user has one row per category at most.
    users = prefs.groupBy("user_id").agg(
        F.array_sort(F.collect_set("category_id")).alias("categories"),
        F.map_from_entries(F.collect_list(F.struct("category_id", "weight"))).alias("weights"),
    )
    users = users.withColumn("set_id", F.md5(F.array_join(F.col("categories").cast("array<string>"), ",")))
    sets = users.select("set_id", "categories").distinct()
    wanted = join_hot_key(
        cards.select("article_id", "category_id", "published_at"),
        stored(sets, "sets").select("set_id", F.explode("categories").alias("category_id")),
        ["category_id"],
    )
    ranked = wanted.withColumn(
        "rn", F.row_number().over(W.partitionBy("set_id").orderBy(*newest_first()))
    )
    in_order = F.array_sort(F.collect_list(F.struct("rn", "article_id")))
    lists = ranked.groupBy("set_id", F.ceil(F.col("rn") / EVENT_ARTICLES).alias("part")).agg(
        F.transform(in_order, lambda e: e["article_id"]).alias("article_ids")
    )
    return Outbox(cards, lists, users.select("user_id", "set_id", "weights"))


def delivered(box: Outbox) -> DataFrame:
    """Messages (user_id, part, payload): a JSON array of cards, newest first, in parts.

    Users without news get the heartbeat.
    """
    return mailed(box).select(one_by_one("readers").alias("user_id"), "part", "payload")


def mailed(box: Outbox) -> DataFrame:
    """The messages of ``delivered`` with those they go to: (readers, part, payload).

    A list is filled with its cards once per set of categories. Readers with the same weights
    get the same messages, so the weights are added once for ``READERS`` of them, with no
    ranking or grouping by user; readers whose weights are like no other's have their own row.

    A list has a task of its own, or several that share its readers out, where they meet it one
    block after the other. The same cards follow each other, and columnar files of them keep
    each text once per list.
    """
    lists = assign_ids(box.lists, ["set_id", "part"], "_place")
    places = lists.select("set_id", "part", "_place", F.posexplode("article_ids").alias("pos", "article_id"))
    in_order = F.array_sort(F.collect_list(F.struct("pos", "category_id", "card")))
    filled = (
        places.join(box.cards.drop("published_at"), "article_id")
        .groupBy("set_id", "part", "_place")
        .agg(in_order.alias("cards"), F.sum(F.octet_length("card")).alias("_bytes"))
    )
    filled = stored(filled, "filled-lists")
    n_lists = box.lists.count()
    blocks = _letters(box.users, n_lists)
    lists, shares = shared_out(filled, blocks, "set_id", n_lists)
    place = ((F.col("_place") - 1) * shares + F.col("_share")).cast("int")
    lists = lists.repartitionById(max(1, n_lists * shares), place)

    weights = F.map_from_entries("_letter.weights")
    weighted = F.transform(
        "cards",
        lambda c: F.concat(
            c["card"],
            F.lit(',"category_weight":'),
            F.coalesce(F.element_at(weights, c["category_id"]).cast("string"), F.lit("null")),
            F.lit("}"),
        ),
    )
    fit = F.floor(F.lit(READERS_BYTES) / F.greatest("_bytes", F.lit(1)))
    fit = F.greatest(F.least(fit, F.lit(READERS)), F.lit(1)).cast("int")
    starts = F.sequence(F.lit(1), F.size("_letter.readers"), F.col("_fit"))
    full = (
        beside_blocks(lists, blocks, "set_id", shares)
        .select("part", "cards", fit.alias("_fit"), one_by_one("_rows").alias("_letter"))
        .select(
            "part",
            F.concat(F.lit("["), F.array_join(weighted, ","), F.lit("]")).alias("payload"),
            F.transform(starts, lambda i: F.slice("_letter.readers", i, F.col("_fit"))).alias("_readers"),
        )
        .select(one_by_one("_readers").alias("readers"), "part", "payload")
    )
    idle = heartbeats(box.users.join(box.lists.select("set_id").distinct(), "set_id", "left_anti"))
    return full.unionByName(idle.select(F.array("user_id").alias("readers"), "part", "payload"))


def _letters(users: DataFrame, n_lists: int) -> DataFrame:
    """Users with the same categories and weights together, at most about ``READERS`` or, where
    lists are few, as many as give each task some; in blocks by set."""
    entries = F.array_sort(F.map_entries("weights"))
    users = stored(users.select("user_id", "set_id", entries.alias("weights")), "readers")
    tasks = int(users.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    most = max(1, min(READERS, users.count() * n_lists // tasks))
    users = users.withColumn("_weights", F.md5(F.col("weights").cast("string")))
    same = ["set_id", "_weights"]
    sizes = users.groupBy(same).agg(F.ceil(F.count("*") / most).alias("_n"))
    letters = (
        join_hot_key(users, sizes, same)
        .groupBy(*same, F.pmod(F.xxhash64("user_id"), F.col("_n")))
        .agg(F.first("weights").alias("weights"), F.collect_list(F.struct("user_id")).alias("readers"))
        .select("set_id", "weights", F.transform("readers", lambda r: r["user_id"]).alias("readers"))
    )
    letters = stored(letters, "letters")
    return in_blocks(letters, "set_id", 1, "letter-blocks", weight=F.size("readers"))


def live_messages(
    articles: DataFrame,
    categories: DataFrame,
    sources: DataFrame,
    prefs: DataFrame,
    as_of: datetime,
) -> DataFrame:
    """Messages for one batch of new articles, for all users."""
    box = outbox(articles, categories, sources, prefs, as_of)
    return delivered(Outbox(*(stored(df, name) for name, df in zip(Outbox._fields, box))))


def deliver(
    spark: SparkSession,
    out_path: str,
    number: int,
    users: DataFrame | None = None,
    by_reader: bool = True,
) -> DataFrame:
    """Messages of batch ``number`` of a live feed, for the given users (user_id) or all.

    Rows of ``delivered``, or of ``mailed`` if not ``by_reader``.
    """
    box = Outbox(*(spark.read.parquet(f"{out_path}/{name}/batch={number}") for name in Outbox._fields))
    if users is not None:
        wanted = checked_broadcast(users.select("user_id").distinct())
        box = box._replace(users=box.users.join(wanted, "user_id", "left_semi"))
    return delivered(box) if by_reader else mailed(box)


def stream_live_feed(
    spark: SparkSession,
    articles_path: str,
    schema: StructType,
    categories: DataFrame,
    sources: DataFrame,
    prefs: DataFrame,
    out_path: str,
    checkpoint: str,
    since: datetime,
    now: Callable[[], datetime],
    poll: str | None = POLL,
) -> StreamingQuery:
    """Write each batch's ``Outbox`` below ``out_path``, in folders ``batch=<n>``.

    What a batch writes grows with its articles plus the users, not with their product;
    ``deliver`` makes messages of it for the users who are there.
    The stream remembers which files it has read, not how new the articles were, so
    one that is stored late, or shares its time with another, is still delivered.
    ``since`` only keeps the history out when a feed is opened.
    """
    rows = spark.readStream.schema(schema).parquet(articles_path)
    rows = published_after(rows, since)

    def sink(batch: DataFrame, number: int) -> None:
        with scratch_scope(batch.sparkSession):
            # Read three times below; a rerun of the batch overwrites its own folders.
            fresh = stored(batch, "live-batch")
            box = outbox(fresh, categories, sources, prefs, now())
            for name, df in zip(Outbox._fields, box):
                df.write.mode("overwrite").parquet(f"{out_path}/{name}/batch={number}")

    return _start(rows, sink, checkpoint, poll)


def heartbeats(prefs: DataFrame) -> DataFrame:
    """The idle message for every user with preferences."""
    return prefs.select("user_id").distinct().select(
        "user_id", F.lit(1).cast("bigint").alias("part"), F.lit(HEARTBEAT).alias("payload")
    )


def push_once(prefs: DataFrame, out_path: str, number: int, **feed) -> bool:
    """One poll of the live feed; False if nothing had arrived.

    A stream runs no batch when no file arrived, so a quiet poll writes its heartbeats
    here, below ``out_path/idle=<number>``. The other arguments are those of
    ``stream_live_feed``; a caller polls by calling this every ``POLL``.
    """
    query = stream_live_feed(prefs=prefs, out_path=out_path, poll=None, **feed)
    query.awaitTermination()
    if any(p.numInputRows for p in query.recentProgress):
        return True
    heartbeats(prefs).write.mode("overwrite").json(f"{out_path}/idle={number}")
    return False
