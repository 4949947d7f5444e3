"""One callable per checked query: (session, data folder) -> DataFrame."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from presswork.functions import dates, text, vectors
from presswork.functions.encoder import EncoderSpec, LetterCounts, embed
from presswork.operators import (
    audit,
    chat,
    chunking,
    dedup,
    feed,
    ingest,
    recommend,
    retrieval,
    tables,
)
from presswork.operators.joins import one_by_one
from presswork.plans.chat_turn import close_turns
from presswork.plans.fixtures import AS_OF, MID_MONTH, NOON, YESTERDAY, NewsTables
from presswork.plans.hourly import run_hourly
from presswork.session import ntz, scratch_path, ship_package, stored
from presswork.sources import keyed, rss, synthetic
from presswork.streaming import jobs

QUERIES: dict[str, Callable[[NewsTables], DataFrame]] = {}
_LETTERS = EncoderSpec(LetterCounts)


def query(fn: Callable[[NewsTables], DataFrame]):
    QUERIES[fn.__name__] = fn
    return fn


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    def bind(fn):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            spark.conf.set("spark.sql.session.timeZone", "UTC")
            ship_package(spark)
            return fn(NewsTables(spark, sf_dir))

        run.__name__ = fn.__name__
        return run

    return {name: bind(fn) for name, fn in QUERIES.items()}


def _nulls_as_text(df: DataFrame, *columns: str) -> DataFrame:
    """Whole numbers that may be NULL go out as text: tools that compare results tend to
    turn such columns into floats, each in its own way."""
    return df.withColumns({c: F.col(c).cast("string") for c in columns})


def _cards(rows: DataFrame, *keep: str) -> DataFrame:
    return _nulls_as_text(
        feed.article_card(rows, AS_OF, *keep), "press_count", "category_weight"
    )


# --- feeds -------------------------------------------------------------------


@query
def latest_feed(t: NewsTables) -> DataFrame:
    return _cards(feed.latest(t.articles, t.categories, t.news_sources))


@query
def latest_feed_by_category(t: NewsTables) -> DataFrame:
    page = feed.latest(
        t.articles, t.categories, t.news_sources, page=2, limit=5, category_id=2
    )
    return _cards(page)


@query
def trending(t: NewsTables) -> DataFrame:
    return _cards(feed.trending(t.articles, t.categories, t.news_sources, AS_OF))


@query
def other_press(t: NewsTables) -> DataFrame:
    return feed.other_press_card(feed.other_press(t.articles, t.news_sources), AS_OF)


@query
def new_since_cursor(t: NewsTables) -> DataFrame:
    rows = feed.new_since(t.articles, t.categories, t.news_sources, t.prefs, YESTERDAY)
    return _cards(rows, "user_id")


@query
def merge_live_feed(t: NewsTables) -> DataFrame:
    shown = recommend.recommend(
        t.articles, t.categories, t.news_sources, t.users, t.prefs, limit=12
    ).select("user_id", "article_id", "position")
    readers, lists = feed.reader_lists(t.prefs)
    # Merging takes ids and times, no texts.
    narrow = t.articles.drop("title", "description", "url")
    arrived = feed.new_since(narrow, t.categories, t.news_sources, lists, YESTERDAY)
    by_time = W.partitionBy("list_id").orderBy(*feed.newest_first())
    arrived = arrived.withColumnRenamed("user_id", "list_id").select(
        "list_id", "article_id", F.row_number().over(by_time).alias("position")
    )
    return feed.merge_shown(shown, arrived, readers)


@query
def published_ago(t: NewsTables) -> DataFrame:
    return t.articles.select(
        "article_id", dates.published_ago(F.col("published_at"), AS_OF).alias("published_ago")
    )


# --- recommendations ---------------------------------------------------------


@query
def recommend_allocation(t: NewsTables) -> DataFrame:
    return recommend.allocation(t.prefs, 12)


def _recommended(t: NewsTables, **options) -> DataFrame:
    rows = recommend.recommend(
        t.articles, t.categories, t.news_sources, t.users, t.prefs, limit=12, **options
    )
    return _cards(rows, "user_id", "position")


@query
def recommend_page1(t: NewsTables) -> DataFrame:
    return _recommended(t)


@query
def recommend_page2(t: NewsTables) -> DataFrame:
    return _recommended(t, page=2)


@query
def recommend_excluding_seen(t: NewsTables) -> DataFrame:
    return _recommended(t, seen=t.seen)


QUERIES["recommend"] = QUERIES.pop("recommend_page1")


# --- collection --------------------------------------------------------------


@query
def clean_html_pages(t: NewsTables) -> DataFrame:
    return t.raw("pages").select("page_id", text.clean_html(F.col("html")).alias("text"))


@query
def parse_feed_dates(t: NewsTables) -> DataFrame:
    return t.feed_items.select(
        "item_id", dates.parse_feed_date(F.col("published")).alias("published_at")
    )


def _landed(t: NewsTables) -> str:
    path = scratch_path(t.spark, "feeds")
    rss.write_feed_files(t.feed_items, path)
    return path


@query
def ingest_rss_items(t: NewsTables) -> DataFrame:
    items = rss.with_section(rss.read_feed_files(t.spark, _landed(t)), t.news_sources)
    return rss.parse_items(items, F.col("source_id") % 2 == 0)


@query
def ingest_validate(t: NewsTables) -> DataFrame:
    return t.parsed_items.select("item_id", "reject_reason")


def _stored_articles(t: NewsTables) -> DataFrame:
    return t.articles.filter(F.col("published_at") < ntz(MID_MONTH))


def _inserted(t: NewsTables) -> DataFrame:
    return ingest.insert_if_absent(
        ingest.valid(t.parsed_items), _stored_articles(t), [F.asc("item_id")], AS_OF
    )


@query
def insert_if_absent(t: NewsTables) -> DataFrame:
    return _nulls_as_text(_inserted(t), "representative_id")


@query
def ingest_stats(t: NewsTables) -> DataFrame:
    return ingest.ingest_stats(t.parsed_items, _inserted(t))


@query
def synth_articles(t: NewsTables) -> DataFrame:
    return synthetic.top_up(t.articles, t.news_sources, AS_OF, target=2 * t.articles.count())


# --- chunks and embeddings ---------------------------------------------------


@query
def unprocessed_count(t: NewsTables) -> DataFrame:
    return ingest.unprocessed_count(t.articles)


@query
def partition_bounds(t: NewsTables) -> DataFrame:
    return ingest.partition_bounds(t.articles)


@query
def newest_unprocessed(t: NewsTables) -> DataFrame:
    return ingest.newest_unprocessed(t.articles).select("article_id", "published_at")


@query
def newest_unprocessed_cut(t: NewsTables) -> DataFrame:
    """Fewer articles than there are, so that the cut is met."""
    return ingest.newest_unprocessed(t.articles, 10).select("article_id", "published_at")


@query
def chunk_documents(t: NewsTables) -> DataFrame:
    return chunking.chunk_articles(t.articles)


@query
def embed_chunks(t: NewsTables) -> DataFrame:
    encoded = embed(chunking.chunk_articles(t.articles), "content")
    return encoded.select(
        "article_id",
        "chunk_index",
        F.size("embedding").alias("dimensions"),
        F.round(vectors.l2_norm(F.col("embedding")), 4).alias("norm"),
    )


@query
def append_chunks(t: NewsTables) -> DataFrame:
    new = chunking.chunk_articles(ingest.awaiting_embedding(t.articles))
    return tables.append_chunks(t.chunks, new, AS_OF)


@query
def mark_processed(t: NewsTables) -> DataFrame:
    done = ingest.awaiting_embedding(t.articles)
    return tables.mark_processed(t.articles, done).select(
        "article_id", "is_processed", "is_duplicate"
    )


@query
def embedding_backlog(t: NewsTables) -> DataFrame:
    encoded = embed(
        tables.embedding_backlog(t.chunks).select("chunk_id", "content"),
        "content",
        spec=_LETTERS,
    )
    # The weighted sum tells vectors apart: present ones stay, missing ones are the new ones.
    places = F.transform("embedding", lambda x, i: x.cast("double") * (i + 1))
    return tables.write_embeddings(t.chunks, stored(encoded, "encoded")).select(
        "chunk_id",
        F.size("embedding").alias("dimensions"),
        F.round(vectors.l2_norm(F.col("embedding")), 4).alias("norm"),
        F.round(F.aggregate(places, F.lit(0.0), lambda a, x: a + x), 2).alias("weighted"),
    )


@query
def stored_vectors(t: NewsTables) -> DataFrame:
    """The backlog in two batches that overlap, into a store beside the chunks."""
    waiting = stored(tables.embedding_backlog(t.chunks).select("chunk_id", "content"), "waiting")
    schema = t.chunks.select("chunk_id", "embedding").schema
    store = keyed.KeyedTable(t.spark, scratch_path(t.spark, "vectors"), schema, ["chunk_id"], 16)
    for batch in (waiting.filter("chunk_id % 3 < 2"), waiting.filter("chunk_id % 3 > 0")):
        keyed.store_vectors(store, embed(batch, "content", spec=_LETTERS))
    places = F.transform("embedding", lambda x, i: x.cast("double") * (i + 1))
    return keyed.chunks_with_vectors(t.chunks, store).select(
        "chunk_id",
        F.size("embedding").alias("dimensions"),
        F.round(vectors.l2_norm(F.col("embedding")), 4).alias("norm"),
        F.round(F.aggregate(places, F.lit(0.0), lambda a, x: a + x), 2).alias("weighted"),
    )


@query
def parse_embedding(t: NewsTables) -> DataFrame:
    v = F.col("vec_id")
    stored = t.raw("embeddings").select(
        "vec_id",
        F.when(v % 7 == 3, F.lit(""))
        .when(v % 7 == 5, F.lit("[0.1,x]"))
        .otherwise(vectors.format_vector(F.col("embedding")))
        .alias("embedding_text"),
    )
    parsed = stored.withColumn("embedding", vectors.parse_vector(F.col("embedding_text")))
    return parsed.filter(F.col("embedding").isNotNull()).select(
        "vec_id", F.posexplode("embedding").alias("pos", "value")
    ).withColumn("value", F.round(F.col("value").cast("double"), 6))


@query
def normalize_vectors(t: NewsTables) -> DataFrame:
    scaled = F.transform("embedding", lambda x: x * 3)
    return t.raw("embeddings").select(
        "vec_id", F.posexplode(vectors.l2_normalize(scaled)).alias("pos", "value")
    ).withColumn("value", F.round("value", 5) + F.lit(0.0))


# --- duplicates --------------------------------------------------------------

_MONTH_HOURS = 31 * 24
_TEST_THRESHOLD = 0.3  # no pair of the test vectors reaches the default


def _compared(t: NewsTables) -> DataFrame:
    return dedup.dedup_candidates(t.fresh_articles, t.chunks, AS_OF, _MONTH_HOURS)


def _elected(t: NewsTables) -> DataFrame:
    return dedup.elect_duplicates(_compared(t), _TEST_THRESHOLD)


@query
def dedup_candidates(t: NewsTables) -> DataFrame:
    return dedup.dedup_candidates(t.articles, t.chunks, AS_OF, _MONTH_HOURS).drop("vec")


@query
def similar_pairs(t: NewsTables) -> DataFrame:
    return dedup.similar_pairs(_compared(t), _TEST_THRESHOLD).withColumn(
        "similarity", F.round("similarity", 4)
    )


@query
def elect_duplicates(t: NewsTables) -> DataFrame:
    return _elected(t).withColumn("similarity", F.round("similarity", 4))


@query
def dedup_stats(t: NewsTables) -> DataFrame:
    return dedup.dedup_stats(_compared(t), _elected(t))


def _flagged(t: NewsTables) -> DataFrame:
    return tables.apply_duplicates(t.articles, _elected(t))


@query
def apply_duplicates(t: NewsTables) -> DataFrame:
    flags = _flagged(t).select("article_id", "is_duplicate", "representative_id")
    return _nulls_as_text(flags, "representative_id")


@query
def audit_rep_chains(t: NewsTables) -> DataFrame:
    return audit.representative_chains(_flagged(t))


@query
def hourly_run(t: NewsTables) -> DataFrame:
    """The whole run on partly processed articles and their stored chunks."""
    result = run_hourly(
        t.articles, t.chunks, AS_OF, _LETTERS, threshold=_TEST_THRESHOLD, hours=_MONTH_HOURS
    )
    added = result.new_chunks.groupBy("article_id").agg(
        F.count("*").alias("n_new"),
        F.min("chunk_id").alias("first_new"),
        F.sum(F.length("content")).alias("new_length"),
    )
    flags = result.articles.select(
        "article_id", "is_processed", "is_duplicate", "representative_id"
    ).join(added, "article_id", "left")
    return _nulls_as_text(flags, "representative_id", "n_new", "first_new", "new_length")


# --- retrieval and chat ------------------------------------------------------


def _retrieved(t: NewsTables, queries: DataFrame) -> DataFrame:
    return retrieval.retrieve(
        t.chunks, t.articles, t.categories, t.news_sources, t.prefs, queries, AS_OF
    )


@query
def retrieve_topk(t: NewsTables) -> DataFrame:
    return _retrieved(t, t.retrieval_queries).select(
        "query_id",
        "rank",
        "chunk_id",
        "article_id",
        "title",
        "category_name",
        "source_name",
        F.round("similarity", 4).alias("similarity"),
        F.round("score", 4).alias("score"),
    )


@query
def answer_sources(t: NewsTables) -> DataFrame:
    return retrieval.answer_sources(_retrieved(t, t.retrieval_queries))


@query
def prompt_context(t: NewsTables) -> DataFrame:
    questions = t.questions
    found = _retrieved(t, questions.select("query_id", "user_id", "vector"))
    return retrieval.build_prompts(questions, found, t.chat_history).select(
        "session_id", "prompt", "reply"
    )


@query
def chat_history_last_n(t: NewsTables) -> DataFrame:
    return chat.last_messages(t.chat_history)


@query
def chat_history_shown(t: NewsTables) -> DataFrame:
    return chat.last_messages(t.chat_history, chat.SHOWN_MESSAGES)


@query
def chat_history_cut(t: NewsTables) -> DataFrame:
    """Fewer messages than the longest conversations have, so that the cut is met."""
    return chat.last_messages(t.chat_history, 4)


@query
def chat_turn_batch(t: NewsTables) -> DataFrame:
    asked = t.questions.select(
        "session_id", F.lit("user").alias("role"), F.col("question").alias("message"),
        ntz(NOON).alias("created_at"),
    )
    return tables.append_messages(t.chat_history, asked)


@query
def chat_turn_closed(t: NewsTables) -> DataFrame:
    """Two turns of each session are answered in one batch; every answer cites its own."""
    asked = t.questions.select("query_id", "session_id")
    turns = asked.unionByName(asked.withColumn("query_id", F.col("query_id") + 10**6))
    answers = turns.withColumn("answer", F.concat(F.lit("answer "), "query_id"))
    ranks = F.explode(F.sequence(F.lit(1), F.lit(2)))
    sources = turns.select(
        "query_id",
        ranks.alias("rank"),
    ).select(
        "query_id", "rank", (F.col("query_id") * 2 + F.col("rank")).alias("article_id"),
        (1 / F.col("rank")).alias("similarity"),
    )
    messages, cited = close_turns(answers, t.chat_history, sources, None, NOON)
    return messages.join(cited, "chat_id").select(
        "id", "chat_id", "session_id", "role", "message", "rank", "article_id", "similarity"
    )


def _session_changes(t: NewsTables) -> tuple[DataFrame, DataFrame]:
    """Sessions as they were, and later touches of these and new ones by other users."""
    before = t.chat_history.filter(F.col("created_at") < ntz(YESTERDAY))
    after = t.chat_history.filter(F.col("created_at") >= ntz(YESTERDAY))
    sessions = before.groupBy("session_id").agg(
        F.min("created_at").alias("created_at"), F.max("created_at").alias("updated_at")
    ).withColumn("user_id", F.col("session_id").cast("bigint") % 15)
    touches = after.select(
        "session_id",
        (F.col("session_id").cast("bigint") % 15 + 100).alias("user_id"),
        F.col("created_at").alias("touched_at"),
    )
    return sessions, touches


@query
def upsert_sessions(t: NewsTables) -> DataFrame:
    return tables.upsert_sessions(*_session_changes(t))


@query
def stored_sessions(t: NewsTables) -> DataFrame:
    sessions, touches = _session_changes(t)
    path = scratch_path(t.spark, "sessions")
    store = keyed.KeyedTable(t.spark, path, sessions.schema, ["session_id"], 16)
    store.add(sessions)
    keyed.store_sessions(store, touches)
    return store.read()


@query
def user_sessions(t: NewsTables) -> DataFrame:
    return chat.sessions_by_user(t.chat_sessions)


@query
def session_groups(t: NewsTables) -> DataFrame:
    return chat.session_groups(t.chat_sessions, NOON)


@query
def user_prefs(t: NewsTables) -> DataFrame:
    return chat.prefs_with_names(t.prefs, t.categories)


def _pref_changes(t: NewsTables) -> tuple[DataFrame, DataFrame]:
    e = F.col("event_id")
    changes = t.raw("events").filter(F.col("event_type") == "click").select(
        "user_id",
        (1 + e % 4).cast("int").alias("category_id"),
        (1 + e % 10).cast("int").alias("weight"),
        e.alias("seq"),
    )
    return t.prefs.withColumn("created_at", ntz(YESTERDAY)), changes


@query
def upsert_prefs(t: NewsTables) -> DataFrame:
    return tables.upsert_prefs(*_pref_changes(t), AS_OF)


@query
def stored_prefs(t: NewsTables) -> DataFrame:
    prefs, changes = _pref_changes(t)
    path = scratch_path(t.spark, "prefs")
    store = keyed.KeyedTable(t.spark, path, prefs.schema, ["user_id", "category_id"], 16)
    store.add(prefs)
    keyed.store_prefs(store, changes, AS_OF)
    return store.read()


# --- audits ------------------------------------------------------------------


@query
def audit_unique(t: NewsTables) -> DataFrame:
    return audit.repeated_keys(t.feed_items, ["link"])


@query
def audit_orphans(t: NewsTables) -> DataFrame:
    return audit.orphans(t.seen, "article_id", feed.servable(t.articles), "article_id")


@query
def audit_ranges(t: NewsTables) -> DataFrame:
    prefs = audit.violations(t.prefs, weight_from_1_to_10=F.col("weight").between(1, 10))
    items = audit.violations(
        t.parsed_items,
        title_present=F.col("title") != "",
        url_present=F.col("url") != "",
        date_present=F.col("published_at").isNotNull(),
    )
    return prefs.unionByName(items)


@query
def audit_constraints(t: NewsTables) -> DataFrame:
    # Each table is read by several checks.
    return audit.check_constraints({n: stored(df, n) for n, df in t.broken_tables.items()})


def _chained(t: NewsTables) -> DataFrame:
    """Articles in runs of five that point at the one before, some of them in a ring."""
    k = F.col("article_id")
    before = F.when(k % 40 == 20, k + 4).when((k % 5 != 0) | (k % 40 == 25), k - 1)
    return stored(
        t.articles.select("article_id", before.isNotNull().alias("is_duplicate"), before.alias("representative_id")),
        "chained",
    )


@query
def audit_chain_ends(t: NewsTables) -> DataFrame:
    return _nulls_as_text(audit.final_representatives(_chained(t)), "hops")


@query
def audit_chain_repairs(t: NewsTables) -> DataFrame:
    return _nulls_as_text(audit.chain_repairs(_chained(t)), "representative_id")


# --- streams -----------------------------------------------------------------


@query
def stream_ingest_dedup(t: NewsTables) -> DataFrame:
    out, state = (scratch_path(t.spark, n) for n in ("stream-articles", "stream-state"))
    even = [r.source_id for r in t.news_sources.filter("source_id % 2 = 0").collect()]
    jobs.stream_ingest(
        t.spark, _landed(t), t.news_sources, out, state, lambda: AS_OF, content_first=even
    ).awaitTermination()
    return _nulls_as_text(t.spark.read.parquet(out), "representative_id")


@query
def stream_chunk(t: NewsTables) -> DataFrame:
    stored, out, state = (scratch_path(t.spark, n) for n in ("articles", "chunks", "state"))
    t.articles.write.parquet(stored)
    jobs.stream_chunks(
        t.spark, stored, t.articles.schema, out, state, lambda: AS_OF
    ).awaitTermination()
    return t.spark.read.parquet(out).select("chunk_id", "article_id", "chunk_index", "content")


def _pushed(t: NewsTables, since) -> DataFrame:
    """All card fields and heartbeats of one poll of the live feed."""
    stored, out, state = (scratch_path(t.spark, n) for n in ("articles", "live", "state"))
    t.articles.write.parquet(stored)
    news = jobs.push_once(
        t.prefs, out, 0, spark=t.spark, articles_path=stored, schema=t.articles.schema,
        categories=t.categories, sources=t.news_sources, checkpoint=state, since=since,
        now=lambda: AS_OF,
    )
    idle = t.spark.read.schema("user_id bigint, part bigint, payload string")
    # A message is parsed once for all who get it.
    messages = (
        jobs.deliver(t.spark, out, 0, by_reader=False)
        if news
        else idle.json(f"{out}/idle=0").withColumn("readers", F.array("user_id"))
    )
    cards = F.from_json(
        "payload",
        "array<struct<article_id:bigint,title:string,description:string,url:string,"
        "published_at:string,published_ago:string,category_name:string,source_name:string,"
        "press_count:bigint,similarity:double,category_weight:int>>",
    )
    is_idle = F.col("payload") == jobs.HEARTBEAT
    pushed = messages.select(
        "readers",
        is_idle.alias("heartbeat"),
        F.posexplode_outer(F.when(~is_idle, cards)).alias("pos", "card"),
    )
    pushed = pushed.select(one_by_one("readers").alias("user_id"), "heartbeat", "pos", "card").select(
        "user_id", "heartbeat", "pos", "card.*"
    )
    return _nulls_as_text(pushed, "pos", "article_id", "press_count", "category_weight")


@query
def live_feed_batch(t: NewsTables) -> DataFrame:
    return _pushed(t, YESTERDAY)


@query
def live_feed_quiet(t: NewsTables) -> DataFrame:
    """So little news that most users get the heartbeat."""
    return _pushed(t, "2024-01-30 21:00:00")
