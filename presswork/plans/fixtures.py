"""News tables derived from the generic test tables, over all of their rows.

The same definitions stand as SQL in ``oracles.py``. Dates are fixed so that both
sides see the same "now".
"""

from __future__ import annotations

from datetime import datetime
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from presswork.operators.ingest import with_reject_reason
from presswork.session import ntz, stored
from presswork.sources.rss import parse_items

AS_OF = datetime(2024, 1, 31)
NOON = datetime(2024, 1, 31, 12)
YESTERDAY = datetime(2024, 1, 30)
MID_MONTH = datetime(2024, 1, 15)

_DIMENSIONS: dict[tuple[str, str], DataFrame] = {}


def _after(start: datetime, seconds):
    return ntz(start) + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), seconds)


class NewsTables:
    """Lazy fixture tables for one data folder."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.dir = str(sf_dir).rstrip("/")

    def raw(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")

    @cached_property
    def categories(self) -> DataFrame:
        return self.spark.sql(
            "SELECT * FROM VALUES (1, 'en'), (2, 'de'), (3, 'es'), (4, 'fr') AS c(category_id, name)"
        )

    @cached_property
    def news_sources(self) -> DataFrame:
        """One row per publisher section, derived once per application and stored, as the
        dimension table it stands for would be."""
        key = (self.spark.sparkContext.applicationId, self.dir)
        if key not in _DIMENSIONS:
            pairs = self.raw("documents").select("source", "lang").distinct()
            _DIMENSIONS[key] = stored(
                pairs.join(self.categories, F.col("lang") == F.col("name")).select(
                    # A window over this dimension only.
                    F.dense_rank().over(W.orderBy("source", "lang")).alias("source_id"),
                    "category_id",
                    F.concat_ws("_", "source", "lang").alias("name"),
                ),
                "news-sources",
            )
        return _DIMENSIONS[key]

    @cached_property
    def articles(self) -> DataFrame:
        i = F.col("doc_id")
        block, slot = i - i % 40, i % 40
        papers = self.news_sources.withColumnRenamed("name", "paper")
        return (
            self.raw("documents")
            .withColumn("paper", F.concat_ws("_", "source", "lang"))
            .join(papers, "paper")
            .select(
                i.alias("article_id"),
                "source_id",
                "category_id",
                F.concat(F.lit("Report "), i.cast("string"), F.lit(" by "), "source").alias("title"),
                F.col("text").alias("description"),
                F.concat(F.lit("http://news.example/"), i.cast("string")).alias("url"),
                _after(datetime(2024, 1, 1), i * 104729 % 2592000).alias("published_at"),
                (i % 11 != 0).alias("is_processed"),
                (slot >= 12).alias("is_duplicate"),
                F.when(slot >= 28, block)
                .when(slot >= 12, block + i % 4)
                .alias("representative_id"),
            )
        )

    @cached_property
    def chunks(self) -> DataFrame:
        """Two chunks per article; the chunk text is the article text, if there is one.
        Every 50th waits for its embedding."""
        v = F.col("vec_id")
        texts = self.raw("documents").select(
            F.col("doc_id").alias("article_id"), F.col("text").alias("content")
        )
        return (
            self.raw("embeddings")
            .select(
                v.alias("chunk_id"),
                F.expr("vec_id div 2").alias("article_id"),
                (v % 2).cast("int").alias("chunk_index"),
                F.when(v % 50 != 49, F.col("embedding")).alias("embedding"),
            )
            .join(texts, "article_id", "left")
            .select(
                "chunk_id",
                "article_id",
                "chunk_index",
                F.coalesce("content", F.concat(F.lit("passage "), "chunk_id")).alias("content"),
                "embedding",
            )
        )

    @cached_property
    def users(self) -> DataFrame:
        return self.raw("events").select("user_id").distinct()

    @cached_property
    def prefs(self) -> DataFrame:
        u, c = F.col("user_id"), F.col("category_id")
        all_ids = F.array(*[F.lit(k) for k in (1, 2, 3, 4)])
        return (
            self.users.select("user_id", F.explode(all_ids).alias("category_id"))
            .filter((u % 7 != 0) & ((u + c) % 5 != 0))
            .select(
                (u * 10 + c).alias("pref_id"),
                "user_id",
                "category_id",
                (1 + (u * c * 3 + c * 7) % 10).cast("int").alias("weight"),
            )
        )

    @cached_property
    def seen(self) -> DataFrame:
        n_articles = self.raw("documents").count()
        return (
            self.raw("events")
            .filter(F.col("event_type") == "view")
            .select("user_id", (F.col("event_id") % n_articles).alias("article_id"))
            .distinct()
        )

    @cached_property
    def retrieval_queries(self) -> DataFrame:
        """Every vector is asked as a question by the user of the same number."""
        return self.raw("embeddings").select(
            F.col("vec_id").alias("query_id"),
            F.col("vec_id").alias("user_id"),
            F.col("embedding").alias("vector"),
        )

    @cached_property
    def chat_history(self) -> DataFrame:
        conv, turn = F.col("conv_id"), F.col("turn")
        return self.raw("conversations").select(
            (conv * 1000 + turn).alias("chat_id"),
            conv.cast("string").alias("session_id"),
            "role",
            F.col("text").alias("message"),
            _after(datetime(2024, 1, 29), conv * 104729 % 259200 + turn * 60).alias("created_at"),
        )

    @cached_property
    def chat_sessions(self) -> DataFrame:
        return (
            self.chat_history.groupBy("session_id")
            .agg(F.min("created_at").alias("created_at"), F.max("created_at").alias("updated_at"))
            .select(
                "session_id",
                (F.col("session_id").cast("bigint") % 15).alias("user_id"),
                "created_at",
                "updated_at",
            )
        )

    @cached_property
    def feed_items(self) -> DataFrame:
        """Raw feed entries: markup around the text, missing titles, unreadable dates, and
        one link in ten repeated."""
        i = F.col("article_id")
        stamp = F.date_format("published_at", "dd MMM yyyy HH:mm:ss")
        return self.articles.select(
            i.alias("item_id"),
            "source_id",
            "category_id",
            F.when(i % 17 == 0, F.lit(""))
            .otherwise(F.concat(F.lit("<b>"), "title", F.lit("</b>")))
            .alias("title"),
            F.when(i % 23 == 0, F.lit(""))
            .otherwise(F.concat(F.lit(" <p>"), "description", F.lit("</p>\n")))
            .alias("summary"),
            F.when(i % 5 == 0, F.concat(F.lit("<div>"), "description", F.lit("</div>"))).alias(
                "content"
            ),
            F.concat(
                F.lit("http://news.example/"),
                F.when(i % 10 == 9, i - 9).otherwise(i).cast("string"),
            ).alias("link"),
            F.when(i % 19 == 0, F.lit("yesterday"))
            .otherwise(F.concat(F.lit("Mon, "), stamp, F.lit(" +0900")))
            .alias("published"),
        )

    @cached_property
    def parsed_items(self) -> DataFrame:
        """Cleaned and judged feed entries; sources of even number put content first."""
        return with_reject_reason(parse_items(self.feed_items, F.col("source_id") % 2 == 0))

    @cached_property
    def fresh_articles(self) -> DataFrame:
        """All articles as if processed and not yet compared, for duplicate queries."""
        return self.articles.withColumn("is_processed", F.lit(True)).withColumn(
            "is_duplicate", F.lit(False)
        )

    @cached_property
    def broken_tables(self) -> dict[str, DataFrame]:
        """All tables, each with some rows that break every constraint it declares."""

        def unless(column: str, every: int, key: str = "article_id", other=None):
            bad = F.lit(other).cast("string") if other is None else F.lit(other)
            return F.when(F.col(key) % every == 0, bad).otherwise(F.col(column))

        extra = self.spark.sql("SELECT 1 AS category_id, 'xx' AS name UNION ALL SELECT 9, 'de' UNION ALL SELECT 8, NULL")
        s, u, chat = F.col("source_id"), F.col("user_id"), F.col("chat_id")
        feed = F.concat(F.lit("http://feeds.example/"), (s - s % 2).cast("string"))
        session = F.col("session_id")
        doubled = self.prefs.filter("pref_id % 41 = 0").withColumn("pref_id", F.col("pref_id") + 10**6)
        return {
            "categories": self.categories.unionByName(extra),
            "news_sources": self.news_sources.select(
                "source_id",
                unless("category_id", 13, "source_id", 99).alias("category_id"),
                "name",
                F.when(s % 7 != 0, feed).alias("rss_url"),
            ),
            "articles": self.articles.select(
                "article_id",
                unless("source_id", 83, other=0).alias("source_id"),
                unless("category_id", 71, other=77).alias("category_id"),
                unless("title", 89).alias("title"),
                F.when(F.col("article_id") % 10 == 9, F.lit("http://news.example/again"))
                .otherwise(F.col("url")).alias("url"),
                F.when(F.col("article_id") % 97 != 0, F.col("published_at")).alias("published_at"),
                unless("representative_id", 67, other=-1).alias("representative_id"),
            ),
            "article_chunks": self.chunks.select(
                unless("chunk_id", 53, "chunk_id", 1).alias("chunk_id"),
                unless("article_id", 61, "chunk_id", 10**9).alias("article_id"),
                "chunk_index",
                unless("content", 59, "chunk_id").alias("content"),
            ),
            "users": self.users.select(
                "user_id",
                F.concat(F.lit("u"), (u - u % 3).cast("string")).alias("email"),
                F.when(u % 11 != 0, F.lit("-")).alias("password_hash"),
            ),
            "user_category_prefs": self.prefs.unionByName(doubled).select(
                "pref_id",
                unless("user_id", 43, "pref_id", 10**9).alias("user_id"),
                unless("category_id", 47, "pref_id", 80).alias("category_id"),
                unless("weight", 37, "pref_id", 11).alias("weight"),
            ),
            "chat_sessions": self.chat_sessions.select(
                "session_id",
                F.when(session.cast("bigint") % 5 == 0, F.lit(-5).cast("bigint"))
                .otherwise(F.col("user_id")).alias("user_id"),
            ),
            "chat_history": self.chat_history.select(
                "chat_id",
                unless("session_id", 53, "chat_id", "gone").alias("session_id"),
                unless("role", 29, "chat_id").alias("role"),
                "message",
                "created_at",
            ),
            "chat_sources": self.chat_history.select(
                chat.alias("id"),
                unless("chat_id", 31, "chat_id", -1).alias("chat_id"),
                (chat % 2000).alias("article_id"),
                F.lit(1).alias("rank"),
                F.when(chat % 23 != 0, F.lit(0.5)).alias("similarity"),
            ),
        }

    @cached_property
    def questions(self) -> DataFrame:
        """Each session's last user message, asked again."""
        last = (
            self.chat_history.filter(F.col("role") == "user")
            .groupBy("session_id")
            .agg(F.max_by("message", F.struct("created_at", "chat_id")).alias("question"))
        )
        session = F.col("session_id").cast("bigint")
        vectors = self.raw("embeddings").select(
            F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector")
        )
        return last.select(
            session.alias("query_id"), "session_id", (session % 15).alias("user_id"), "question"
        ).join(vectors, "query_id")
