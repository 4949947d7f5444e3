"""Validation, first-wins insert and counters for feed entries."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from presswork.functions.text import strip
from presswork.operators.joins import absent_from, assign_ids, top_per_group
from presswork.session import ntz, stored

# Shortest description accepted at ingest, and for embedding.
MIN_DESCRIPTION = 50
MIN_EMBED_DESCRIPTION = 20

MISSING_FIELD = "missing field"
SHORT_DESCRIPTION = "short description"


def with_reject_reason(items: DataFrame) -> DataFrame:
    """Mark entries that may not be stored; NULL means valid. Nothing is dropped."""

    def empty(name):
        return F.coalesce(F.col(name), F.lit("")) == ""

    missing = empty("title") | empty("url") | F.col("published_at").isNull()
    length = F.length(strip(F.coalesce(F.col("description"), F.lit(""))))
    return items.withColumn(
        "reject_reason",
        F.when(missing, MISSING_FIELD).when(length < MIN_DESCRIPTION, SHORT_DESCRIPTION),
    )


def valid(items: DataFrame) -> DataFrame:
    return items.filter(F.col("reject_reason").isNull()).drop("reject_reason")


def first_per_url(items: DataFrame, order: Sequence[Column]) -> DataFrame:
    """One entry per url, the first by ``order``; a url repeated very often is cut to
    one row per task before the shuffle."""
    return top_per_group(items, ["url"], order, 1).drop("rn")


def insert_if_absent(
    items: DataFrame, articles: DataFrame, order: Sequence[Column], as_of: datetime
) -> DataFrame:
    """New article rows, created at ``as_of``: valid entries whose url is neither stored nor
    earlier in the batch.

    The cleaned batch is stored once; looking up urls and numbering rows read it again.
    """
    batch = stored(first_per_url(items, order), "feed-batch")
    new = absent_from(batch, articles, ["url"])
    return assign_ids(new, ["url"], "article_id", articles).select(
        "article_id",
        "source_id",
        "category_id",
        "title",
        "description",
        "url",
        "published_at",
        F.lit(False).alias("is_processed"),
        F.lit(False).alias("is_duplicate"),
        F.lit(None).cast("bigint").alias("representative_id"),
        ntz(as_of).alias("created_at"),
    )


def ingest_stats(items: DataFrame, inserted: DataFrame) -> DataFrame:
    """Entries, stored and skipped per source; invalid and already known both count as skipped."""
    total = items.groupBy("source_id").agg(F.count("*").alias("total"))
    saved = inserted.groupBy("source_id").agg(F.count("*").alias("saved"))
    return total.join(saved, "source_id", "left").select(
        "source_id",
        "total",
        F.coalesce("saved", F.lit(0)).alias("saved"),
        (F.col("total") - F.coalesce("saved", F.lit(0))).alias("skipped"),
    )


def awaiting_embedding(articles: DataFrame) -> DataFrame:
    """Articles still to be chunked and embedded."""
    return articles.filter(
        ~F.col("is_processed")
        & ~F.col("is_duplicate")
        & F.col("description").isNotNull()
        & (F.length("description") >= MIN_EMBED_DESCRIPTION)
    )


def unprocessed_count(articles: DataFrame) -> DataFrame:
    return awaiting_embedding(articles).agg(F.count("*").alias("n_unprocessed"))


def partition_bounds(articles: DataFrame) -> DataFrame:
    """Lowest and highest id and the count of what awaits embedding."""
    return awaiting_embedding(articles).agg(
        F.min("article_id").alias("min_id"),
        F.max("article_id").alias("max_id"),
        F.count("*").alias("n_articles"),
    )


def newest_unprocessed(articles: DataFrame, limit: int = 5000) -> DataFrame:
    """The newest articles awaiting embedding (the benchmark's work list)."""
    return (
        awaiting_embedding(articles)
        .orderBy(F.desc_nulls_last("published_at"), "article_id")
        .limit(limit)
    )
