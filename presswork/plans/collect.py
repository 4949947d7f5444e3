"""One collection run over landed feed files."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from presswork.operators.ingest import ingest_stats, insert_if_absent, valid, with_reject_reason
from presswork.session import stored
from presswork.sources.rss import parse_items, read_feed_files, with_section

# Entries of one batch that share a url: the first by these columns is stored.
FIRST_WINS = ("published_at", "title", "description", "source_id")


def judge_entries(
    items: DataFrame, sources: DataFrame, content_first: Sequence[int] = ()
) -> DataFrame:
    """Cleaned entries with their section and reject reason.

    ``content_first`` lists the sources whose content element beats the summary.
    """
    chosen = F.col("source_id").isin(list(content_first))
    return with_reject_reason(parse_items(with_section(items, sources), chosen))


def new_articles(judged: DataFrame, articles: DataFrame, as_of: datetime) -> DataFrame:
    return insert_first(valid(judged), articles, as_of)


def insert_first(entries: DataFrame, articles: DataFrame, as_of: datetime) -> DataFrame:
    """New article rows of valid entries, the first of each url by ``FIRST_WINS``."""
    return insert_if_absent(entries, articles, [F.asc(c) for c in FIRST_WINS], as_of)


def collect_feeds(
    spark: SparkSession,
    path: str,
    sources: DataFrame,
    articles: DataFrame,
    as_of: datetime,
    content_first: Sequence[int] = (),
) -> tuple[DataFrame, DataFrame]:
    """(article rows to append, total / saved / skipped per source)."""
    judged = judge_entries(read_feed_files(spark, path), sources, content_first)
    added = stored(new_articles(judged, articles, as_of), "new-articles")
    return added, ingest_stats(judged, added)
