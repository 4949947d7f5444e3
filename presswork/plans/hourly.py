"""The hourly run: chunk and embed what is new, then mark duplicates."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession

from presswork.functions.encoder import HASHED, EncoderSpec, embed
from presswork.operators.chunking import chunk_articles
from presswork.operators.dedup import THRESHOLD, WINDOW_HOURS, dedup_candidates, elect_duplicates
from presswork.operators.ingest import awaiting_embedding
from presswork.operators.tables import (
    append_chunks,
    apply_duplicates,
    changed_articles,
    mark_processed,
)
from presswork.session import scratch_path, scratch_scope, stored
from presswork.sources.tables import first_chunks, save_chunks, update_articles


@dataclass(frozen=True)
class HourlyResult:
    articles: DataFrame
    changed: DataFrame
    new_chunks: DataFrame
    duplicates: DataFrame


def run_hourly(
    articles: DataFrame,
    chunks: DataFrame,
    as_of: datetime,
    encoder: EncoderSpec = HASHED,
    threshold: float = THRESHOLD,
    hours: int = WINDOW_HOURS,
) -> HourlyResult | None:
    """None if nothing awaits embedding, in which case the duplicate step is skipped too.

    ``articles`` of the result is the whole updated table, ``changed`` its rows that are to
    be stored; ``new_chunks`` are rows to append. New chunks are written to the shared folder once, since encoding is the
    expensive part and both steps read them.
    """
    waiting = awaiting_embedding(articles)
    if waiting.isEmpty():
        return None
    spark = articles.sparkSession
    path = scratch_path(spark, "new-chunks")
    new = append_chunks(chunks, chunk_articles(waiting), as_of)
    save_chunks(embed(new, "content", spec=encoder), path)
    new_chunks = spark.read.parquet(path)
    processed = mark_processed(articles, waiting)
    vectors = first_chunks(chunks).unionByName(first_chunks(new_chunks))
    duplicates = elect_duplicates(dedup_candidates(processed, vectors, as_of, hours), threshold)
    updated = apply_duplicates(processed, duplicates)
    return HourlyResult(
        updated, changed_articles(articles, updated), new_chunks.drop("first_chunk"), duplicates
    )


def store_hourly(
    spark: SparkSession, articles_path: str, chunks_path: str, as_of: datetime, **options
) -> bool:
    """The hourly run on tables of ``save_articles`` and ``save_chunks``; False if idle.

    Appends the new chunks and rewrites the days in which articles changed. Chunks go first:
    a run that fails in between finds them again and adds none twice.
    """
    with scratch_scope(spark):
        articles = spark.read.parquet(articles_path).drop("published_day")
        result = run_hourly(articles, spark.read.parquet(chunks_path), as_of, **options)
        if result is None:
            return False
        changed = stored(result.changed, "changed-articles")
        save_chunks(result.new_chunks, chunks_path, mode="append")
        update_articles(spark, articles_path, changed)
    return True
