"""Articles to chunk rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from presswork.functions.text import (
    MAX_CHUNK_CHARS,
    MIN_CHUNK_CHARS,
    OVERLAP_CHARS,
    chunk_text,
    full_text,
)
from presswork.operators.joins import spread


def chunk_articles(
    articles: DataFrame, max_len: int = MAX_CHUNK_CHARS, overlap: int = OVERLAP_CHARS
) -> DataFrame:
    """(article_id, chunk_index, content) of title and description.

    The index counts all chunks, so dropping one that is too short leaves a gap, which
    may be chunk 0.
    """
    text = full_text(F.col("title"), F.col("description"))
    # The outer form keeps Catalyst from adding a size check that runs the fold again.
    exploded = spread(articles, "article_id").select(
        "article_id",
        F.posexplode_outer(chunk_text(text, max_len, overlap)).alias("chunk_index", "content"),
    )
    return exploded.filter(F.length("content") > MIN_CHUNK_CHARS)
