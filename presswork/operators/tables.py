"""Table changes as functions from tables to tables.

Marks, flags, upserts and inserts of what is absent can be run again safely. Appending
messages and sources adds rows each time; run these once per batch.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from presswork.operators.joins import absent_from, assign_ids, checked_broadcast, top_per_group
from presswork.session import cut_lineage, ntz, stored


def mark_processed(articles: DataFrame, processed: DataFrame) -> DataFrame:
    """Set the flag for exactly the ids that were worked on.

    Going by id, not by repeating the selection, leaves rows alone that arrived while
    the job ran.
    """
    ids = processed.select("article_id", F.lit(True).alias("_hit")).distinct()
    return articles.join(checked_broadcast(ids), "article_id", "left").select(
        *[
            (F.col("is_processed") | F.col("_hit").isNotNull()).alias(c)
            if c == "is_processed"
            else F.col(c)
            for c in articles.columns
        ]
    )


def apply_duplicates(articles: DataFrame, pairs: DataFrame) -> DataFrame:
    """Flag (duplicate_id, representative_id) pairs; rows already flagged keep what they have."""
    found = pairs.select(
        F.col("duplicate_id").alias("article_id"), F.col("representative_id").alias("_rep")
    )
    hit = F.col("_rep").isNotNull() & ~F.col("is_duplicate")
    changed = {
        "is_duplicate": F.col("is_duplicate") | hit,
        "representative_id": F.when(hit, F.col("_rep")).otherwise(F.col("representative_id")),
    }
    return articles.join(checked_broadcast(found), "article_id", "left").select(
        *[changed[c].alias(c) if c in changed else F.col(c) for c in articles.columns]
    )


def append_chunks(chunks: DataFrame, new: DataFrame, as_of: datetime) -> DataFrame:
    """Rows to append, created at ``as_of``: chunks whose (article, index) is not stored,
    numbered onwards.

    The new chunks are stored once; looking them up and numbering read them again.
    """
    key = ["article_id", "chunk_index"]
    new = stored(new, "new-chunks")
    added = assign_ids(absent_from(new, chunks, key), key, "chunk_id", chunks)
    return added.withColumn("created_at", ntz(as_of))


def embedding_backlog(chunks: DataFrame) -> DataFrame:
    return chunks.filter(F.col("embedding").isNull())


def write_embeddings(chunks: DataFrame, encoded: DataFrame) -> DataFrame:
    """Fill missing embeddings from (chunk_id, embedding); present ones stay.

    Pass a stored frame: it is measured before the join.
    """
    filled = encoded.select("chunk_id", F.col("embedding").alias("_new"))
    return chunks.join(checked_broadcast(filled), "chunk_id", "left").select(
        *[
            F.coalesce("embedding", "_new").alias(c) if c == "embedding" else F.col(c)
            for c in chunks.columns
        ]
    )


def upsert_prefs(
    prefs: DataFrame, changes: DataFrame, as_of: datetime, numbered_after: DataFrame | None = None
) -> DataFrame:
    """Set weights from (user_id, category_id, weight, seq); the highest ``seq`` wins.

    Known pairs keep their ``pref_id`` and creation time, new ones are numbered onwards and
    created at ``as_of``. If ``prefs`` is a part of the table, ``numbered_after`` holds the
    highest ``pref_id`` of the whole.
    """
    key = ["user_id", "category_id"]
    last = cut_lineage(
        top_per_group(changes, key, [F.desc("seq")], 1).select(
            *key, F.col("weight").alias("_weight")
        )
    )
    kept = prefs.join(checked_broadcast(last), key, "left").select(
        *[
            F.coalesce("_weight", "weight").alias(c) if c == "weight" else F.col(c)
            for c in prefs.columns
        ]
    )
    existing = prefs if numbered_after is None else numbered_after
    added = assign_ids(absent_from(last, prefs, key), key, "pref_id", existing)
    added = added.withColumnRenamed("_weight", "weight")
    if "created_at" in prefs.columns:
        added = added.withColumn("created_at", ntz(as_of))
    return kept.unionByName(added)


def changed_articles(before: DataFrame, after: DataFrame) -> DataFrame:
    """Rows of ``after`` whose flags or representative differ from ``before``, whole."""
    flags = ["is_processed", "is_duplicate", "representative_id"]
    old = before.select("article_id", F.struct(*flags).alias("_old"))
    new = after.withColumn("_new", F.struct(*flags))
    different = ~F.col("_new").eqNullSafe(F.col("_old"))
    return new.join(old, "article_id", "left").filter(different).drop("_old", "_new")


def upsert_sessions(sessions: DataFrame, touches: DataFrame) -> DataFrame:
    """Open or touch sessions from (session_id, user_id, touched_at).

    A known session only moves ``updated_at``; its owner stays. A new one belongs to
    the first user who touched it.
    """
    grouped = cut_lineage(
        touches.groupBy("session_id").agg(
            F.min(F.struct("touched_at", "user_id")).alias("_first"),
            F.max("touched_at").alias("_last"),
        )
    )
    kept = sessions.join(
        checked_broadcast(grouped.select("session_id", "_last")), "session_id", "left"
    ).select(
        "session_id",
        "user_id",
        "created_at",
        F.coalesce("_last", "updated_at").alias("updated_at"),
    )
    opened = absent_from(grouped, sessions, ["session_id"]).select(
        "session_id",
        F.col("_first.user_id").alias("user_id"),
        F.col("_first.touched_at").alias("created_at"),
        F.col("_last").alias("updated_at"),
    )
    return kept.unionByName(opened)


MESSAGE = ["chat_id", "session_id", "role", "message", "created_at"]


def number_messages(history: DataFrame, messages: DataFrame, tie: list[str]) -> DataFrame:
    """``messages`` with new ids; ``tie`` tells those of one session, time and role apart."""
    return assign_ids(messages, ["session_id", "created_at", "role", *tie], "chat_id", history)


def append_messages(history: DataFrame, messages: DataFrame) -> DataFrame:
    """Rows to append to the history, with new ids.

    ``messages`` has session_id, role, message, created_at; equal ones of one session are
    numbered in the order of their texts.
    """
    return number_messages(history, messages, ["message"]).select(*MESSAGE)


def append_sources(stored: DataFrame | None, sources: DataFrame) -> DataFrame:
    """Rows to append to the answer sources: (chat_id, article_id, rank, similarity) with ids."""
    return assign_ids(sources, ["chat_id", "rank"], "id", stored).select(
        "id", "chat_id", "article_id", "rank", "similarity"
    )
