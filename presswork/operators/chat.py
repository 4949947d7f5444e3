"""Chat tables: history windows, session lists."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from presswork.operators.joins import checked_broadcast, top_per_group
from presswork.session import ntz

# Messages used in a prompt and shown on screen, and the date groups.
PROMPT_MESSAGES = 6
SHOWN_MESSAGES = 50
TODAY, YESTERDAY, EARLIER = "오늘", "어제", "이전"


def last_messages(history: DataFrame, n: int = PROMPT_MESSAGES) -> DataFrame:
    """The last ``n`` messages of every session, ``position`` 1 being the oldest of them."""
    newest = [F.desc("created_at"), F.desc("chat_id")]
    oldest = W.partitionBy("session_id").orderBy("created_at", "chat_id")
    return (
        top_per_group(history, ["session_id"], newest, n)
        .drop("rn")
        .withColumn("position", F.row_number().over(oldest))
    )


def sessions_by_user(sessions: DataFrame) -> DataFrame:
    """All users' sessions, newest first within a user (a range sort, no per-user task)."""
    return sessions.select("user_id", "session_id", "created_at", "updated_at").orderBy(
        "user_id", F.desc_nulls_last("updated_at"), "session_id"
    )


def session_groups(sessions: DataFrame, as_of: datetime) -> DataFrame:
    """Date group and short id per session; days begin at local midnight of ``as_of``."""
    midnight = as_of.replace(hour=0, minute=0, second=0, microsecond=0)
    updated = F.col("updated_at")
    return sessions.select(
        "user_id",
        "session_id",
        F.substring("session_id", 1, 8).alias("short_id"),
        F.when(updated >= ntz(midnight), TODAY)
        .when(updated >= ntz(midnight - timedelta(days=1)), YESTERDAY)
        .otherwise(EARLIER)
        .alias("date_group"),
    )


def prefs_with_names(prefs: DataFrame, categories: DataFrame) -> DataFrame:
    """Each user's weights with category names, ordered for display."""
    names = categories.select("category_id", F.col("name").alias("category_name"))
    return (
        prefs.join(checked_broadcast(names), "category_id")
        .select("user_id", "pref_id", "category_id", "category_name", "weight")
        .orderBy("user_id", "category_id")
    )
