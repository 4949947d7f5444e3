"""Table schemas. Timestamps are naive local wall time at rest."""

from pyspark.sql import types as T

_S, _I, _L, _B = T.StringType(), T.IntegerType(), T.LongType(), T.BooleanType()
_TS, _D = T.TimestampNTZType(), T.DoubleType()


def _table(*fields):
    return T.StructType([T.StructField(n, t, nullable) for n, t, nullable in fields])


CATEGORIES = _table(("category_id", _I, False), ("name", _S, False))

NEWS_SOURCES = _table(
    ("source_id", _I, False),
    ("category_id", _I, False),
    ("name", _S, False),
    ("rss_url", _S, False),
    ("is_active", _B, True),
)

ARTICLES = _table(
    ("article_id", _L, False),
    ("source_id", _I, False),
    ("category_id", _I, False),
    ("title", _S, False),
    ("description", _S, True),
    ("url", _S, False),
    ("published_at", _TS, False),
    ("is_processed", _B, True),
    ("is_duplicate", _B, True),
    ("representative_id", _L, True),
    ("created_at", _TS, True),
)

ARTICLE_CHUNKS = _table(
    ("chunk_id", _L, False),
    ("article_id", _L, False),
    ("chunk_index", _I, False),
    ("content", _S, False),
    ("embedding", T.ArrayType(T.FloatType()), True),
    ("created_at", _TS, True),
)

USERS = _table(
    ("user_id", _L, False),
    ("email", _S, False),
    ("password_hash", _S, False),
    ("nickname", _S, True),
    ("created_at", _TS, True),
)

USER_CATEGORY_PREFS = _table(
    ("pref_id", _L, False),
    ("user_id", _L, False),
    ("category_id", _I, False),
    ("weight", _I, False),
    ("created_at", _TS, True),
)

CHAT_SESSIONS = _table(
    ("session_id", _S, False),
    ("user_id", _L, False),
    ("created_at", _TS, True),
    ("updated_at", _TS, True),
)

CHAT_HISTORY = _table(
    ("chat_id", _L, False),
    ("session_id", _S, False),
    ("role", _S, False),
    ("message", _S, False),
    ("created_at", _TS, True),
)

CHAT_SOURCES = _table(
    ("id", _L, False),
    ("chat_id", _L, False),
    ("article_id", _L, False),
    ("rank", _I, False),
    ("similarity", _D, False),
)

TABLES = {
    "categories": CATEGORIES,
    "news_sources": NEWS_SOURCES,
    "articles": ARTICLES,
    "article_chunks": ARTICLE_CHUNKS,
    "users": USERS,
    "user_category_prefs": USER_CATEGORY_PREFS,
    "chat_sessions": CHAT_SESSIONS,
    "chat_history": CHAT_HISTORY,
    "chat_sources": CHAT_SOURCES,
}

# Primary keys are the first columns; these are unique besides.
UNIQUE = {
    "categories": [("name",)],
    "news_sources": [("rss_url",)],
    "articles": [("url",)],
    "users": [("email",)],
    "user_category_prefs": [("user_id", "category_id")],
}

# (table, column, table referred to, its column)
REFERENCES = [
    ("news_sources", "category_id", "categories", "category_id"),
    ("articles", "source_id", "news_sources", "source_id"),
    ("articles", "category_id", "categories", "category_id"),
    ("articles", "representative_id", "articles", "article_id"),
    ("article_chunks", "article_id", "articles", "article_id"),
    ("user_category_prefs", "user_id", "users", "user_id"),
    ("user_category_prefs", "category_id", "categories", "category_id"),
    ("chat_sessions", "user_id", "users", "user_id"),
    ("chat_history", "session_id", "chat_sessions", "session_id"),
    ("chat_sources", "chat_id", "chat_history", "chat_id"),
    ("chat_sources", "article_id", "articles", "article_id"),
]

# (table, column, lowest, highest)
RANGES = [("user_category_prefs", "weight", 1, 10)]
