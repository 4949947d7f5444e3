"""A batch of chat turns, before and after the answering model."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from presswork.functions.encoder import HASHED, EncoderSpec, embed
from presswork.operators import retrieval, tables
from presswork.session import ntz, stored


@dataclass(frozen=True)
class OpenTurns:
    sessions: DataFrame
    messages: DataFrame
    prompts: DataFrame
    sources: DataFrame


def encode_questions(questions: DataFrame, encoder: EncoderSpec = HASHED) -> DataFrame:
    """Add ``vector`` with the encoder that made the chunk embeddings."""
    return embed(questions, "question", "vector", spec=encoder)


def open_turns(
    questions: DataFrame,
    sessions: DataFrame,
    history: DataFrame,
    chunks: DataFrame,
    articles: DataFrame,
    categories: DataFrame,
    sources: DataFrame,
    prefs: DataFrame,
    as_of: datetime,
    k: int = retrieval.TOP_K,
) -> OpenTurns:
    """Everything up to the model call, for (query_id, session_id, user_id, question, vector).

    ``history`` is the table before this batch, so a prompt never holds its own question.
    ``sessions`` of the result is the whole updated table, ``messages`` are rows to append.
    """
    now = ntz(as_of)
    found = stored(
        retrieval.retrieve(
            chunks, articles, categories, sources, prefs,
            questions.select("query_id", "user_id", "vector"), as_of, k,
        ),
        "retrieved",
    )
    asked = questions.select(
        "session_id", F.lit("user").alias("role"), F.col("question").alias("message"),
        now.alias("created_at"),
    )
    touches = questions.select("session_id", "user_id", now.alias("touched_at"))
    return OpenTurns(
        tables.upsert_sessions(sessions, touches),
        tables.append_messages(history, asked),
        retrieval.build_prompts(questions, found, history),
        retrieval.answer_sources(found),
    )


def close_turns(
    answers: DataFrame,
    history: DataFrame,
    sources: DataFrame,
    stored_sources: DataFrame | None,
    as_of: datetime,
) -> tuple[DataFrame, DataFrame]:
    """Rows to append for (query_id, session_id, answer): messages and their ranked sources.

    ``history`` holds the questions already. An answer without sources stores none. A
    session may have several turns in a batch; they are numbered by query.
    """
    said = answers.select(
        "query_id", "session_id", F.lit("assistant").alias("role"),
        F.col("answer").alias("message"), ntz(as_of).alias("created_at"),
    )
    numbered = stored(tables.number_messages(history, said, ["query_id"]), "answers")
    messages = numbered.select(*tables.MESSAGE)
    cited = numbered.select("chat_id", "query_id").join(sources, "query_id")
    return messages, tables.append_sources(stored_sources, cited)
