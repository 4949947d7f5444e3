"""Personalised top-k chunk retrieval for a batch of questions, and what follows it.

Score of a chunk for a question: 0.7 cosine + 0.2 (weight of its category for the asking
user, 5 if none) / 10 + 0.1 published epoch / now epoch.
"""

from __future__ import annotations

from datetime import UTC, datetime

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from presswork.operators.chat import PROMPT_MESSAGES, last_messages
from presswork.operators.feed import dimensions, named_keys
from presswork.operators.joins import checked_broadcast, top_per_group
from presswork.operators.similarity import pair_dots, unit_rows
from presswork.session import stored

# Score weights, default category weight and its scale, top k.
SIMILARITY_SHARE, PREFERENCE_SHARE, RECENCY_SHARE = 0.7, 0.2, 0.1
DEFAULT_WEIGHT, WEIGHT_SCALE = 5, 10.0
TOP_K = 5

# The instruction given to the answering model, and the reply when
# nothing was found.
SYSTEM_PROMPT = """당신은 최신 뉴스를 기반으로 질문에 답변하는 뉴스 어시스턴트입니다.
    아래 뉴스 기사 내용을 참고하여 사용자의 질문에 정확하고 간결하게 답변해주세요.
    뉴스 내용에 없는 정보는 추측하지 말고, 모르는 경우 솔직하게 말해주세요.

    [참고 뉴스]
    """
NOTHING_FOUND = "관련된 최신 뉴스를 찾지 못했어요. 다른 질문을 해보시겠어요?"

# Questions up to this size (measured, weights included) are broadcast as one block. More are
# dealt to blocks of this size, which meet tiles of chunks of the other size in tasks.
QUERY_BYTES = 64 * 1024 * 1024
TILE_BYTES = 128 * 1024 * 1024
# A matrix product covers this many questions and chunks at a time.
QUESTION_TILE = 1024
CHUNK_TILE = 4096
# Scores of a matrix product this close to the k-th best are taken again one by one.
_UNSURE = 1e-9
_NO_CHUNK = np.iinfo(np.int64).max

_HITS = "query_id long, chunk_id long, article_id long, similarity double, score double"
_HITS_ARROW = pa.schema(
    [
        ("query_id", pa.int64()),
        ("chunk_id", pa.int64()),
        ("article_id", pa.int64()),
        ("similarity", pa.float64()),
        ("score", pa.float64()),
    ]
)


class _Questions:
    """Questions of one block as arrays: ids, unit vectors, weights per question."""

    def __init__(self, table: pa.Table):
        self.ids = table.column("query_id").to_numpy()
        self.unit = unit_rows(table.column("vector"))
        weights = table.column("weights").combine_chunks()
        self.ends = weights.offsets.to_numpy()
        self.category = weights.keys.to_numpy(zero_copy_only=False)
        self.weight = weights.items.to_numpy(zero_copy_only=False).astype(float)

    def preference(self, categories: np.ndarray, rows: slice) -> np.ndarray:
        """questions of ``rows`` x chunks: never more than one tile of questions at a time."""
        known, where = np.unique(categories, return_inverse=True)
        ends = self.ends[rows.start : rows.stop + 1]
        entries = slice(ends[0], ends[-1])
        category, weight = self.category[entries], self.weight[entries]
        own = np.repeat(np.arange(len(ends) - 1), np.diff(ends))
        at = np.minimum(np.searchsorted(known, category), len(known) - 1)
        met = known[at] == category
        table = np.full((len(ends) - 1, len(known)), float(DEFAULT_WEIGHT))
        table[own[met], at[met]] = weight[met]
        return table[:, where]


class _Best:
    """The k best chunks per question so far, best first; lower chunk id wins a tie.

    Matrix products only find candidates: those at or near the k-th score a question has
    reached. Their scores are computed again in a fixed order of summation, so they do not
    depend on how rows were batched.
    """

    def __init__(self, questions: _Questions, k: int, now: float):
        self.questions, self.k, self.now = questions, k, now
        shape = (len(questions.ids), k)
        self.rank_by = np.full(shape, -np.inf)  # the score, or -inf without one
        self.chunk = np.full(shape, _NO_CHUNK)
        self.article = np.zeros(shape, np.int64)
        self.similarity = np.full(shape, np.nan)

    def _score(self, similarity, preference, recency):
        return (
            similarity * SIMILARITY_SHARE + preference / WEIGHT_SCALE * PREFERENCE_SHARE + recency
        )

    def add(self, batch) -> None:
        for at in range(0, batch.num_rows, CHUNK_TILE):
            part = batch.slice(at, CHUNK_TILE)
            unit = unit_rows(part.column("embedding"))
            tile = {
                "unit": unit,
                "chunk": part.column("chunk_id").to_numpy(),
                "article": part.column("article_id").to_numpy(),
                "recency": part.column("epoch").to_numpy() / self.now * RECENCY_SHARE,
                "category": part.column("category_id").to_numpy(),
                "no_direction": ~unit.any(axis=1),
            }
            for q in range(0, len(self.questions.ids), QUESTION_TILE):
                self._add_tile(tile, slice(q, q + QUESTION_TILE))

    def _add_tile(self, tile: dict, rows: slice) -> None:
        unit = self.questions.unit[rows]
        preference = self.questions.preference(tile["category"], rows)
        rank_by = self._score(unit @ tile["unit"].T, preference, tile["recency"][None, :])
        rank_by[:, tile["no_direction"]] = -np.inf
        rank_by[~unit.any(axis=1)] = -np.inf
        floor = self.rank_by[rows, -1]
        open_ = np.flatnonzero(rank_by.max(axis=1) >= floor - _UNSURE)
        if not len(open_):
            return
        rank_by = rank_by[open_]
        cut = rank_by.shape[1] - self.k
        if cut > 0:
            floor = np.maximum(floor[open_], np.partition(rank_by, cut, axis=1)[:, cut])
        else:
            floor = floor[open_]
        q, c = np.nonzero(rank_by >= floor[:, None] - _UNSURE)
        q = open_[q]
        similarity = pair_dots(unit, tile["unit"], q, c)
        similarity[tile["no_direction"][c] | ~unit[q].any(axis=1)] = np.nan
        score = self._score(similarity, preference[q, c], tile["recency"][c])
        self._merge(
            rows.start + q,
            np.where(np.isnan(score), -np.inf, score),
            tile["chunk"][c],
            tile["article"][c],
            similarity,
        )

    def _merge(self, q, rank_by, chunk, article, similarity) -> None:
        touched = np.unique(q)
        own = np.repeat(touched, self.k)
        found = [
            np.concatenate([new, old[touched].ravel()])
            for new, old in (
                (rank_by, self.rank_by),
                (chunk, self.chunk),
                (article, self.article),
                (similarity, self.similarity),
            )
        ]
        q = np.concatenate([q, own])
        order = np.lexsort((found[1], -found[0], q))
        q = q[order]
        keep = order[np.arange(len(q)) - np.searchsorted(q, q, "left") < self.k]
        for column, table in zip(
            found, (self.rank_by, self.chunk, self.article, self.similarity)
        ):
            table[touched] = column[keep].reshape(len(touched), self.k)

    def hits(self) -> pa.Table:
        q, at = np.nonzero(self.chunk != _NO_CHUNK)
        similarity, score = self.similarity[q, at], self.rank_by[q, at]
        none = np.isnan(similarity)
        return pa.Table.from_arrays(
            [
                pa.array(self.questions.ids[q]),
                pa.array(self.chunk[q, at]),
                pa.array(self.article[q, at]),
                pa.array(similarity, mask=none),
                pa.array(score, mask=none),
            ],
            schema=_HITS_ARROW,
        )


def _with_weights(queries: DataFrame, prefs: DataFrame) -> DataFrame:
    """Attach each user's weights as a map (one entry per category at most)."""
    weights = prefs.groupBy("user_id").agg(
        F.map_from_entries(F.collect_list(F.struct("category_id", "weight"))).alias("weights")
    )
    return queries.join(weights, "user_id", "left").select("query_id", "vector", "weights")


def _now_epoch(as_of: datetime) -> float:
    return as_of.replace(tzinfo=UTC).timestamp()


def score_block(pool: DataFrame, block: Broadcast, k: int, as_of: datetime) -> DataFrame:
    """Every task scores its chunks against the one block of questions; chunks stay."""
    now = _now_epoch(as_of)

    def score(batches):
        best = _Best(_Questions(block.value), k, now)
        for batch in batches:
            best.add(batch)
        yield from best.hits().to_batches()

    return pool.mapInArrow(score, _HITS)


def score_grid(
    pool: DataFrame, asked: DataFrame, blocks: int, k: int, as_of: datetime, tile_bytes: int
) -> DataFrame:
    """Blocks of questions meet tiles of chunks, each pair in a group of its own.

    Both are dealt by hashes of their ids, so no group grows with the tables, and neither
    side passes through the driver. ``pool`` should be a stored table: it is counted first.
    """
    n, dim = pool.agg(F.count("*"), F.max(F.size("embedding"))).first()
    tiles = max(1, -(-n * 4 * (dim or 1) // tile_bytes))
    now = _now_epoch(as_of)

    def dealt(rows: DataFrame, own: str, key: str, n_own: int, other: str, n_other: int):
        copies = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n_other - 1).cast("long")))
        return rows.withColumn(own, F.pmod(F.xxhash64(key), F.lit(n_own))).withColumn(other, copies)

    def score(chunks: pa.Table, questions: pa.Table) -> pa.Table:
        if not chunks.num_rows or not questions.num_rows:
            return _HITS_ARROW.empty_table()
        best = _Best(_Questions(questions), k, now)
        for batch in chunks.to_batches():
            best.add(batch)
        return best.hits()

    left = dealt(pool, "_tile", "chunk_id", tiles, "_block", blocks)
    right = dealt(asked, "_block", "query_id", blocks, "_tile", tiles)
    key = ["_tile", "_block"]
    return left.groupBy(*key).cogroup(right.groupBy(*key)).applyInArrow(score, _HITS)


def _size(asked: DataFrame) -> tuple[int, int]:
    """Questions, and bytes of their vectors and weights."""
    entries = F.when(F.col("weights").isNotNull(), F.size("weights")).otherwise(0)
    each = F.coalesce(F.size("vector"), F.lit(0)) * 8 + entries * 16 + 16
    return asked.agg(F.count("*"), F.coalesce(F.sum(each), F.lit(0))).first()


def best_chunks(
    pool: DataFrame,
    asked: DataFrame,
    k: int,
    as_of: datetime,
    query_bytes: int = QUERY_BYTES,
    tile_bytes: int = TILE_BYTES,
) -> DataFrame:
    """The k best chunks of ``pool`` for every question (query_id, vector, weights), ranked.

    The result is stored, and a broadcast block is released when it is.
    """
    n, size = _size(asked)
    order = [F.desc_nulls_last("score"), F.asc("chunk_id")]
    if size > query_bytes:
        blocks = -(-size // query_bytes)
        hits = score_grid(stored(pool, "chunk-pool"), asked, blocks, k, as_of, tile_bytes)
        return stored(top_per_group(hits, ["query_id"], order, k, rank="rank"), "hits")
    if not n:
        empty = pool.sparkSession.createDataFrame([], _HITS)
        return empty.withColumn("rank", F.lit(0))
    shared = pool.sparkSession.sparkContext.broadcast(asked.toArrow())
    hits = score_block(pool, shared, k, as_of)
    best = stored(top_per_group(hits, ["query_id"], order, k, rank="rank"), "hits")
    shared.destroy()
    return best


def scoring_pool(
    chunks: DataFrame, articles: DataFrame, categories: DataFrame, sources: DataFrame, dims=None
) -> DataFrame:
    """Embedded chunks of servable articles with what their score takes."""
    shown = named_keys(articles, dims or dimensions(categories, sources)).select(
        "article_id",
        "category_id",
        F.unix_timestamp(F.col("published_at").cast("timestamp")).cast("double").alias("epoch"),
    )
    embedded = chunks.filter(F.col("embedding").isNotNull())
    return embedded.select("chunk_id", "article_id", "embedding").join(shown, "article_id")


def retrieve(
    chunks: DataFrame,
    articles: DataFrame,
    categories: DataFrame,
    sources: DataFrame,
    prefs: DataFrame,
    queries: DataFrame,
    as_of: datetime,
    k: int = TOP_K,
    query_bytes: int = QUERY_BYTES,
    tile_bytes: int = TILE_BYTES,
) -> DataFrame:
    """The k best chunks for every (query_id, user_id, vector), with rank and names.

    Exact: every embedded chunk of a servable article is scored. Questions of a bounded
    size are one broadcast block and chunks stay where they are; on tables of
    ``save_bucketed`` no vector moves. More questions meet the chunks in a grid of blocks
    and tiles. Only k rows per question leave a task; texts are fetched for the winners
    alone. A zero vector has no similarity and ranks last.
    """
    dims = dimensions(categories, sources)
    pool = scoring_pool(chunks, articles, categories, sources, dims)
    asked = stored(_with_weights(queries, prefs), "questions")
    # A few numbers a row; a larger set of winners, and all texts, are joined by shuffle.
    best = checked_broadcast(best_chunks(pool, asked, k, as_of, query_bytes, tile_bytes))
    texts = chunks.select("chunk_id", "content").join(best, "chunk_id")
    return (
        articles.select("article_id", "title", "url", "published_at", "category_id", "source_id")
        .join(texts, "article_id")
        .join(dims[0], "category_id")
        .join(dims[1], "source_id")
        .select(
            "query_id",
            "rank",
            "chunk_id",
            "article_id",
            "title",
            "url",
            "published_at",
            "category_name",
            F.col("section_name").alias("source_name"),
            "content",
            "similarity",
            "score",
        )
    )


def answer_sources(retrieved: DataFrame) -> DataFrame:
    """Articles behind an answer: each once, at its best chunk, ranked from 1."""
    once = top_per_group(retrieved, ["query_id", "article_id"], [F.asc("rank")], 1, rank="_first")
    by_rank = W.partitionBy("query_id").orderBy("rank")
    return once.select(
        "query_id",
        F.row_number().over(by_rank).alias("rank"),
        "article_id",
        "title",
        "url",
        "source_name",
        F.bround("similarity", 3).alias("similarity"),
    )


def prompt_context(retrieved: DataFrame) -> DataFrame:
    """Numbered news block per question, in rank order (at most k entries)."""
    entry = F.concat(
        F.lit("["),
        F.col("rank").cast("string"),
        F.lit("] "),
        F.col("title"),
        F.lit(" ("),
        F.col("source_name"),
        F.lit(", "),
        F.coalesce(F.date_format("published_at", "yyyy-MM-dd"), F.lit("")),
        F.lit(")\n"),
        F.col("content"),
    )
    entries = F.array_sort(F.collect_list(F.struct("rank", entry.alias("entry"))))
    return retrieved.groupBy("query_id").agg(
        F.array_join(F.transform(entries, lambda e: e["entry"]), "\n\n").alias("context")
    )


def build_prompts(questions: DataFrame, retrieved: DataFrame, history: DataFrame) -> DataFrame:
    """Full prompt per question (query_id, session_id, question).

    Instruction and news, the last messages of the session, then the question. Without
    any retrieved chunk there is no prompt but a fixed ``reply``.
    """
    turn = F.concat(F.lit("["), F.upper("role"), F.lit("]\n"), F.col("message"))
    recent = last_messages(
        history.join(questions.select("session_id").distinct(), "session_id", "left_semi"),
        PROMPT_MESSAGES,
    )
    turns = F.array_sort(F.collect_list(F.struct("position", turn.alias("turn"))))
    talk = recent.groupBy("session_id").agg(F.transform(turns, lambda t: t["turn"]).alias("turns"))
    joined = questions.join(prompt_context(retrieved), "query_id", "left").join(
        talk, "session_id", "left"
    )
    system = F.concat(F.lit("[SYSTEM]\n" + SYSTEM_PROMPT), F.col("context"))
    nothing = F.array().cast("array<string>")
    parts = F.concat(
        F.array(system),
        F.coalesce("turns", nothing),
        F.array(F.concat(F.lit("[USER]\n"), F.col("question"))),
    )
    found = F.col("context").isNotNull()
    return joined.select(
        "query_id",
        "session_id",
        F.when(found, F.array_join(parts, "\n\n")).alias("prompt"),
        F.when(~found, F.lit(NOTHING_FOUND)).alias("reply"),
    )
