"""Near-duplicate stories across publishers and their representatives.

The rule, per category and in time order: an article becomes a duplicate of the
earliest representative from another source whose embedding has cosine >= t with
its own; otherwise it is a representative itself.
"""

from __future__ import annotations

from datetime import datetime
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from presswork.operators.feed import published_within
from presswork.operators.joins import checked_broadcast, join_hot_key
from presswork.operators.similarity import first_hits, first_neighbours, micros, place
from presswork.session import cut_lineage, stored
from presswork.sources.tables import first_chunks

# Cosine threshold and look-back of the hourly run.
THRESHOLD = 0.75
WINDOW_HOURS = 24

# Earlier neighbours listed per node at a time.
LISTED = 16
# Categories with up to this many undecided links are settled in one task.
SETTLE_LINKS = 500_000

_COPY_KEY = ["category_id", "source_id", "h1", "h2"]


def dedup_candidates(
    articles: DataFrame, chunks: DataFrame, as_of: datetime, hours: int = WINDOW_HOURS
) -> DataFrame:
    """Processed, unflagged, recent articles with the embedding of their chunk 0.

    Articles whose chunk 0 is missing (too short to keep) or not embedded take no part.
    """
    rows = published_within(articles, as_of, hours).filter(
        F.col("is_processed") & ~F.col("is_duplicate")
    )
    recent = rows.select("article_id", "category_id", "source_id", "published_at")
    # With few recent articles the stored vectors are filtered where they lie.
    vectors = first_chunks(chunks).select("article_id", F.col("embedding").alias("vec"))
    return vectors.join(checked_broadcast(recent), "article_id").select(*recent.columns, "vec")


def _keyed(candidates: DataFrame) -> DataFrame:
    """Time in microseconds, and two independent 64-bit hashes standing for the vector."""
    return candidates.select(
        "article_id",
        "category_id",
        "source_id",
        micros(F.col("published_at")).alias("at"),
        F.xxhash64("vec").alias("h1"),
        F.xxhash64(F.lit("presswork"), "vec").alias("h2"),
        "vec",
    )


def _distinct_copies(keyed: DataFrame) -> DataFrame:
    """One node per (category, source, vector): the earliest such article.

    Articles of one source with the same vector have the same neighbours and are never
    compared with each other, so all that matters of them is the first one, and later
    whether they come after the node's earliest foreign representative. A group of exact
    copies shrinks in the map-side aggregate to one row per source.
    """
    return (
        keyed.groupBy(*_COPY_KEY)
        .agg(
            F.min(F.struct("at", "article_id")).alias("first"),
            F.any_value("vec").alias("vec"),
        )
        .select(
            F.col("first.article_id").alias("node_id"),
            F.col("first.at").alias("at"),
            *_COPY_KEY,
            "vec",
        )
    )


def _spread_to_articles(keyed: DataFrame, nodes: DataFrame, hits: DataFrame) -> DataFrame:
    """Articles that come after their node's earliest hit, with that hit."""
    by_key = nodes.select("node_id", *_COPY_KEY).join(hits, "node_id").drop("node_id")
    after = (F.col("at") > F.col("hit_at")) | (
        (F.col("at") == F.col("hit_at")) & (F.col("article_id") > F.col("hit_id"))
    )
    return join_hot_key(keyed.drop("vec"), by_key, _COPY_KEY).filter(after)


def similar_pairs(candidates: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """For each article with an earlier look-alike at another source, the earliest one.

    One row per article, not one per pair: in a group of near copies the pair list
    would be quadratic.
    """
    keyed = stored(_keyed(candidates), "keyed")
    nodes = place(stored(_distinct_copies(keyed), "nodes"), threshold)
    hits = cut_lineage(first_neighbours(nodes, threshold, False)).drop("category_id", "at")
    return _spread_to_articles(keyed, nodes, hits).select(
        "article_id", F.col("hit_id").alias("first_similar_id"), "similarity"
    )


def _settle(rows: pd.DataFrame) -> pd.DataFrame:
    """The sequential rule on the lists of one category, as far as they reach.

    ``rows`` has a row per undecided node and listed neighbour that is still open, or one
    without a neighbour. Answers node_id and is_rep for nodes that it can decide.
    """
    state: dict[int, bool] = {}
    ordered = rows.sort_values(["at", "node_id"], kind="stable")
    nodes, complete, linked, listed = (
        ordered[c].to_numpy() for c in ("node_id", "complete", "linked", "hit_id")
    )
    starts = np.flatnonzero(np.concatenate(([True], nodes[1:] != nodes[:-1])))
    for start, end in zip(starts, [*starts[1:], len(nodes)]):
        near = [state.get(x) for x in listed[start:end][linked[start:end]].tolist()]
        if True in near:
            state[int(nodes[start])] = False
        elif complete[start] and None not in near:
            state[int(nodes[start])] = True
    return pd.DataFrame(
        {
            "node_id": np.fromiter(state.keys(), np.int64, len(state)),
            "is_rep": np.fromiter(state.values(), bool, len(state)),
        }
    )


def _round(waiting: DataFrame, links: DataFrame) -> DataFrame:
    """Decisions that follow from the lists at hand, as (node_id, is_rep).

    ``waiting`` are the undecided nodes (category_id, node_id, at, complete), ``links`` their
    listed neighbours that are undecided too. Categories with few links are settled in a
    task each, by the rule itself; in others, nodes without an open neighbour are decided,
    round by round.
    """
    # No nulls: ids stay whole numbers in pandas.
    rows = waiting.join(links.withColumn("linked", F.lit(True)), "node_id", "left").na.fill(
        {"linked": False, "hit_id": 0}
    )
    sizes = rows.groupBy("category_id").agg(F.count("*").alias("n"))
    few = sizes.filter(F.col("n") <= SETTLE_LINKS).select("category_id")
    settled = (
        rows.join(F.broadcast(few), "category_id", "left_semi")
        .groupBy("category_id")
        .applyInPandas(_settle, "node_id long, is_rep boolean")
    )
    free = (
        waiting.join(F.broadcast(few), "category_id", "left_anti")
        .filter("complete")
        .join(links.select("node_id").distinct(), "node_id", "left_anti")
        .select("node_id", F.lit(True).alias("is_rep"))
    )
    return settled.unionByName(free)


def elect_duplicates(candidates: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(duplicate_id, representative_id, similarity) under the rule above.

    Vectors are compared once: every node gets the list of its first ``LISTED`` earlier
    neighbours. The sequential rule then runs on ids. A node is a duplicate once a listed
    neighbour is a representative, and a representative once all its neighbours are
    duplicates. If a full list holds nothing but duplicates, further neighbours may follow:
    only such nodes go back to the vectors, against nodes that are no duplicates. The
    earliest undecided node can always be decided, so the rounds end. All state is stored,
    so a lost executor costs one round.
    """
    keyed = stored(_keyed(candidates), "keyed")
    nodes = place(stored(_distinct_copies(keyed), "nodes"), threshold)
    lists = stored(first_neighbours(nodes, threshold, True, LISTED), "neighbours")
    known = [lists]
    held = lists.groupBy("category_id", "node_id", "at").agg(
        (F.count("*") < LISTED).alias("complete")
    )
    waiting = stored(held, "waiting")
    # A neighbour without a list has no earlier neighbour: it is a representative.
    free = lists.select(F.col("hit_id").alias("node_id")).join(waiting, "node_id", "left_anti")
    news = stored(free.distinct().withColumn("is_rep", F.lit(True)), "decided")
    links = lists.select("node_id", "hit_id")
    duplicates = []
    while True:
        # What was decided last closes links, and turns their nodes into duplicates.
        told = links.join(news.withColumnsRenamed({"node_id": "hit_id", "is_rep": "hit_is_rep"}), "hit_id", "left")
        told = stored(told, "links")
        absorbed = stored(
            told.filter("hit_is_rep").select("node_id").distinct(), "absorbed"
        )
        duplicates.append(absorbed)
        waiting = stored(waiting.join(absorbed, "node_id", "left_anti"), "waiting")
        links = told.filter(F.col("hit_is_rep").isNull()).select("node_id", "hit_id")
        links = stored(links.join(absorbed, "node_id", "left_anti"), "links")
        # The newly absorbed close links in turn before anything else is looked at.
        gone = absorbed.withColumnRenamed("node_id", "hit_id")
        links = stored(links.join(gone, "hit_id", "left_anti"), "links")
        if waiting.isEmpty():
            break
        news = stored(_round(waiting, links), "decided")
        if news.isEmpty():
            news, waiting, links = _look_further(nodes, waiting, links, duplicates, known, threshold)
            continue
        duplicates.append(news.filter(~F.col("is_rep")).select("node_id"))
        waiting = stored(waiting.join(news, "node_id", "left_anti"), "waiting")
        links = links.join(news.select("node_id"), "node_id", "left_anti")
        if len(duplicates) >= 16:
            duplicates = [cut_lineage(reduce(DataFrame.unionByName, duplicates))]
    gone = stored(reduce(DataFrame.unionByName, duplicates), "duplicates")
    best = F.min(F.struct("hit_at", "hit_id", "similarity")).alias("b")
    hits = (
        reduce(DataFrame.unionByName, known)
        .join(gone.withColumnRenamed("node_id", "hit_id"), "hit_id", "left_anti")
        .groupBy("node_id")
        .agg(best)
        .select("node_id", "b.*")
    )
    pairs = _spread_to_articles(keyed, nodes, cut_lineage(hits)).select(
        F.col("article_id").alias("duplicate_id"),
        F.col("hit_id").alias("representative_id"),
        "similarity",
    )
    return cut_lineage(pairs)


def _look_further(nodes, waiting, links, duplicates, known, threshold):
    """New lists for nodes whose full lists hold nothing but duplicates.

    Answers what is known of the new neighbours, all waiting nodes and their links, and adds
    the lists to ``known``.
    """
    gone = stored(reduce(DataFrame.unionByName, duplicates), "duplicates")
    duplicates[:] = [gone]
    stuck = stored(
        waiting.filter(~F.col("complete")).join(
            links.select("node_id").distinct(), "node_id", "left_anti"
        ),
        "stuck",
    )
    found = stored(
        first_hits(
            nodes.join(stuck, "node_id", "left_semi"),
            nodes.join(gone, "node_id", "left_anti"),
            *(threshold, True, LISTED),
        ),
        "neighbours",
    )
    known.append(found)
    counted = found.groupBy("node_id").agg((F.count("*") < LISTED).alias("complete"))
    again = stuck.drop("complete").join(counted, "node_id", "left").withColumn(
        "complete", F.coalesce("complete", F.lit(True))
    )
    others = waiting.join(stuck, "node_id", "left_anti")
    both = stored(others.unionByName(again.select(*others.columns)), "waiting")
    new = found.select("node_id", "hit_id")
    settled = new.select(F.col("hit_id").alias("node_id")).join(both, "node_id", "left_anti")
    news = stored(settled.distinct().withColumn("is_rep", F.lit(True)), "decided")
    return news, both, links.unionByName(new)


def dedup_stats(candidates: DataFrame, duplicates: DataFrame) -> DataFrame:
    """Compared and duplicate articles per category."""
    flagged = duplicates.select(F.col("duplicate_id").alias("article_id"), F.lit(1).alias("hit"))
    return (
        candidates.select("article_id", "category_id")
        .join(flagged, "article_id", "left")
        .groupBy("category_id")
        .agg(F.count("*").alias("n_compared"), F.count("hit").alias("n_duplicates"))
    )
