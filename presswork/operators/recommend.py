"""Preference-weighted feeds for all users in one plan."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from presswork.operators.feed import (
    dimensions,
    fetch,
    named_keys,
    newest_days,
    newest_first,
)
from presswork.operators.joins import BROADCAST_ROWS, GROUP_LIMIT, join_hot_key, top_per_group
from presswork.session import cut_lineage, stored

# Readers without preferences draw from a bucket that holds every category.
ALL_CATEGORIES = 0

_PICKED = ["user_id", "weight", "pref_rank", "bucket_rank", "article_id"]


def allocation(prefs: DataFrame, limit: int) -> DataFrame:
    """Slots per (user, category), heaviest category first.

    Each category but the last gets its share of ``limit`` rounded half to even and
    at least one; the last one gets what is left, at least none. Only a user's own
    preferences meet in a window, so groups stay as small as the category list.
    """
    by_weight = W.partitionBy("user_id").orderBy(F.desc("weight"), F.asc("category_id"))
    everything = W.partitionBy("user_id")
    share = F.greatest(
        F.lit(1), F.bround(F.lit(limit) * F.col("weight") / F.col("total_weight")).cast("int")
    )
    return (
        prefs.select("user_id", "category_id", "weight")
        .withColumn("pref_rank", F.row_number().over(by_weight))
        .withColumn("total_weight", F.sum("weight").over(everything))
        .withColumn("n_prefs", F.count("*").over(everything))
        .withColumn("share", share)
        .withColumn("is_last", F.col("pref_rank") == F.col("n_prefs"))
        .withColumn(
            "others", F.sum(F.when(~F.col("is_last"), F.col("share"))).over(everything)
        )
        .withColumn(
            "slots",
            F.when(
                F.col("is_last"),
                F.greatest(F.lit(0), F.lit(limit) - F.coalesce("others", F.lit(0))),
            )
            .otherwise(F.col("share"))
            .cast("int"),
        )
        .select("user_id", "category_id", "weight", "pref_rank", "slots")
    )


def _newest_ranked(articles: DataFrame, dims: tuple, n_categories: int, depth: int) -> DataFrame:
    """The ``depth`` newest articles per category, ranked; stored, as it is used repeatedly.

    On a table laid out by day, only days in which some category may still need more are read.
    """

    def all_deep(part: DataFrame) -> bool:
        sizes = named_keys(part, dims).groupBy("category_id").count()
        return sizes.filter(F.col("count") >= depth).count() >= n_categories

    keys = named_keys(newest_days(articles, all_deep), dims)
    rows = keys.select(F.col("category_id").alias("bucket"), "article_id", "published_at")
    return cut_lineage(top_per_group(rows, ["bucket"], newest_first(), depth))


def _interleave(picked: DataFrame) -> DataFrame:
    """Round robin: first of each category in preference order, then the seconds, ..."""
    turn = W.partitionBy("user_id").orderBy("bucket_rank", "pref_rank")
    return picked.withColumn("position", F.row_number().over(turn))


def recommend(
    articles: DataFrame,
    categories: DataFrame,
    sources: DataFrame,
    users: DataFrame,
    prefs: DataFrame,
    limit: int = 9,
    page: int = 1,
    seen: DataFrame | None = None,
) -> DataFrame:
    """One page per user: newest articles by category share, interleaved.

    Paging skips ``(page - 1) * limit`` articles in *each* category. ``seen`` holds
    (user_id, article_id) pairs to leave out before ranking; users without
    preferences get the latest page and ignore it.

    A category is ranked once for all users, on narrow columns and only as deep as a
    page can reach, which Spark enforces before the shuffle. Users pick by rank range,
    and texts are read for the picked articles alone.
    """
    offset = (page - 1) * limit
    n_categories = categories.count()
    dims = dimensions(categories, sources)
    weighted = allocation(prefs, limit).withColumnRenamed("category_id", "bucket")
    without = (
        users.select("user_id")
        .distinct()
        .join(prefs.select("user_id").distinct(), "user_id", "left_anti")
        .select(
            "user_id",
            F.lit(ALL_CATEGORIES).alias("bucket"),
            F.lit(None).cast("int").alias("weight"),
            F.lit(1).alias("pref_rank"),
            F.lit(limit).alias("slots"),
        )
    )
    # The newest of all are among the newest of each category.
    ranked = _newest_ranked(articles, dims, n_categories, offset + limit)
    everything = W.orderBy(*newest_first())
    newest = (
        ranked.withColumn("rn", F.row_number().over(everything))  # n_categories x page rows
        .filter(F.col("rn") <= offset + limit)
        .withColumn("bucket", F.lit(ALL_CATEGORIES))
    )

    def by_rank(wants: DataFrame, ranks: DataFrame) -> DataFrame:
        """One row per slot, joined to the article of that rank."""
        turns = F.sequence(F.lit(1), F.col("slots"))
        per_slot = (
            wants.filter(F.col("slots") > 0)
            .withColumn("bucket_rank", F.explode(turns))
            .withColumn("rn", F.col("bucket_rank") + offset)
        )
        most = (n_categories + 1) * (offset + limit)
        return join_hot_key(per_slot, ranks, ["bucket", "rn"], few_rows=most).select(*_PICKED)

    if seen is None:
        picked = by_rank(weighted.unionByName(without), ranked.unionByName(newest))
        candidates = ranked
    else:
        unseen, looked_at = _pick_unseen(articles, dims, n_categories, weighted, seen, offset, limit)
        picked = by_rank(without, newest).unionByName(unseen)
        candidates = looked_at.unionByName(ranked)
    picked = stored(picked, "picked")
    chosen = picked.select("article_id").distinct()
    wanted = (
        candidates.select("article_id", "published_at").distinct().join(chosen, "article_id")
    )
    texts = stored(fetch(articles, wanted, dims), "page-texts")
    return join_hot_key(
        _interleave(picked).select("user_id", "position", "article_id", "weight"),
        texts,
        ["article_id"],
    ).withColumnRenamed("weight", "category_weight")


def _unseen_before(seen_ranks: Column) -> Column:
    """For each of a sorted list of seen ranks, how many unseen ranks come before it."""
    none = F.array().cast("array<int>")
    return F.coalesce(F.transform(seen_ranks, lambda rank, i: rank - i - 1), none)


def _unseen_rank(number: Column) -> Column:
    """The rank of the ``number``-th unseen article: one more for each seen one before it."""
    skipped = F.filter("unseen_before", lambda n: n < number)
    return (number + F.size(skipped)).cast("int")


def _pick_unseen(
    articles: DataFrame,
    dims: tuple,
    n_categories: int,
    weighted: DataFrame,
    seen: DataFrame,
    offset: int,
    limit: int,
) -> tuple[DataFrame, DataFrame]:
    """Page rows per (user, category) with seen articles left out before ranking.

    A pair's seen ranks become one sorted array, from which the rank of each of its slots
    follows by arithmetic, so a slot is a row and no list of candidates is made. Only the
    ``depth`` newest articles per category are ranked: the pick is exact when the last slot's
    rank is within ``depth`` or the category ends there. Pairs for which it is not (a user who
    has seen nearly all of the newest ``depth``) go to a round with eight times the depth,
    until none is left. Also returns the articles looked at.
    """
    depth = max(GROUP_LIMIT, 2 * (offset + limit))
    pending = weighted.filter(F.col("slots") > 0)
    done = []
    while True:
        ranked = _newest_ranked(articles, dims, n_categories, depth)
        most = n_categories * depth
        sizes = ranked.groupBy("bucket").agg(F.max("rn").alias("n_ranked"))
        ids = ranked.select("bucket", "article_id", "rn")
        # The seen table may be huge and one user may own a third of it: it is cut to the
        # ranked articles first, by broadcast when those are few.
        recent_seen = seen.select("user_id", "article_id").join(
            F.broadcast(ids) if most <= BROADCAST_ROWS else ids, "article_id"
        )
        # At most ``depth`` ranks for a pair, equal ones dropped before they meet.
        ranks = recent_seen.select("user_id", "bucket", "rn").distinct()
        seen_ranks = ranks.groupBy("user_id", "bucket").agg(
            F.sort_array(F.collect_list("rn")).alias("seen_ranks")
        )
        wants = (
            join_hot_key(pending, sizes, ["bucket"], few_rows=n_categories)
            .join(seen_ranks, ["user_id", "bucket"], "left")
            .withColumn("unseen_before", _unseen_before(F.col("seen_ranks")))
            .withColumn("last", _unseen_rank(F.col("slots") + offset))
        )
        wants = cut_lineage(wants.drop("seen_ranks"))
        exact = (F.col("last") <= depth) | (F.col("n_ranked") < depth)
        open_pairs = wants.filter(~exact).select(*pending.columns)
        slots = (
            wants.filter(exact)
            .withColumn("bucket_rank", F.explode(F.sequence(F.lit(1), F.col("slots"))))
            .withColumn("rn", _unseen_rank(F.col("bucket_rank") + offset))
        )
        picked = join_hot_key(slots, ranked, ["bucket", "rn"], few_rows=most)
        done.append(picked.select(*_PICKED))
        if open_pairs.isEmpty():
            return reduce(DataFrame.unionByName, done), ranked
        pending = cut_lineage(open_pairs)
        depth *= 8


def parse_seen_ids(requests: DataFrame, column: str = "exclude_ids") -> DataFrame:
    """(user_id, article_id) pairs from comma lists; one bad token voids the whole list."""
    tokens = F.filter(F.split(column, ","), lambda t: F.btrim(t) != "")
    ids = F.transform(tokens, lambda t: F.btrim(t).try_cast("bigint"))
    usable = F.when(~F.exists(ids, lambda i: i.isNull()), ids)
    return requests.select("user_id", F.explode(usable).alias("article_id"))
