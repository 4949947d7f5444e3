"""Feeds: latest, by category, trending, other publishers, new since a cursor."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from presswork.functions.dates import iso_text, published_ago
from presswork.functions.text import publisher
from presswork.operators.joins import (
    assign_ids,
    beside_blocks,
    checked_broadcast,
    dealt,
    in_blocks,
    is_small,
    join_hot_key,
    one_by_one,
    shared_out,
    text_bytes,
    top_per_group,
)
from presswork.session import cut_lineage, ntz, stored

# A list of at most this many rows is a page: its keys are looked up one by one.
PAGE_ROWS = 1000
# A task that writes articles for many readers holds texts of about so many bytes, which
# fit the dictionary of a column in a file (1 MB), and meets so many readers at a time.
TASK_BYTES = 512 * 1024
READERS = 128
# Articles of a list that a reader is given in one go.
SEGMENT = 512


def newest_first() -> list[Column]:
    """Newest article first; ``article_id`` breaks ties so that pages are repeatable."""
    return [F.desc_nulls_last("published_at"), F.asc("article_id")]


def servable(articles: DataFrame) -> DataFrame:
    """Only processed articles that are not duplicates are shown to readers."""
    return articles.filter(~F.col("is_duplicate") & F.col("is_processed"))


def published_after(articles: DataFrame, moment: datetime) -> DataFrame:
    """Strictly newer than ``moment``: a literal bound, so it reaches the scan.

    On the day-partitioned layout of ``save_articles`` older folders are not listed.
    """
    if "published_day" in articles.columns:
        articles = articles.filter(F.col("published_day") >= F.lit(moment.date()))
    return articles.filter(F.col("published_at") > ntz(moment))


def published_within(articles: DataFrame, as_of: datetime, hours: int) -> DataFrame:
    """Strictly newer than ``as_of`` minus ``hours``."""
    return published_after(articles, as_of - timedelta(hours=hours))


def published_between(articles: DataFrame, first: datetime, last: datetime) -> DataFrame:
    """From ``first`` to ``last``, both included."""
    if "published_day" in articles.columns:
        articles = articles.filter(
            F.col("published_day").between(F.lit(first.date()), F.lit(last.date()))
        )
    return articles.filter(F.col("published_at").between(ntz(first), ntz(last)))


def newest_days(articles: DataFrame, enough: Callable[[DataFrame], bool]) -> DataFrame:
    """The newest day folders of a ``save_articles`` table, as many as ``enough`` asks for.

    The span of days doubles until ``enough`` holds for its articles or no day is left.
    Everything outside is older than everything inside, so a newest-first choice that is
    satisfied inside is the choice from the whole table. Other layouts come back as they are.
    """
    if "published_day" not in articles.columns:
        return articles
    oldest, newest = articles.agg(F.min("published_day"), F.max("published_day")).first()
    days = 1
    while newest is not None:
        start = newest - timedelta(days=days - 1)
        if start <= oldest:
            break
        part = articles.filter(F.col("published_day") >= F.lit(start))
        if enough(part):
            return part
        days *= 2
    return articles


def dimensions(categories: DataFrame, sources: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Category and publisher names, measured once and hinted for broadcast."""
    names = categories.select("category_id", F.col("name").alias("category_name"))
    papers = sources.select("source_id", F.col("name").alias("section_name"))
    return checked_broadcast(names), checked_broadcast(papers)


def with_names(articles: DataFrame, dims: tuple[DataFrame, DataFrame]) -> DataFrame:
    """Star join with both dimensions."""
    names, papers = dims
    named = articles.join(names, "category_id").join(papers, "source_id")
    return named.withColumn("source_name", publisher(F.col("section_name")))


def named_keys(articles: DataFrame, dims: tuple[DataFrame, DataFrame]) -> DataFrame:
    """Narrow servable rows with a known category and source: what ranking needs, no text."""
    names, papers = dims
    return (
        servable(articles)
        .select("article_id", "category_id", "source_id", "published_at")
        .join(names, "category_id", "left_semi")
        .join(papers, "source_id", "left_semi")
    )


def fetch(
    articles: DataFrame,
    keys: DataFrame,
    dims: tuple[DataFrame, DataFrame],
    few_rows: int | None = None,
) -> DataFrame:
    """Full, named rows for ``keys`` (article_id, published_at, more columns).

    Feeds rank on narrow columns and read texts for the winners only. The winners' time
    range goes into the scan as a literal filter, so on a table laid out by time the
    text of other days is not read. A page (at most ``few_rows`` rows) is looked up
    directly; a longer list is stored and measured first.
    """
    if few_rows is not None and few_rows <= PAGE_ROWS:
        page = keys.collect()
        keys = F.broadcast(keys.sparkSession.createDataFrame(page, keys.schema))
        times = [r["published_at"] for r in page]
        first, last = (min(times), max(times)) if times else (None, None)
    else:
        keys = cut_lineage(keys)
        first, last = keys.agg(F.min("published_at"), F.max("published_at")).first()
        keys = checked_broadcast(keys)
    in_range = (
        articles.filter(F.lit(False))
        if first is None
        else published_between(articles, first, last)
    )
    rows = in_range.select(
        "article_id", "category_id", "source_id", "title", "description", "url", "published_at"
    ).join(keys.drop("published_at", "category_id", "source_id"), "article_id")
    return with_names(rows, dims)


def article_card(articles: DataFrame, as_of: datetime, *keep: str) -> DataFrame:
    """The eleven reader-facing fields; those a feed does not have are NULL.

    ``keep`` names extra leading columns, such as a user or a position.
    """
    present = set(articles.columns)

    def optional(name, kind):
        value = F.col(name) if name in present else F.lit(None)
        return value.cast(kind).alias(name)

    published = F.col("published_at")
    return articles.select(
        *keep,
        "article_id",
        "title",
        "description",
        "url",
        iso_text(published).alias("published_at"),
        published_ago(published, as_of).alias("published_ago"),
        "category_name",
        "source_name",
        optional("press_count", "bigint"),
        optional("similarity", "double"),
        optional("category_weight", "int"),
    )


def latest(
    articles: DataFrame,
    categories: DataFrame,
    sources: DataFrame,
    page: int = 1,
    limit: int = 20,
    category_id: int | None = None,
) -> DataFrame:
    """One page of the newest articles; no (or zero) ``category_id`` means all."""
    dims = dimensions(categories, sources)

    def keys_of(part: DataFrame) -> DataFrame:
        keys = named_keys(part, dims)
        return keys.filter(F.col("category_id") == category_id) if category_id else keys

    last = page * limit
    days = newest_days(articles, lambda part: keys_of(part).limit(last).count() == last)
    keys = keys_of(days).orderBy(*newest_first()).offset(last - limit).limit(limit)
    return fetch(articles, keys, dims, few_rows=limit).orderBy(*newest_first())


def trending(
    articles: DataFrame,
    categories: DataFrame,
    sources: DataFrame,
    as_of: datetime,
    hours: int = 24,
    limit: int = 9,
) -> DataFrame:
    """Recent stories by how many articles tell them (the representative counts as one).

    Duplicates are counted per representative before the join, so a story with a
    huge following is reduced on the map side and never fans out.
    """
    dims = dimensions(categories, sources)
    recent = published_within(named_keys(articles, dims), as_of, hours)
    copies = articles.filter(F.col("representative_id").isNotNull()).select(
        F.col("representative_id").alias("article_id")
    )
    ids = recent.select("article_id")
    if is_small(ids):
        # Count only the followers of recent stories; the others are not shuffled.
        copies = copies.join(F.broadcast(ids), "article_id", "left_semi")
    followers = copies.groupBy("article_id").agg(F.count("*").alias("followers"))
    by_size = [F.desc("press_count"), *newest_first()]
    top = (
        recent.join(followers, "article_id", "left")
        .withColumn("press_count", F.coalesce("followers", F.lit(0)) + 1)
        .select("article_id", "published_at", "press_count")
        .orderBy(*by_size)
        .limit(limit)
    )
    return fetch(articles, top, dims, few_rows=limit).orderBy(*by_size)


def other_press(articles: DataFrame, sources: DataFrame) -> DataFrame:
    """For every representative, the newest duplicate per publisher.

    Duplicates are shown whatever their flags. The per-group cut to one row happens
    before the shuffle, so a story with very many copies ships one row per task.
    """
    papers = sources.select("source_id", publisher(F.col("name")).alias("source_name"))
    copies = articles.filter(F.col("representative_id").isNotNull()).select(
        "representative_id", "article_id", "title", "url", "published_at", "source_id"
    )
    return top_per_group(
        copies.join(checked_broadcast(papers), "source_id"),
        ["representative_id", "source_name"],
        newest_first(),
        1,
    ).drop("rn", "source_id")


def other_press_card(rows: DataFrame, as_of: datetime) -> DataFrame:
    return rows.select(
        "representative_id",
        "article_id",
        "title",
        "url",
        "source_name",
        published_ago(F.col("published_at"), as_of).alias("published_ago"),
    )


def new_since(
    articles: DataFrame,
    categories: DataFrame,
    sources: DataFrame,
    prefs: DataFrame,
    cursor: datetime,
) -> DataFrame:
    """For every user, articles of the user's categories published after ``cursor``.

    The literal form of a poll: an article that becomes servable only after the
    cursor has passed it is missed. The streaming feed does not have that gap.

    The result has a row per user and article, so its order matters when it is stored: a
    task gets articles of ``TASK_BYTES``, and each block of readers meets them one after the
    other. A text is then stored once, and the readers repeat in short runs.
    """
    fresh = published_after(servable(articles), cursor)
    weights = prefs.select("user_id", "category_id", F.col("weight").alias("category_weight"))
    named = stored(with_names(fresh, dimensions(categories, sources)), "fresh")
    rest = [c for c in named.columns if c != "category_id"]
    sets, n_sets = _task_sets(named, "category_id")
    readers = stored(weights, "readers")
    tasks = int(named.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    per_block = max(1, min(READERS, readers.count() * n_sets // tasks))
    blocks = in_blocks(readers, "category_id", per_block, "reader-blocks")
    sets, shares = shared_out(sets, blocks, "category_id", n_sets)
    place = (F.col("_place") * shares + F.col("_share")).cast("int")
    sets = sets.repartitionById(max(1, n_sets * shares), place)
    rows = (
        beside_blocks(sets, blocks, "category_id", shares)
        .select("category_id", "_rows", one_by_one("_articles").alias("_article"))
        .select("category_id", "_article", one_by_one("_rows").alias("_reader"))
    )
    return rows.select(
        "category_id",
        "_reader.user_id",
        "_reader.category_weight",
        *[F.col(f"_article.`{c}`") for c in rest],
    )


def _task_sets(articles: DataFrame, key: str) -> tuple[DataFrame, int]:
    """Articles by task (``_place`` from 0) and ``key``, as an array ``_articles`` of the other
    columns; and the number of tasks. The texts of a task are about ``TASK_BYTES``.

    Articles are dealt to groups of several tasks by hash, and cut by running size there.
    """
    rest = [c for c in articles.columns if c != key]
    sized = articles.withColumn("_bytes", text_bytes(articles))
    total = sized.agg(F.sum("_bytes")).first()[0] or 0
    tasks = int(articles.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    n_groups = max(1, min(tasks, total // (8 * TASK_BYTES)))
    group = F.pmod(F.xxhash64("article_id"), F.lit(n_groups))
    before = (
        W.partitionBy("_group")
        .orderBy("article_id", "_bytes", F.xxhash64(*[F.col(f"`{c}`") for c in rest]))
        .rowsBetween(W.unboundedPreceding, -1)
    )
    cut = sized.withColumn("_group", group).withColumn(
        "_cut", F.floor(F.coalesce(F.sum("_bytes").over(before), F.lit(0)) / TASK_BYTES)
    )
    sets = cut.groupBy("_group", "_cut", key).agg(F.collect_list(F.struct(*rest)).alias("_articles"))
    sets = stored(sets, "task-sets")
    places = stored(
        assign_ids(sets.select("_group", "_cut").distinct(), ["_group", "_cut"], "_place"), "places"
    )
    placed = join_hot_key(sets, places, ["_group", "_cut"]).drop("_group", "_cut")
    return placed.withColumn("_place", F.col("_place") - 1), places.count()


def reader_lists(prefs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Readers (user_id, list_id), and the preferences behind each list of categories.

    Users with the same categories are shown the same articles. The second table has the
    columns of ``prefs`` that feeds take, with ``list_id`` as its ``user_id``.
    """
    ids = F.array_sort(F.collect_list("category_id"))
    users = prefs.groupBy("user_id").agg(ids.alias("categories"))
    users = users.withColumn(
        "list_id", F.md5(F.array_join(F.col("categories").cast("array<string>"), ","))
    )
    users = stored(users, "reader-lists")
    lists = users.select("list_id", "categories").distinct()
    wanted = lists.select(
        F.col("list_id").alias("user_id"),
        F.explode("categories").alias("category_id"),
        F.lit(None).cast("int").alias("weight"),
    )
    return users.select("user_id", "list_id"), wanted


def merge_shown(shown: DataFrame, arrived: DataFrame, readers: DataFrame) -> DataFrame:
    """Put newly arrived rows in front of those on screen, skipping ones already there.

    ``shown`` has ``user_id``, ``position`` and the article columns. ``arrived`` has the same
    with ``list_id`` instead of ``user_id``, positions from 1 without gaps, and ``readers``
    (user_id, list_id) says who is shown which list. Positions are renumbered from 1.

    A list is ranked once for all its readers. What a reader has on screen gives a few ranks
    to skip, and new positions follow by arithmetic: only screens and readers are shuffled,
    never the rows of all users.

    The result has a row per reader and article. It is made by segments of a list, each
    for one reader after the other: a segment repeats from reader to reader but for skipped
    ranks, so that columnar files, which compress repeats that are near, take little for it.
    """
    columns = ["user_id", *[c for c in shown.columns if c != "user_id"]]
    rest = [c for c in columns if c not in ("user_id", "position")]
    arrived = stored(arrived, "arrived-lists")
    ranks = arrived.select("list_id", "article_id", F.col("position").alias("rank"))
    on_screen = shown.select("user_id", "article_id").join(readers, "user_id")
    skipped = (
        join_hot_key(on_screen, ranks, ["list_id", "article_id"])
        .groupBy("user_id")
        .agg(F.sort_array(F.collect_set("rank")).alias("skipped"))
    )
    sizes = arrived.groupBy("list_id").agg(F.count("*").cast("int").alias("n_arrived"))
    users = join_hot_key(readers.join(skipped, "user_id", "left"), sizes, ["list_id"])
    none = F.array().cast("array<int>")
    users = stored(users.withColumn("skipped", F.coalesce("skipped", none)), "readers")

    segment = F.floor((F.col("position") - 1) / SEGMENT)
    segments = (
        arrived.groupBy("list_id", segment.alias("_segment"))
        .agg(F.sort_array(F.collect_list(F.struct("position", *rest))).alias("_articles"))
    )
    segments = stored(segments, "segments")
    n_segments = segments.count()
    tasks = int(arrived.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    per_block = max(1, min(READERS, users.count() * n_segments // tasks))
    blocks = in_blocks(
        users.select("list_id", "user_id", "skipped"), "list_id", per_block, "reader-blocks"
    )
    segments, shares = shared_out(segments, blocks, "list_id", n_segments)
    # Stored as dealt, a file per share, so that tasks can be as many.
    segments = stored(dealt(segments, "list_id", "_segment", "_share"), "dealt-segments")
    met = beside_blocks(segments, blocks, "list_id", shares).select(
        "_articles", one_by_one("_rows").alias("_reader")
    )
    first, last = F.col("_articles")[0]["position"], F.col("_articles")[F.size("_articles") - 1]["position"]
    before = F.size(F.filter("_reader.skipped", lambda rank: rank < first))
    here = F.filter("_reader.skipped", lambda rank: rank.between(first, last))
    left = F.filter("_articles", lambda a: ~F.array_contains("_here", a["position"]))
    fresh = (
        met.select("_articles", "_reader.user_id", (first - before).alias("_first"), here.alias("_here"))
        .select(
            "user_id",
            "_first",
            F.when(F.size("_here") == 0, F.col("_articles")).otherwise(left).alias("_left"),
        )
        .select("user_id", "_first", F.posexplode("_left").alias("_pos", "_article"))
        .select(
            "user_id",
            (F.col("_first") + F.col("_pos")).alias("position"),
            *[F.col(f"_article.`{c}`") for c in rest],
        )
    )
    ahead = users.select(
        F.col("user_id").alias("_user"), (F.col("n_arrived") - F.size("skipped")).alias("_ahead")
    )
    in_order = W.partitionBy("user_id").orderBy("position")
    kept = (
        shown.withColumn("position", F.row_number().over(in_order))
        .join(ahead, F.col("user_id").eqNullSafe(F.col("_user")), "left")
        .withColumn("position", F.col("position") + F.coalesce("_ahead", F.lit(0)))
    )
    return fresh.select(*columns).unionByName(kept.select(*columns))
