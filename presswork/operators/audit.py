"""Declared constraints as checks that return the offending rows or counts."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from presswork import schemas
from presswork.operators.joins import join_hot_key
from presswork.session import stored


def repeated_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys that occur more than once, with how often."""
    return df.groupBy(*keys).agg(F.count("*").alias("n_rows")).filter(F.col("n_rows") > 1)


def orphans(child: DataFrame, column: str, parent: DataFrame, parent_key: str) -> DataFrame:
    """Child rows whose reference is set but has no parent row.

    References are reduced to distinct values first, so a value held by very many rows
    meets the parent once; only the broken values go back to the child.
    """
    used = child.select(column).filter(F.col(column).isNotNull()).distinct()
    broken = used.join(
        parent.select(F.col(parent_key).alias(column)).distinct(), column, "left_anti"
    )
    return child.join(broken, column, "left_semi")


def violations(df: DataFrame, **rules: Column) -> DataFrame:
    """One row per rule with the number of rows that break it (in a single pass)."""
    counts = df.agg(*[F.count_if(~F.coalesce(ok, F.lit(False))).alias(n) for n, ok in rules.items()])
    return counts.select(
        F.explode(
            F.array(*[F.struct(F.lit(n).alias("rule"), F.col(n).alias("n_rows")) for n in rules])
        ).alias("r")
    ).select("r.rule", "r.n_rows")


def representative_chains(articles: DataFrame) -> DataFrame:
    """Representatives that are themselves duplicates, with the articles pointing at them."""
    counts = (
        articles.filter(F.col("representative_id").isNotNull())
        .groupBy("representative_id")
        .agg(F.count("*").alias("n_followers"))
    )
    chained = articles.filter(F.col("is_duplicate")).select(
        F.col("article_id").alias("representative_id"),
        F.col("representative_id").alias("next_representative_id"),
    )
    return counts.join(chained, "representative_id")


def _jump(open_: DataFrame, table: DataFrame, column: str) -> DataFrame:
    """``open_`` with the row of ``table`` (keyed by id) that ``column`` points at, as ``_to``."""
    target = table.select(
        F.col("id").alias(column), F.struct(*[c for c in table.columns if c != "id"]).alias("_to")
    )
    return join_hot_key(open_, target, [column], "left")


def _ends(links: DataFrame) -> DataFrame:
    """(id, end, hops, looped) of every link (id, next): where it leads in the end.

    Pointers double their reach in each round, so a chain of n takes log n rounds. What is
    still under way when the reach exceeds the number of links runs into a loop: ``end`` is
    then the smallest id of that loop, and ``hops`` are null.
    """
    left = links.count()
    now = stored(links.select("id", "next", F.lit(1).cast("long").alias("hops")), "chain-links")
    done, reach = [], 1
    while True:
        # A pointer at something that is no link has arrived.
        moved = stored(_jump(now, now, "next"), "chain-links")
        arrived = moved.filter(F.col("_to").isNull())
        done.append(arrived.select("id", F.col("next").alias("end"), "hops", F.lit(False).alias("looped")))
        if reach > left or moved.filter(F.col("_to").isNotNull()).isEmpty():
            break
        reach *= 2
        # Rows that have arrived keep their pointers, for those that point at them.
        now = stored(
            moved.select(
                "id",
                F.coalesce("_to.next", "next").alias("next"),
                (F.col("hops") + F.coalesce("_to.hops", F.lit(0))).alias("hops"),
            ),
            "chain-links",
        )
        done = []
    looped = moved.filter(F.col("_to").isNotNull()).select("id", F.col("next").alias("member"))
    if not looped.isEmpty():
        done.append(
            looped.join(_loop_names(links, looped), "member").select(
                "id", F.col("least").alias("end"), F.lit(None).cast("long").alias("hops"), F.lit(True).alias("looped")
            )
        )
    return reduce(DataFrame.unionByName, done)


def _loop_names(links: DataFrame, looped: DataFrame) -> DataFrame:
    """(member, least): the smallest id of the loop each member is in.

    Jumping by more than all links maps a loop onto itself, so the places that looped
    pointers have come to are exactly the members of loops.
    """
    members = looped.select(F.col("member").alias("id")).distinct()
    rows = stored(
        links.join(members, "id", "left_semi").select("id", "next", F.col("id").alias("least")), "loops"
    )
    size, reach = rows.count(), 1
    while reach < size:
        moved = _jump(rows, rows, "next")
        rows = stored(
            moved.select(
                "id", F.col("_to.next").alias("next"), F.least("least", "_to.least").alias("least")
            ),
            "loops",
        )
        reach *= 2
    return rows.select(F.col("id").alias("member"), "least")


def final_representatives(articles: DataFrame) -> DataFrame:
    """(article_id, representative_id, final_id, hops, looped) of every article with one.

    ``final_id`` is the article at the end of the chain of representatives, ``hops`` the
    links to it. A chain that runs into a loop ends at the smallest id of the loop and has
    null hops. Only representatives that have one themselves are followed; their followers,
    however many, are joined to the outcome once.
    """
    pointing = articles.filter(F.col("representative_id").isNotNull()).select(
        "article_id", "representative_id"
    )
    used = pointing.select(F.col("representative_id").alias("article_id")).distinct()
    chained = pointing.join(used, "article_id", "left_semi")
    ends = stored(_ends(stored(chained.toDF("id", "next"), "chain-links")), "chain-ends")
    found = join_hot_key(
        pointing, ends.withColumnRenamed("id", "representative_id"), ["representative_id"], "left"
    )
    plain = F.col("looped").isNull()
    return found.select(
        "article_id",
        "representative_id",
        F.coalesce("end", "representative_id").alias("final_id"),
        F.when(plain, F.lit(1).cast("long")).otherwise(F.col("hops") + 1).alias("hops"),
        F.coalesce("looped", F.lit(False)).alias("looped"),
    )


def chain_repairs(articles: DataFrame) -> DataFrame:
    """Rows to change so that every representative is none's duplicate: (article_id,
    is_duplicate, representative_id).

    Followers point straight at the end of their chain. The smallest article of a loop
    becomes its representative.
    """
    found = final_representatives(articles)
    itself = F.col("article_id") == F.col("final_id")
    return found.filter(itself | (F.col("representative_id") != F.col("final_id"))).select(
        "article_id",
        (~itself).alias("is_duplicate"),
        F.when(~itself, F.col("final_id")).alias("representative_id"),
    )


def check_constraints(tables: Mapping[str, DataFrame]) -> DataFrame:
    """(kind, table, columns, n_rows) for every declared constraint of the given tables.

    n_rows counts the offending rows: values missing where one is required, rows beyond the
    first of a key, references without a parent, values out of range. Keys with a missing
    part are not compared. A constraint that holds has a row with zero; a reference to a
    table that is not given is left out.
    """
    found = []

    def report(counts: DataFrame, kind: str, table: str, columns: str) -> None:
        found.append(
            counts.select(
                F.lit(kind).alias("kind"),
                F.lit(table).alias("table"),
                F.lit(columns).alias("columns"),
                F.coalesce(F.col("n_rows"), F.lit(0)).cast("long").alias("n_rows"),
            )
        )

    for name, df in tables.items():
        fields = schemas.TABLES[name].fields
        needed = {f.name: F.col(f.name).isNotNull() for f in fields if not f.nullable}
        missing = violations(df, **needed)  # all columns in one pass
        found.append(
            missing.select(
                F.lit("required").alias("kind"),
                F.lit(name).alias("table"),
                F.col("rule").alias("columns"),
                F.col("n_rows").cast("long").alias("n_rows"),
            )
        )
        for key in [(fields[0].name,), *schemas.UNIQUE.get(name, [])]:
            repeats = repeated_keys(df.dropna(subset=list(key)), key)
            report(repeats.agg(F.sum(F.col("n_rows") - 1).alias("n_rows")), "unique", name, ",".join(key))
    for name, column, parent, key in schemas.REFERENCES:
        if name in tables and parent in tables:
            broken = orphans(tables[name], column, tables[parent], key)
            report(broken.agg(F.count("*").alias("n_rows")), "reference", name, column)
    for name, column, low, high in schemas.RANGES:
        if name in tables:
            outside = F.count_if(~F.col(column).between(low, high)).alias("n_rows")
            report(tables[name].agg(outside), "range", name, column)
    return reduce(DataFrame.unionByName, found)
