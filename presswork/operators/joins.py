"""Join, top-k and key helpers shared by the operators."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from presswork.session import stored

# A side is broadcast only up to this many rows and bytes, counted beforehand.
BROADCAST_ROWS = 1_000_000
BROADCAST_BYTES = 64 * 1024 * 1024
# Spark prunes ``row_number() <= k`` before the shuffle up to this k by default.
GROUP_LIMIT = 1000
SALTS = 32
# Deeper rankings than this take two levels.
SALT_FROM = 64


def _width(df: DataFrame) -> Column:
    """Rough bytes of a row: measured for text and arrays, eight for anything else."""
    total = F.lit(0)
    for field in df.schema.fields:
        column = F.col(f"`{field.name}`")
        if isinstance(field.dataType, T.StringType):
            total = total + F.coalesce(F.octet_length(column), F.lit(0)) + 16
        elif isinstance(field.dataType, T.ArrayType):
            total = total + F.coalesce(F.size(column), F.lit(0)) * 8 + 16
        else:
            total = total + 8
    return total


def text_bytes(df: DataFrame) -> Column:
    """Bytes of all texts of a row."""
    total = F.lit(0).cast("bigint")
    for field in df.schema.fields:
        if isinstance(field.dataType, T.StringType):
            total = total + F.coalesce(F.octet_length(F.col(f"`{field.name}`")), F.lit(0))
    return total


def is_small(df: DataFrame) -> bool:
    """Count rows and bytes.

    Every task sends back two numbers; no row is moved for it. The frame is evaluated, so
    costly ones are stored by their makers first.
    """
    rows, size = df.agg(F.count("*"), F.coalesce(F.sum(_width(df)), F.lit(0))).first()
    return rows <= BROADCAST_ROWS and size <= BROADCAST_BYTES


def checked_broadcast(df: DataFrame) -> DataFrame:
    """Hint a broadcast if the side is small.

    A larger side is returned as it is and joined by shuffle, where adaptive
    execution splits skewed partitions.
    """
    return F.broadcast(df) if is_small(df) else df


def spread(df: DataFrame, key: str) -> DataFrame:
    """Deal rows out by ``key`` before a costly per-row step, whatever files they come from."""
    return df.repartition(key)


def dealt(df: DataFrame, *keys: str) -> DataFrame:
    """Few rows that each meet many others, dealt to as many tasks as a shuffle has.

    With the number given, adaptive execution does not put them together again for being
    small: the work is in what they meet.
    """
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def join_hot_key(
    many: DataFrame,
    few: DataFrame,
    on: Sequence[str],
    how: str = "inner",
    few_rows: int | None = None,
) -> DataFrame:
    """Join on a key that may hold a large part of ``many``.

    A small ``few`` is broadcast: ``few_rows`` is a proven bound for a side of a few
    numeric columns, and without one its size is counted. Otherwise each key is spread over
    ``SALTS`` groups and ``few`` is repeated once per group. ``how`` is inner or left.
    """
    on = list(on)
    if few_rows <= BROADCAST_ROWS if few_rows is not None else is_small(few):
        return many.join(F.broadcast(few), on, how)
    salted = many.withColumn("_salt", F.pmod(F.xxhash64(*many.columns), F.lit(SALTS)))
    copies = few.withColumn(
        "_salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long")))
    )
    return salted.join(copies, [*on, "_salt"], how).drop("_salt")


def one_by_one(array: Column | str) -> Column:
    """``explode`` that hands its rows on one at a time.

    A compiled stage keeps all rows that one row turns into before the next step sees the
    first, be it by a join or by ``explode``; with texts in them that is readers times texts.
    Spark does not compile a step with a lambda in it.
    """
    return F.explode(F.transform(array, lambda x: x))


def in_blocks(
    rows: DataFrame, key: str, per_block: int, name: str, weight: Column | None = None
) -> DataFrame:
    """``rows`` in blocks of about ``per_block`` of the same key, stored.

    A row per block: ``key``, ``_n`` blocks of the key, ``_number`` from 0, ``_rows``, an array
    of the other columns, and ``_size``, the sum of ``weight`` (1 by default). Rows are dealt to
    numbers by hash, so a number may be missing.
    """
    weight = F.lit(1) if weight is None else weight
    others = [c for c in rows.columns if c != key]
    sizes = rows.groupBy(key).agg(F.ceil(F.count("*") / per_block).alias("_n"))
    numbered = join_hot_key(rows, sizes, [key]).withColumn(
        "_number", F.pmod(F.xxhash64(*others), F.col("_n"))
    )
    blocks = numbered.groupBy(key, "_n", "_number")
    return stored(
        blocks.agg(F.collect_list(F.struct(*others)).alias("_rows"), F.sum(weight).alias("_size")), name
    )


def shared_out(
    units: DataFrame, blocks: DataFrame, key: str, n_units: int
) -> tuple[DataFrame, int]:
    """Units (wide rows, such as a list with its texts) once for each share of their blocks,
    ``_share`` of how many; one share where there are as many units as tasks."""
    tasks = int(units.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    shares = -(-tasks // max(1, n_units))
    sizes = join_hot_key(units, blocks.select(key, "_n").distinct(), [key])
    every = one_by_one(F.sequence(F.lit(0), F.lit(shares - 1)))
    return sizes.select("*", every.alias("_share")).filter("_share < _n"), shares


def beside_blocks(units: DataFrame, blocks: DataFrame, key: str, shares: int) -> DataFrame:
    """Units of ``shared_out`` beside each block of their key and share, as ``_rows``.

    Units stay in their tasks and meet one block after the other; blocks are broadcast, in
    turns of about ``BROADCAST_ROWS`` in size.
    """
    size = blocks.agg(F.sum("_size")).first()[0] or 0
    turns = -(-size // BROADCAST_ROWS) or 1
    met = []
    for turn in range(turns):
        start = (F.col("_share") + shares * turn).cast("bigint")
        numbers = F.sequence(start, F.col("_n") - 1, F.lit(shares * turns).cast("bigint"))
        numbered = units.filter(start < F.col("_n")).withColumn("_number", one_by_one(numbers))
        of_turn = blocks.drop("_n", "_size")
        if turns > 1:
            of_turn = of_turn.filter(F.pmod(F.floor(F.col("_number") / shares), F.lit(turns)) == turn)
        met.append(numbered.join(F.broadcast(of_turn), [key, "_number"]))
    out = met[0]
    for more in met[1:]:
        out = out.unionByName(more)
    return out.drop("_n", "_share", "_number")


def top_per_group(
    df: DataFrame, keys: Sequence[str], order: Sequence[Column], k: int, rank: str = "rn"
) -> DataFrame:
    """The first ``k`` rows per key with their rank.

    Up to ``GROUP_LIMIT`` Spark drops surplus rows before the shuffle, so a hot key ships at
    most k rows per task. From ``SALT_FROM`` on that adds up in the task of the key, so the
    key is first spread over as many groups as there are shuffle partitions, and the closing
    window receives k rows of each.
    """
    keys = list(keys)
    if k > SALT_FROM:
        salts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        salted = df.withColumn("_salt", F.pmod(F.xxhash64(*df.columns), F.lit(salts)))
        first = W.partitionBy(*keys, "_salt").orderBy(*order)
        df = (
            salted.withColumn(rank, F.row_number().over(first))
            .filter(F.col(rank) <= k)
            .drop("_salt", rank)
        )
    final = W.partitionBy(*keys).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(final)).filter(F.col(rank) <= k)


def absent_from(incoming: DataFrame, existing: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows of ``incoming`` whose key is not in ``existing``.

    When the incoming keys are few, the stored table is first cut down to the keys
    that occur in them by a broadcast semi join, so it is never shuffled.
    """
    keys = list(keys)
    stored = existing.select(*keys)
    wanted = incoming.select(*keys).distinct()
    if is_small(wanted):
        stored = stored.join(F.broadcast(wanted), keys, "left_semi").distinct()
    return incoming.join(stored, keys, "left_anti")


def assign_ids(
    rows: DataFrame, key: Sequence[str], id_column: str, existing: DataFrame | None = None
) -> DataFrame:
    """Give new rows consecutive ids after the highest stored one.

    Ids follow the order of (md5 of the key, key), a repeatable order that splits
    evenly into 4,096 ranges by its first three hex digits. The ranges are numbered
    in parallel and shifted by running totals, so no task sees all rows.
    """
    text = F.concat_ws("\x1f", *[F.col(c).cast("string") for c in key])
    tagged = rows.withColumn("_md5", F.md5(text)).withColumn(
        "_range", F.substring("_md5", 1, 3)
    )
    counts = tagged.groupBy("_range").agg(F.count("*").alias("_n"))
    if existing is not None:
        # The stored maximum enters as a range that sorts before all others.
        highest = existing.agg(
            F.lit("").alias("_range"),
            F.coalesce(F.max(id_column), F.lit(0)).cast("long").alias("_n"),
        )
        counts = counts.unionByName(highest)
    before = W.orderBy("_range").rowsBetween(W.unboundedPreceding, -1)
    starts = counts.select(
        "_range", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start")
    )
    within = W.partitionBy("_range").orderBy("_md5", *key)
    return (
        tagged.join(F.broadcast(starts), "_range")  # at most 4,097 rows
        .withColumn(
            id_column, (F.col("_start") + F.row_number().over(within)).cast("long")
        )
        .drop("_md5", "_range", "_start")
    )
