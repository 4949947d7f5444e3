"""Stored tables: partitioned and bucketed layouts, and JDBC reads by id range."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from presswork.session import stored


def _by_day(articles: DataFrame, files_per_day: int):
    """A writer of the day layout."""
    return (
        articles.withColumn("published_day", F.to_date("published_at"))
        .repartition("published_day", F.pmod(F.xxhash64("article_id"), F.lit(files_per_day)))
        .sortWithinPartitions("published_day", "published_at")
        .write.partitionBy("published_day")
    )


def save_articles(articles: DataFrame, path: str, files_per_day: int = 16) -> None:
    """Parquet by day of publication, sorted by time inside a file.

    Feeds and the duplicate window filter on ``published_at``: a day folder bounds what
    is read and the row-group ranges bound it further.
    """
    _by_day(articles, files_per_day).parquet(path)


def update_articles(spark: SparkSession, path: str, changed: DataFrame, files_per_day: int = 16):
    """Put changed rows, and new ones, into a table of ``save_articles``.

    Only the day folders in which a row changes are rewritten; all others keep their files.
    A changed row replaces the one with its article_id and must have its publication time.
    Rows without a time have a folder of their own and are replaced like others. The new
    contents of the days are stored first, so a run that fails before the last step has
    changed nothing and can be run again.
    """
    rows = stored(changed.withColumn("published_day", F.to_date("published_at")), "changed")
    # One value per calendar day, as literals: only these folders are listed and read.
    days = [r[0] for r in rows.select("published_day").distinct().collect()]
    in_days = F.col("published_day").isin([d for d in days if d is not None])
    if None in days:
        in_days = in_days | F.col("published_day").isNull()
    ids = rows.select(F.col("published_day").alias("_day"), F.col("article_id").alias("_id"))
    kept = spark.read.parquet(path).filter(in_days)
    replaced = (kept["article_id"] == F.col("_id")) & kept["published_day"].eqNullSafe(F.col("_day"))
    kept = kept.join(ids, replaced, "left_anti")
    whole = stored(kept.unionByName(rows).drop("published_day"), "rewritten-days")
    writer = _by_day(whole, files_per_day).mode("overwrite")
    writer.option("partitionOverwriteMode", "dynamic").parquet(path)


def save_chunks(chunks: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Parquet with first chunks in a folder of their own (``first_chunk=1``).

    Duplicate detection reads only the first chunk of an article, which is a small part
    of all vectors. New chunks are added with mode ``append``; nothing is rewritten.
    """
    (
        chunks.withColumn("first_chunk", (F.col("chunk_index") == 0).cast("int"))
        .write.partitionBy("first_chunk")
        .mode(mode)
        .parquet(path)
    )


def first_chunks(chunks: DataFrame) -> DataFrame:
    """Embedded first chunks: (article_id, chunk_index, embedding).

    On the layout of ``save_chunks`` the other folder is not read.
    """
    if "first_chunk" in chunks.columns:
        chunks = chunks.filter(F.col("first_chunk") == 1)
    rows = chunks.filter((F.col("chunk_index") == 0) & F.col("embedding").isNotNull())
    return rows.select("article_id", "chunk_index", "embedding")


def save_bucketed(df: DataFrame, table: str, key: str = "article_id", buckets: int = 16) -> None:
    """A managed table bucketed and sorted by ``key``.

    Articles and chunks saved with the same bucket count join on ``article_id`` without
    moving either side, so the vectors stay where they are.
    """
    df.write.bucketBy(buckets, key).sortBy(key).mode("overwrite").saveAsTable(table)


def read_jdbc_range(
    spark: SparkSession,
    url: str,
    query: str,
    column: str,
    num_partitions: int,
    properties: dict[str, str] | None = None,
) -> DataFrame | None:
    """Read a query over JDBC in ranges of about equal row counts of a numeric column.

    The column alone is read first, by equal widths, and Spark takes its quantiles, so gaps
    and dense stretches of ids do not skew the partitions that carry the rows. Equal values
    are never split; NULLs belong to the first range. None means the query selects nothing.
    """
    properties = properties or {}
    low, high, n = spark.read.jdbc(
        url,
        f"(SELECT MIN({column}) AS LO, MAX({column}) AS HI, COUNT(*) AS N FROM ({query}) q) b",
        properties=properties,
    ).first()
    if not n:
        return None
    rows = f"({query}) q"
    if low is None or num_partitions < 2:
        return spark.read.jdbc(url, rows, properties=properties)
    ids = spark.read.jdbc(
        url,
        f"(SELECT {column} AS ID FROM ({query}) q) i",
        column="ID",
        lowerBound=int(low),
        upperBound=int(high) + 1,
        numPartitions=num_partitions,
        properties=properties,
    )
    shares = [i / num_partitions for i in range(1, num_partitions)]
    cuts = sorted(set(ids.agg(F.percentile_approx(F.col("ID").cast("long"), shares, 10_000)).first()[0]))
    edges = [f"{column} >= {a} AND {column} < {b}" for a, b in zip(cuts, cuts[1:])]
    ranges = [f"{column} < {cuts[0]} OR {column} IS NULL", *edges, f"{column} >= {cuts[-1]}"]
    return spark.read.jdbc(url, rows, predicates=ranges, properties=properties)
