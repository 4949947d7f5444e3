"""Feed files (RSS as XML) landed by a downloader, one folder per source."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from presswork.functions.dates import parse_feed_date
from presswork.functions.text import clean_html
from presswork.operators.joins import checked_broadcast

ITEM_SCHEMA = T.StructType(
    [
        T.StructField("title", T.StringType()),
        T.StructField("link", T.StringType()),
        T.StructField("description", T.StringType()),
        T.StructField("pubDate", T.StringType()),
        T.StructField("content:encoded", T.StringType()),
        T.StructField("content", T.StringType()),
    ]
)
# ``source_id=<n>`` folders add the source of each file as a column.
LANDED_SCHEMA = T.StructType([*ITEM_SCHEMA.fields, T.StructField("source_id", T.IntegerType())])


def read_feed_files(spark: SparkSession, path: str, streaming: bool = False) -> DataFrame:
    """One row per feed entry of every file below ``path/source_id=<n>/``."""
    reader = spark.readStream if streaming else spark.read
    return name_items(
        reader.format("xml").option("rowTag", "item").schema(LANDED_SCHEMA).load(path)
    )


def name_items(items: DataFrame) -> DataFrame:
    return items.select(
        "source_id",
        "title",
        F.col("description").alias("summary"),
        F.coalesce(F.col("`content:encoded`"), F.col("content")).alias("content"),
        "link",
        F.col("pubDate").alias("published"),
    )


def write_feed_files(items: DataFrame, path: str) -> None:
    """Land entries (columns as ``read_feed_files`` returns them) as XML files.

    The content element goes out under its plain name, since Spark's writer takes no
    prefixed ones.
    """
    (
        items.select(
            "source_id",
            "title",
            "link",
            F.col("summary").alias("description"),
            F.col("published").alias("pubDate"),
            "content",
        )
        .write.format("xml")
        .option("rootTag", "channel")
        .option("rowTag", "item")
        .partitionBy("source_id")
        .save(path)
    )


def with_section(items: DataFrame, sources: DataFrame) -> DataFrame:
    """Add the category a source files its articles under."""
    return items.join(checked_broadcast(sources.select("source_id", "category_id")), "source_id")


def parse_items(items: DataFrame, prefer_content: Column | None = None) -> DataFrame:
    """Clean title, description, url and naive date per entry.

    The description comes from the summary. Where ``prefer_content`` holds, a
    content element wins whenever it is present, even if empty.
    """
    summary = F.coalesce(F.col("summary"), F.lit(""))
    body = summary
    if prefer_content is not None:
        body = F.when(prefer_content, F.coalesce(F.col("content"), summary)).otherwise(summary)
    return items.select(
        *[c for c in items.columns if c not in ("title", "summary", "content", "link", "published")],
        clean_html(F.col("title")).alias("title"),
        clean_html(body).alias("description"),
        F.coalesce(F.col("link"), F.lit("")).alias("url"),
        parse_feed_date(F.col("published")).alias("published_at"),
    )
