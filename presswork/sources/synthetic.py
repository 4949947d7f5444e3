"""Synthetic articles for load tests."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from presswork.operators.joins import absent_from, checked_broadcast
from presswork.session import ntz

# Default table size, address pattern, span of publication times.
TARGET_ROWS = 5000
URL_PREFIX = "https://dummy-news.com/article/"
DAYS = 30

HEADLINES = ["Budget talks continue", "Exports rise again", "Rain closes mountain roads"]
BODIES = [
    "Negotiators met again today and said that they expect a result by the end of the week.",
    "Analysts call the figures solid and look for a quiet market in the coming days.",
]


def top_up(
    articles: DataFrame, sources: DataFrame, as_of: datetime, target: int = TARGET_ROWS
) -> DataFrame:
    """Rows that bring ``articles`` up to ``target``; none if it is there already.

    Source, headline and time come from arithmetic on the running number, so the rows
    are the same on every run.
    """
    spark = articles.sparkSession
    current = articles.count()
    n = F.col("id")
    start = as_of - timedelta(days=DAYS)
    order = W.orderBy("source_id")  # over the source dimension only
    papers = sources.select(
        "source_id", "category_id", (F.row_number().over(order) - 1).alias("pick")
    )
    n_sources = max(1, sources.count())

    def choose(texts, seed):
        return F.element_at(
            F.array(*[F.lit(x) for x in texts]), (n * seed % len(texts) + 1).cast("int")
        )

    rows = (
        spark.range(current, max(current, target))
        .withColumn("pick", n * 7919 % n_sources)
        .join(checked_broadcast(papers), "pick")
        .select(
            "source_id",
            "category_id",
            F.concat(choose(HEADLINES, 31), F.lit(" "), (n + 1).cast("string")).alias("title"),
            choose(BODIES, 17).alias("description"),
            F.concat(F.lit(URL_PREFIX), (n + 1).cast("string")).alias("url"),
            (
                ntz(start)
                + F.make_dt_interval(
                    F.lit(0), F.lit(0), F.lit(0), n * 104729 % F.lit(DAYS * 86400)
                )
            ).alias("published_at"),
        )
    )
    return absent_from(rows, articles, ["url"])
