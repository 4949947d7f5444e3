"""A stored index of known urls, so that a micro-batch need not read the stored articles.

Rows are digests of urls in folders ``keys/batch=<n>/bucket=<first hex digits>``. A look-up
lists the buckets of its own urls as literals and reads no other folder. Beside the keys
lie the highest article id after each batch, and a mark that a batch was begun: a batch that
is run again after a failure finds the mark and looks at the articles themselves.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from presswork.operators.joins import absent_from
from presswork.session import path_exists, remove_path, stored

# 16 to the power of this many buckets.
DIGITS = 2
KEYS = "url_key string, batch bigint, bucket string"


def with_key(rows: DataFrame, digits: int = DIGITS) -> DataFrame:
    """``rows`` (with url) and the digest and bucket of each url."""
    key = F.md5("url")
    return rows.withColumns({"url_key": key, "bucket": F.substring(key, 1, digits)})


class UrlIndex:
    """The index below ``path``; all writes of a batch overwrite what it wrote before."""

    def __init__(self, spark: SparkSession, path: str, digits: int = DIGITS):
        self.spark, self.path, self.digits = spark, path, digits

    def _at(self, name: str, batch: int) -> str:
        return f"{self.path}/{name}/batch={batch}"

    def is_current(self, batch: int) -> bool:
        """Whether all batches before this one are in the index, and this one is new."""
        begun = path_exists(self.spark, self._at("begun", batch))
        return not begun and path_exists(self.spark, self._at("heads", batch - 1))

    def begin(self, batch: int) -> None:
        """Leave the mark; to be called before the articles of the batch are written."""
        self.spark.range(1).write.mode("overwrite").parquet(self._at("begun", batch))

    def head(self, batch: int) -> DataFrame:
        """(url, article_id): one row with the highest id up to a batch, for numbering."""
        row = self.spark.read.schema("article_id bigint").parquet(self._at("heads", batch))
        return row.select(F.lit(None).cast("string").alias("url"), "article_id")

    def keys(self, buckets: list[str] | None = None) -> DataFrame:
        """Known digests, of the given buckets only."""
        if not path_exists(self.spark, f"{self.path}/keys"):
            return self.spark.createDataFrame([], KEYS)
        found = self.spark.read.schema(KEYS).parquet(f"{self.path}/keys")
        return found if buckets is None else found.filter(F.col("bucket").isin(buckets))

    def unknown(self, rows: DataFrame) -> DataFrame:
        """Rows whose url is not in the index. ``rows`` should be stored: it is read twice.

        The buckets, at most 16 to the power of ``digits``, come back as literals.
        """
        keyed = with_key(rows, self.digits)
        touched = [r[0] for r in keyed.select("bucket").distinct().collect() if r[0] is not None]
        return absent_from(keyed, self.keys(touched).select("url_key"), ["url_key"]).select(*rows.columns)

    def add(self, articles: DataFrame, batch: int, head: DataFrame) -> None:
        """Enter the urls of a batch's ``articles``; ``head`` is the state before them."""
        keys = with_key(articles.select("url"), self.digits).select("url_key", "bucket")
        keys.repartition("bucket").write.partitionBy("bucket").mode("overwrite").parquet(
            self._at("keys", batch)
        )
        ids = head.select("article_id").unionByName(articles.select("article_id"))
        highest = ids.agg(F.max("article_id").alias("article_id"))
        highest.coalesce(1).write.mode("overwrite").parquet(self._at("heads", batch))

    def compact(self, batch: int) -> None:
        """Put the keys of all batches up to this one into one folder.

        Batches are deleted when their keys are in it; a key that is there twice does no
        harm, so the step can be run again.
        """
        older = self.keys().filter(F.col("batch") <= batch)
        numbers = [r[0] for r in older.select("batch").distinct().collect()]
        whole = stored(older.select("url_key", "bucket").distinct(), "url-keys")
        whole.repartition("bucket").write.partitionBy("bucket").mode("overwrite").parquet(
            self._at("keys", batch)
        )
        for number in numbers:
            if number != batch:
                remove_path(self.spark, self._at("keys", number))
