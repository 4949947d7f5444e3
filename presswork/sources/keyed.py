"""Stored tables whose rows change by key: preferences, sessions and vectors.

Rows lie in folders ``bucket=<n>`` by the hash of their key. A change reads and rewrites
the folders of its own keys and no others, so what a change costs follows the buckets it
touches, not the table. Rows that never change, such as vectors, are only appended.

One change of a table runs at a time. New contents are stored before folders are replaced,
and each change can be run again.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from presswork.operators import tables
from presswork.operators.joins import absent_from
from presswork.session import path_exists, stored

BUCKETS = 256


class KeyedTable:
    """A table below ``path``, bucketed by the hash of ``key``.

    The number of buckets belongs to the table: pass the same one each time. A bucket is
    written in ``files`` parts, so that a task's part of a large table stays small.
    """

    def __init__(
        self,
        spark: SparkSession,
        path: str,
        schema: T.StructType,
        key: Sequence[str],
        buckets: int = BUCKETS,
        files: int = 1,
    ):
        self.spark, self.path, self.schema, self.key = spark, path, schema, list(key)
        self.buckets, self.files = buckets, files

    def _placed(self, rows: DataFrame) -> DataFrame:
        # Keys are hashed by their text, so that 1 as int and as long share a bucket.
        text = [F.col(k).cast("string") for k in self.key]
        return rows.withColumn("bucket", F.pmod(F.xxhash64(*text), F.lit(self.buckets)).cast("int"))

    def _write(self, rows: DataFrame, mode: str) -> None:
        part = F.pmod(F.hash(*self.key), F.lit(self.files))
        placed = self._placed(rows.select(self.schema.names)).repartition("bucket", part)
        writer = placed.sortWithinPartitions("bucket", *self.key).write.partitionBy("bucket")
        writer.mode(mode).option("partitionOverwriteMode", "dynamic").parquet(f"{self.path}/rows")

    def _read(self, buckets: list[int] | None = None) -> DataFrame:
        if not path_exists(self.spark, f"{self.path}/rows"):
            return self.spark.createDataFrame([], self.schema)
        whole = T.StructType([*self.schema.fields, T.StructField("bucket", T.IntegerType())])
        found = self.spark.read.schema(whole).parquet(f"{self.path}/rows")
        if buckets is not None:
            found = found.filter(F.col("bucket").isin(buckets))
        return found.drop("bucket")

    def read(self) -> DataFrame:
        return self._read()

    def touched(self, rows: DataFrame) -> DataFrame:
        """The stored rows of the buckets in which keys of ``rows`` lie.

        At most ``buckets`` numbers come back as literals; no other folder is read.
        """
        found = self._placed(rows.select(self.key)).select("bucket").distinct().collect()
        return self._read([r[0] for r in found])

    def change(self, changes: DataFrame, update: Callable[[DataFrame, DataFrame], DataFrame]) -> None:
        """Replace the touched rows by ``update(touched rows, changes)``.

        ``update`` returns all rows that it was given, changed or not, and new ones, with keys
        that occur in ``changes`` only. A run that fails before the last step has changed
        nothing.
        """
        some = stored(changes, "changes")
        whole = stored(update(self.touched(some), some).select(self.schema.names), "rewritten-buckets")
        self._write(whole, "overwrite")

    def add(self, rows: DataFrame) -> None:
        """Append the rows whose key is not stored yet; files that are there stay.

        One row per key: of several the caller keeps one first.
        """
        new = stored(rows.select(self.schema.names), "added-rows")
        self._write(absent_from(new, self.touched(new), self.key), "append")

    def compact(self, rows: DataFrame) -> None:
        """Write the buckets of ``rows`` anew, each in ``files`` parts, after many appends."""
        self.change(rows.select(self.key), lambda old, _: old)


class IdHead:
    """The highest id given out so far, kept beside a table.

    Ids are reserved before the rows that carry them are written: a run that fails in
    between leaves a gap and no id is given twice. Without the file the table's own highest
    id counts.
    """

    def __init__(self, table: KeyedTable, column: str):
        self.table, self.column = table, column
        self.path = f"{table.path}/head"

    def frame(self) -> DataFrame:
        """One row with the highest id, for numbering."""
        schema = T.StructType([T.StructField(self.column, T.LongType())])
        if path_exists(self.table.spark, f"{self.path}/_SUCCESS"):
            return self.table.spark.read.schema(schema).parquet(self.path)
        highest = F.max(F.col(self.column).cast("long")).alias(self.column)
        return self.table.read().agg(highest)

    def reserve(self, rows: DataFrame) -> None:
        ids = self.frame().unionByName(rows.select(F.col(self.column).cast("long")))
        last = stored(ids.agg(F.max(self.column).alias(self.column)), "id-head")
        last.coalesce(1).write.mode("overwrite").parquet(self.path)


def store_prefs(table: KeyedTable, changes: DataFrame, as_of: datetime) -> None:
    """Changed weights (user_id, category_id, weight, seq) into a table of preferences,
    keyed by user_id and category_id."""
    head = IdHead(table, "pref_id")

    def update(old: DataFrame, new: DataFrame) -> DataFrame:
        after = stored(tables.upsert_prefs(old, new, as_of, numbered_after=head.frame()), "prefs")
        head.reserve(after)
        return after

    table.change(changes, update)


def store_sessions(table: KeyedTable, touches: DataFrame) -> None:
    """Opened and touched sessions into a table of sessions, keyed by session_id."""
    table.change(touches, tables.upsert_sessions)


def store_vectors(table: KeyedTable, encoded: DataFrame) -> None:
    """New vectors (chunk_id, embedding) beside the chunks; stored ones stay as they are."""
    table.add(encoded.filter(F.col("embedding").isNotNull()))


def chunks_with_vectors(chunks: DataFrame, vectors: KeyedTable) -> DataFrame:
    """``chunks`` with the vectors stored beside them; those in the chunks themselves win."""
    beside = vectors.read().select("chunk_id", F.col("embedding").alias("_beside"))
    return chunks.join(beside, "chunk_id", "left").select(
        *[
            F.coalesce("embedding", "_beside").alias(c) if c == "embedding" else F.col(c)
            for c in chunks.columns
        ]
    )
