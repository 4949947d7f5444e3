"""Small helpers shared by the corpus operators."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from presswork.session import ship_package

BLOCK_BYTES = 1 << 22
_SPACE = re.compile(rb"[\x20\x09-\x0d]")


ARROW_ROWS, ARROW_BYTES = 1_000, 8 << 20


def prepare(spark: SparkSession) -> None:
    """Ship the package, and keep the batches in which texts go to Python small."""
    ship_package(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(ARROW_BYTES))


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def col(name: str) -> Column:
    """A column by its literal name, whatever characters that has."""
    return F.col("`" + name.replace("`", "``") + "`")


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Names for working columns that clash with no column of ``df`` (case ignored)."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


def raw_texts(column: pa.Array) -> list[bytes | None]:
    """A string column as UTF-8 bytes; other types by their text."""
    if not (pa.types.is_string(column.type) or pa.types.is_large_string(column.type)):
        column = column.cast(pa.string())
    return column.cast(pa.binary()).to_pylist()


def decoded(raw: bytes) -> str:
    """Text of UTF-8 bytes; broken sequences become U+FFFD."""
    return raw.decode("utf-8", "replace")


def word_blocks(raw: bytes, block: int = BLOCK_BYTES) -> Iterator[list[bytes]]:
    """Words ``[^\\x20\\x09-\\x0D]+`` of a text, a bounded stretch of it at a time.

    Stretches end at white space, so every word comes out whole.
    """
    at = 0
    while len(raw) - at > block:
        gap = _SPACE.search(raw, at + block)
        if gap is None:
            break
        yield raw[at : gap.start()].split()
        at = gap.end()
    yield (raw[at:] if at else raw).split()


def partitions_for(rows: int, per_partition: int, spark: SparkSession) -> int:
    """Enough partitions for tasks of a bounded number of rows, and for every core."""
    return max(-(-rows // per_partition), int(spark.conf.get("spark.sql.shuffle.partitions")))


class Memo:
    """What was made for texts, in two generations: when the younger one is full the older
    one goes, and texts still in use move over, so common ones are never made again.

    Texts of more than ``longest`` characters are forgotten at the next call.
    """

    def __init__(self, limit: int, longest: int):
        self.limit, self.longest = limit, longest
        self.young: dict = {}
        self.old: dict = {}
        self.passing: list = []

    def fill(self, wanted: set[str], make) -> dict:
        """A mapping that holds all ``wanted``; ``make`` gives the values of a list of new ones."""
        for text in self.passing:
            del self.young[text]
        if len(self.young) > self.limit:
            self.old, self.young = self.young, {}
        new = wanted.difference(self.young)
        self.young.update((k, self.old[k]) for k in new if k in self.old)
        made = [k for k in new if k not in self.old]
        self.young.update(zip(made, make(made)))
        self.passing = [k for k in made if len(k) > self.longest]
        return self.young
