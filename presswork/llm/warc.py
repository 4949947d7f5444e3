"""WARC records, and a Merkle fixity audit of replicas.

A replica is a table of records (file, offset, record). The audit hashes every record, then
the records of each offset range in order, then sixteen ranges at a time up to one root per
file. Two replicas are compared from the roots down, and only below nodes whose hashes
differ, so that equal files cost one comparison and a damaged record is found by its path.
Ranges are by offset, so a node covers the same bytes in every replica and its size does not
depend on how many records a file has.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from presswork.operators.joins import join_hot_key
from presswork.session import stored

RANGE_BYTES = 1 << 16
FAN_OUT = 16
RECORDS_PER_FILE = 512
_CRLF = "\r\n"


def record_text(url: Column, payload: Column) -> Column:
    """A WARC resource record; nulls are written as empty."""
    url, payload = F.coalesce(url, F.lit("")), F.coalesce(payload, F.lit(""))
    one_line = F.regexp_replace(url, r"[\r\n]", "")
    name = F.md5(F.concat_ws("\n", url, payload))
    return F.concat(
        F.lit(f"WARC/1.1{_CRLF}WARC-Type: resource{_CRLF}WARC-Target-URI: "),
        one_line,
        F.lit(f"{_CRLF}WARC-Record-ID: <urn:md5:"),
        name,
        F.lit(f">{_CRLF}Content-Type: text/html{_CRLF}Content-Length: "),
        F.octet_length(payload).cast("string"),
        F.lit(_CRLF * 2),
        payload,
        F.lit(_CRLF * 2),
    )


def to_records(pages: DataFrame, per_file: int = RECORDS_PER_FILE) -> DataFrame:
    """(page_id, file, offset, record) of ``pages`` (page_id, url, html).

    Pages are dealt to files of about ``per_file`` records by a hash of their contents and
    lie there in the order of page_id, url and content hash; null ids come first.
    """
    text = record_text(F.col("url").cast("string"), F.col("html").cast("string"))
    rows = pages.select("page_id", text.alias("record"))
    rows = rows.withColumn(
        "mark", F.md5(F.concat_ws("\n", F.coalesce(F.col("page_id").cast("string"), F.lit("")), "record"))
    )
    files = max(1, -(-pages.count() // per_file))
    number = F.conv(F.substring("mark", 1, 12), 16, 10).cast("long") % files
    before = (
        W.partitionBy("file")
        .orderBy(F.asc_nulls_first("page_id"), "mark")
        .rowsBetween(W.unboundedPreceding, -1)
    )
    length = F.octet_length("record").cast("long")
    return rows.withColumn("file", number).select(
        "page_id",
        "file",
        F.coalesce(F.sum(length).over(before), F.lit(0)).alias("offset"),
        "record",
    )


def write_warc(records: DataFrame, path: str) -> None:
    """Write records as uncompressed WARC files, one folder ``file=N`` per file.

    A record ends with a line feed, which is what Spark's text writer adds.
    """
    lines = records.select(
        "file", "offset", F.expr("substring(record, 1, char_length(record) - 1)").alias("value")
    )
    # One task per file: its records in the order of their offsets.
    dealt = lines.repartition("file").sortWithinPartitions("file", "offset").select("file", "value")
    dealt.write.partitionBy("file").text(path, lineSep="\n")


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """(file, offset, record) of what ``write_warc`` wrote. A file must fit into a task.

    Records are cut by their Content-Length; bytes that are no record raise an error.
    """
    found = spark.read.format("binaryFile").load(path).select("file", "path", "content")

    def run(batches):
        for batch in batches:
            rows = []
            for file, name, content in zip(*[c.to_pylist() for c in batch.columns]):
                at = 0
                while at < len(content):
                    head = content.find(b"\r\n\r\n", at)
                    fields = dict(
                        line.split(b": ", 1) for line in content[at:head].split(b"\r\n")[1:]
                    )
                    end = head + 4 + int(fields[b"Content-Length"]) + 4
                    if head < 0 or content[end - 4 : end] != b"\r\n\r\n":
                        raise ValueError(f"{name}: no record at {at}")
                    rows.append((file, at, content[at:end].decode()))
                    at = end
            yield pa.RecordBatch.from_pylist(
                [dict(zip(("file", "offset", "record"), r)) for r in rows],
                schema=pa.schema(
                    [("file", pa.int64()), ("offset", pa.int64()), ("record", pa.string())]
                ),
            )

    return found.select(F.col("file").cast("long").alias("file"), "path", "content").mapInArrow(
        run, "file long, offset long, record string"
    )


# ---------------------------------------------------------------- fixity


# A record without an offset, or without a file, lies at a place of its own.
_NO_OFFSET = -(1 << 63)


def leaves(replica: DataFrame) -> DataFrame:
    """(file, offset, n_bytes, digest, copies) of each different record of a place.

    Texts and binary records alike. ``file`` becomes text, and nulls in any column are
    values like others: a missing file is ``-``, a record that is null has an empty digest.
    """
    return (
        replica.select(
            F.coalesce(F.concat(F.lit("="), F.col("file").cast("string")), F.lit("-")).alias("file"),
            F.coalesce(F.col("offset").cast("long"), F.lit(_NO_OFFSET)).alias("offset"),
            F.coalesce(F.octet_length("record").cast("long"), F.lit(-1)).alias("n_bytes"),
            F.coalesce(F.sha2(F.col("record").cast("binary"), 256), F.lit("")).alias("digest"),
        )
        .groupBy("file", "offset", "n_bytes", "digest")
        .agg(F.count("*").alias("copies"))
    )


def _places(records: DataFrame) -> DataFrame:
    """(file, offset, digest) with one hash for all records of an offset, as a multiset.

    The eight 32-bit words of the records' hashes are summed, which needs no order and
    combines before the shuffle, however many records claim one offset.
    """
    each = F.sha2(F.concat_ws(":", "n_bytes", "digest", "copies"), 256)
    words = records.select("file", "offset", each.alias("hash"))
    sums = [
        F.sum(F.conv(F.substring("hash", 1 + 8 * i, 8), 16, 10).cast("long")).alias(f"w{i}")
        for i in range(8)
    ]
    return words.groupBy("file", "offset").agg(*sums).select(
        "file", "offset", F.sha2(F.concat_ws(":", *[f"w{i}" for i in range(8)]), 256).alias("digest")
    )


def _node(*parts: Column) -> Column:
    """Hash of the children of a node in their order."""
    ordered = F.sort_array(F.collect_list(F.struct(*parts)))
    lines = F.transform(
        ordered, lambda x: F.concat_ws(":", *[x[f"p{i}"].cast("string") for i in range(len(parts))])
    )
    return F.sha2(F.array_join(lines, "\n"), 256).alias("digest")


def tree(records: DataFrame, levels: int) -> list[DataFrame]:
    """Nodes (file, node, digest) per level, ranges first and roots last.

    A range holds the offsets in ``RANGE_BYTES`` bytes, so its size is bounded.
    """
    first = _places(records).withColumn("node", F.floor(F.col("offset") / RANGE_BYTES))
    parts = [F.col(c).alias(f"p{i}") for i, c in enumerate(("offset", "digest"))]
    out = [stored(first.groupBy("file", "node").agg(_node(*parts)), "merkle")]
    for _ in range(levels):
        children = [F.col("child").alias("p0"), F.col("digest").alias("p1")]
        above = (
            out[-1]
            .select("file", F.col("node").alias("child"), "digest")
            .withColumn("node", F.floor(F.col("child") / FAN_OUT))
            .groupBy("file", "node")
            .agg(_node(*children))
        )
        out.append(stored(above, "merkle"))
    return out


def audit(left: DataFrame, right: DataFrame) -> DataFrame:
    """(file, offset, status, left_digest, right_digest, copies) of all that differs.

    status: changed, missing (not in ``right``) or extra (not in ``left``). Equal replicas,
    also empty ones, give no rows. The records of one file and offset are compared as a
    multiset: where one kind of record is left over on either side it has changed, and
    everything else left over is missing or extra, with its number of copies (of a changed
    record, the larger one). Null files and offsets are places like others, a null record
    has a null digest.
    """
    kind = left.schema["file"].dataType
    sides = [stored(leaves(x), "leaves") for x in (left, right)]
    ends = [s.agg(F.max("offset")).first()[0] or 0 for s in sides]
    levels, ranges = 0, max(0, *ends) // RANGE_BYTES
    while ranges:
        levels, ranges = levels + 1, ranges // FAN_OUT
    trees = [tree(s, levels) for s in sides]

    def differing(level: int, among: DataFrame | None) -> DataFrame:
        a, b = (t[level] for t in trees)
        if among is not None:
            below = among.select("file", F.col("node").alias("up"))
            a, b = (
                x.withColumn("up", F.floor(F.col("node") / FAN_OUT))
                .join(below, ["file", "up"], "left_semi")
                .drop("up")
                for x in (a, b)
            )
        both = a.join(b.withColumnRenamed("digest", "other"), ["file", "node"], "full")
        return both.filter(~F.col("digest").eqNullSafe(F.col("other"))).select("file", "node")

    suspect = None
    for level in range(levels, -1, -1):
        suspect = differing(level, suspect)
    record = ["file", "offset", "n_bytes", "digest"]
    found = [
        s.withColumn("node", F.floor(F.col("offset") / RANGE_BYTES))
        .join(suspect, ["file", "node"], "left_semi")
        .select(*record, F.col("copies").alias(side))
        for s, side in zip(sides, ("in_left", "in_right"))
    ]
    surplus = stored(
        found[0]
        .join(found[1], record, "full")
        .select(*record, (F.coalesce("in_left", F.lit(0)) - F.coalesce("in_right", F.lit(0))).alias("more"))
        .filter("more != 0"),
        "surplus",
    )
    # One row a place, combined before the shuffle; few places have more than one kind.
    kinds = surplus.groupBy("file", "offset").agg(
        (F.count_if(F.col("more") > 0) == 1).alias("one_left"),
        (F.count_if(F.col("more") < 0) == 1).alias("one_right"),
        F.min(F.when(F.col("more") > 0, F.col("digest"))).alias("left_digest"),
        F.min(F.when(F.col("more") < 0, F.col("digest"))).alias("right_digest"),
        F.max(F.abs("more")).alias("copies"),
    )
    pairs = F.col("one_left") & F.col("one_right")
    changed = kinds.filter(pairs).select(
        "file", "offset", F.lit("changed").alias("status"), "left_digest", "right_digest", "copies"
    )
    rest = join_hot_key(surplus, kinds.filter(~pairs).select("file", "offset"), ["file", "offset"])
    gone = F.col("more") > 0
    single = rest.select(
        "file",
        "offset",
        F.when(gone, "missing").otherwise("extra").alias("status"),
        F.when(gone, F.col("digest")).alias("left_digest"),
        F.when(~gone, F.col("digest")).alias("right_digest"),
        F.abs("more").alias("copies"),
    )
    return changed.unionByName(single).select(
        F.when(F.col("file") != "-", F.substring("file", 2, 1 << 30).cast(kind)).alias("file"),
        F.nullif("offset", F.lit(_NO_OFFSET)).alias("offset"),
        "status",
        F.nullif("left_digest", F.lit("")).alias("left_digest"),
        F.nullif("right_digest", F.lit("")).alias("right_digest"),
        "copies",
    )
