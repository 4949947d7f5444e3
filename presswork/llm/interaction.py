"""Audit of how filters interact: every order of a set of filters, from one pass.

Each document is read once and reduced to a mask of the filters it fails; per part of the
corpus documents are counted by mask. A Gray-code walk then visits all subsets of the
filters, toggling one at a time: every mask cell keeps a counter of the active filters it
fails, and the running survivors change by the cells whose counter leaves or reaches zero.
The 2^k states are stored, and each step of each order is a difference of two of them.
"""

from __future__ import annotations

import hashlib
import itertools
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from presswork.llm.common import col, raw_texts, word_blocks
from presswork.session import stored

FILTERS = "ABCDE"
COUNTS = ("n", "good", "toxic")
# All orders of k filters are k! * k rows a part, and states 2^k.
MAX_FILTERS = 8

MIN_WORDS = 100
MIN_DISTINCT = 80
MAX_CAPITALS = 10
_CAPITALS = bytes(range(0x41, 0x5B))
_SYMBOLS = b"#$%&*|"
_CONTINUED = bytes(range(0x80, 0xC0))


def text_failures(raw: bytes) -> int:
    """Bits of the filters A to D that a whole text fails (bit 0 is A).

    A: under 100 words. B: fewer than 80 in 100 words are different. C: more than 10 in 100
    code points are capitals A-Z. D: holds one of ``#$%&*|``.
    """
    n_words, seen = 0, set()
    for words in word_blocks(raw):
        n_words += len(words)
        seen.update(words)
    n_capitals = len(raw) - len(raw.translate(None, _CAPITALS))
    n_points = len(raw.translate(None, _CONTINUED))
    return (
        (n_words < MIN_WORDS)
        | (100 * len(seen) < MIN_DISTINCT * n_words) << 1
        | (100 * n_capitals > MAX_CAPITALS * n_points) << 2
        | any(s in raw for s in _SYMBOLS) << 3
    )


def failure_masks(docs: DataFrame, part: str = "lang", text: str = "text") -> DataFrame:
    """Documents by doc_id, part, mask of the failed filters, and how often such a row occurs.

    Filter E (bit 4) is failed by a text that a smaller doc_id has, anywhere in the table; a
    null doc_id is neither smaller nor larger than another. Null texts and parts are empty.
    Texts are compared by SHA-256; they do not leave the task that read them.
    """
    rows = docs.select(
        col("doc_id").alias("doc_id"),
        F.coalesce(col(part).cast("string"), F.lit("")).alias("part"),
        col(text).alias("text"),
    )

    def run(batches):
        for batch in batches:
            raw = [t or b"" for t in raw_texts(batch.column(2))]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    batch.column(1),
                    pa.array([hashlib.sha256(t).digest() for t in raw], pa.binary()),
                    pa.array([text_failures(t) for t in raw], pa.int32()),
                ],
                ["doc_id", "part", "digest", "mask"],
            )

    schema = T.StructType(
        [
            rows.schema["doc_id"],
            T.StructField("part", T.StringType()),
            T.StructField("digest", T.BinaryType()),
            T.StructField("mask", T.IntegerType()),
        ]
    )
    # Read twice below; it holds some sixty bytes a document.
    marked = stored(rows.mapInArrow(run, schema), "masks")
    # Both groupings combine before the shuffle, so a text or row that makes up much of the
    # table is one row of each task; the join is by text and id, which no copies share.
    once = marked.groupBy("digest", "doc_id", "part", "mask").agg(F.count("*").alias("times"))
    first = (
        marked.filter("doc_id IS NOT NULL")
        .groupBy("digest")
        .agg(F.min("doc_id").alias("doc_id"))
        .withColumn("is_first", F.lit(True))
    )
    later = F.col("doc_id").isNotNull() & F.col("is_first").isNull()
    return once.join(first, ["digest", "doc_id"], "left").select(
        "doc_id",
        "part",
        (F.col("mask") + F.when(later, 16).otherwise(0)).alias("mask"),
        "times",
    )


def cells(masks: DataFrame, labels: DataFrame) -> DataFrame:
    """Counts by part and mask: n, good (a label of quality 1) and toxic (a label of toxic 1).

    A doc_id with several labels is good or toxic if one of them says so.
    """
    marks = labels.groupBy("doc_id").agg(
        F.coalesce(F.max(F.col("quality") == 1), F.lit(False)).alias("good"),
        F.coalesce(F.max(F.col("toxic") == 1), F.lit(False)).alias("toxic"),
    )

    def counted(flag: str) -> Column:
        return F.sum(F.when(F.col(flag), F.col("times")).otherwise(0)).alias(flag)

    # An id that repeats is counted before the join; null ids have no label.
    ids = masks.groupBy("doc_id", "part", "mask").agg(F.sum("times").alias("times"))
    known = ids.filter("doc_id IS NOT NULL").join(marks, "doc_id", "left")
    unknown = ids.filter("doc_id IS NULL")
    for name in ("good", "toxic"):
        unknown = unknown.withColumn(name, F.lit(False))
    return (
        known.unionByName(unknown)
        .groupBy("part", "mask")
        .agg(F.sum("times").alias("n"), counted("good"), counted("toxic"))
    )


def gray_walk(k: int) -> Iterator[tuple[int, int]]:
    """(filter toggled, subset reached) from the empty subset through all others of k."""
    subset = 0
    for step in range(1, 1 << k):
        toggled = (step & -step).bit_length() - 1
        subset ^= 1 << toggled
        yield toggled, subset


def survivor_states(masks: np.ndarray, counts: np.ndarray, k: int) -> np.ndarray:
    """Survivors of every subset of filters, indexed by its bits.

    ``counts`` has a row per mask cell. A cell survives while none of the active filters is
    among those it fails, that is, while its counter is zero.
    """
    fails = (masks[:, None] >> np.arange(k)) & 1 == 1
    active_failures = np.zeros(len(masks), np.int64)
    running = counts.sum(axis=0)
    states = np.zeros((1 << k, counts.shape[1]), np.int64)
    states[0] = running
    for toggled, subset in gray_walk(k):
        touched = fails[:, toggled]
        if subset >> toggled & 1:
            running = running - counts[touched & (active_failures == 0)].sum(axis=0)
            active_failures[touched] += 1
        else:
            active_failures[touched] -= 1
            running = running + counts[touched & (active_failures == 0)].sum(axis=0)
        states[subset] = running
    return states


def order_steps(states: np.ndarray, names: str) -> list[tuple]:
    """Every order and step as differences of the stored states."""
    k = len(names)
    full = (1 << k) - 1
    alone = [int(states[0, 0] - states[1 << f, 0]) for f in range(k)]
    unique = [int(states[full ^ 1 << f, 0] - states[full, 0]) for f in range(k)]
    rows, share = [], Counter()
    for order in itertools.permutations(range(k)):
        name = "".join(names[f] for f in order)
        subset = 0
        for step, f in enumerate(order, 1):
            after = subset | 1 << f
            removed, good, toxic = (int(x) for x in states[subset] - states[after])
            kept = int(states[after, 0])
            rows.append((f, name, step, kept, removed, alone[f] - removed, unique[f], good, toxic))
            share[f] += removed
            subset = after
    return [(*row[1:], share[row[0]]) for row in rows]


_STEPS = [
    "filter_order", "step", "kept", "removed", "redundant",
    "unique_fails", "good_lost", "toxic_lost", "shapley",
]


def audit(counted: DataFrame, names: str = FILTERS) -> DataFrame:
    """One row per part, order of the filters and step, from counts by part and mask.

    ``names`` has a letter per filter; bit i of a mask is the i-th. Columns: part,
    filter_order, step (from 1), kept (after the step), removed (in it), redundant (fail its
    filter, were removed earlier), unique_fails (fail its filter only), good_lost and
    toxic_lost (of the removed), shapley (removed by its filter, summed over all orders).
    Masks beyond the filters are an error. No rows give no rows.
    """
    k = len(names)
    if not 1 <= k <= MAX_FILTERS or len(set(names)) != k:
        raise ValueError(f"from 1 to {MAX_FILTERS} filters with different letters")

    def walk(part: pd.DataFrame) -> pd.DataFrame:
        masks = part["mask"].to_numpy(np.int64)
        if (masks >> k).any():
            raise ValueError("a mask with more filters than there are names")
        states = survivor_states(masks, part[list(COUNTS)].to_numpy(np.int64), k)
        out = pd.DataFrame(order_steps(states, names), columns=_STEPS)
        out.insert(0, "part", part["part"].iloc[0])
        return out

    kinds = {"filter_order": "string", "step": "int"}
    schema = ", ".join(f"{c} {kinds.get(c, 'long')}" for c in _STEPS)
    # At most 2^k rows a part meet in a task, however many documents the part has.
    return counted.groupBy("part").applyInPandas(walk, f"part string, {schema}")


def audit_documents(docs: DataFrame, labels: DataFrame, part: str = "lang") -> DataFrame:
    """The audit of the five text filters over whole documents, by language."""
    return audit(cells(failure_masks(docs, part), labels))
