"""How far the sources of a language differ in their words, in exact integer arithmetic.

A text becomes terms by one translate and one split: the table lowers A-Z and blanks every
other byte below 0x80 that is no letter. A Counter per document gives frequencies and, by
its keys, document counts; tasks add them up per language and source and send on what they
hold. From there everything is sparse: a source's terms that do not occur are never rows,
and what they add to a divergence follows from counts of counts.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from presswork.llm.common import BLOCK_BYTES, col, raw_texts
from presswork.operators.joins import join_hot_key, top_per_group
from presswork.session import stored

MIN_DOCS = 10
TOP_TERMS = 10
SCALE = 1_000_000_000
# Different terms a task holds before it sends them on (half a kilobyte counts as one).
HELD = 300_000
# Sparse entries that meet in one task, and sources on either side of a block of pairs.
ENTRIES_PER_TASK = 500_000
SOURCES_PER_BLOCK = 512

_LETTERS = frozenset(range(0x41, 0x5B)) | frozenset(range(0x61, 0x7B))
TABLE = bytes(
    (b | 0x20 if 0x41 <= b <= 0x5A else b) if b >= 0x80 or b in _LETTERS else 0x20
    for b in range(256)
)
_BREAK = re.compile(rb"[\x00-\x40\x5b-\x60\x7b-\x7f]")


def terms(raw: bytes) -> Iterator[list[bytes]]:
    """Terms of a text in turn, a bounded stretch of it at a time."""
    at = 0
    while len(raw) - at > BLOCK_BYTES:
        gap = _BREAK.search(raw, at + BLOCK_BYTES)
        if gap is None:
            break
        yield raw[at : gap.start()].translate(TABLE).split()
        at = gap.end()
    yield raw[at:].translate(TABLE).split()


def count_text(raw: bytes) -> Counter:
    """The term frequencies of one document."""
    counts: Counter = Counter()
    for stretch in terms(raw):
        counts.update(stretch)
    return counts


class _Held:
    """Sums of document counters per language and source, up to a bounded number of terms."""

    def __init__(self):
        self.documents: dict[tuple, Counter] = {}
        self.repeats: dict[tuple, Counter] = {}

    def add(self, group: tuple, counts: Counter) -> int:
        """Add a document; returns by how many terms the sums have grown."""
        seen = self.documents.setdefault(group, Counter())
        before = len(seen)
        seen.update(counts.keys())
        more = self.repeats.setdefault(group, Counter())
        for term, n in counts.items():
            if n > 1:
                more[term] += n - 1
        return len(seen) - before

    def rows(self) -> Iterator[pa.RecordBatch]:
        for (lang, source), seen in self.documents.items():
            more = self.repeats[lang, source]
            found = list(seen)
            n_docs = list(seen.values())
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([lang] * len(found), pa.string()),
                    pa.array([source] * len(found), pa.string()),
                    pa.array([t.decode("utf-8", "replace") for t in found], pa.string()),
                    pa.array([n + more[t] for t, n in seen.items()], pa.int64()),
                    pa.array(n_docs, pa.int64()),
                ],
                ["lang", "source", "term", "n", "n_docs"],
            )


def term_counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """lang, source, term, n (occurrences) and n_docs (documents that hold it).

    Null texts, languages and sources are empty strings. A group whose documents hold no
    term has no row here.
    """
    rows = docs.select(
        *(F.coalesce(col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source")),
        col(text).alias("text"),
    )

    def run(batches):
        held, size = _Held(), 0
        for batch in batches:
            langs, sources = (batch.column(i).to_pylist() for i in (0, 1))
            for lang, source, raw in zip(langs, sources, raw_texts(batch.column(2))):
                if raw:
                    counts = count_text(raw)
                    size += held.add((lang, source), counts)
                    size += sum(map(len, counts)) // 512
                if size > HELD:
                    yield from held.rows()
                    held, size = _Held(), 0
        yield from held.rows()

    schema = "lang string, source string, term string, n long, n_docs long"
    # A term of a large source is one row of a task before the shuffle.
    return (
        rows.mapInArrow(run, schema)
        .groupBy("lang", "source", "term")
        .agg(F.sum("n").alias("n"), F.sum("n_docs").alias("n_docs"))
    )


def share(n: Column, total: Column, kinds: Column) -> Column:
    """p = 1 + floor(SCALE * (n + 2) / (total + 2 * kinds)), in decimals of 38 digits."""
    above = F.lit(SCALE).cast("decimal(10,0)") * (n + 2).cast("decimal(20,0)")
    below = (total + 2 * kinds).cast("decimal(20,0)")
    return (F.lit(1) + F.call_function("div", above, below)).cast("long")


def distance(p: Column, q: Column) -> Column:
    """f = floor((p - q)^2 / (p + q)); shares are at most SCALE + 1, so squares fit a long."""
    return F.call_function("div", (p - q) * (p - q), p + q)


def _f(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    gap = p - q
    return gap * gap // (p + q)


def _shared_terms(rows: pd.DataFrame) -> pd.DataFrame:
    """For the pairs of sources of one block, left place below right place: sums over terms
    that both have of what the pair adds against one or both having the term zero times.

    ``rows`` are entries (term, place, p, and p0 for count zero) of the sources of two
    sides; memory is in proportion to them, and each left source goes over them once.
    """
    rows = rows.sort_values("place", kind="stable")
    number, names = pd.factorize(rows["term"])
    place, p, p0, left, right = (
        rows[c].to_numpy() for c in ("place", "p", "p0", "left_side", "right_side")
    )
    starts = np.flatnonzero(np.concatenate(([True], place[1:] != place[:-1])))
    ends = np.concatenate((starts[1:], [len(place)]))
    own = np.zeros(len(names), np.int64)
    found = []
    for i, (start, end) in enumerate(zip(starts, ends)):
        if not left[start] or end == len(place):
            continue
        own[number[start:end]] = p[start:end]
        mine = own[number[end:]]
        both = np.flatnonzero((mine > 0) & right[end:])
        one, two, none = mine[both], p[end:][both], p0[end:][both]
        change = np.zeros(len(mine), np.int64)
        change[both] = _f(one, two) - _f(one, none) - _f(p0[start], two) + _f(p0[start], none)
        sums = np.add.reduceat(change, starts[i + 1 :] - end)
        some = np.flatnonzero(sums)
        found.append(
            pd.DataFrame({"a": place[start], "b": place[starts[i + 1 :]][some], "value": sums[some]})
        )
        own[number[start:end]] = 0
    out = pd.concat(found) if found else pd.DataFrame({"a": [], "b": [], "value": []})
    out.insert(0, "lang", rows["lang"].iloc[0])
    return out.astype({"a": "int64", "b": "int64", "value": "int64"})


def _pair_sums(entries: DataFrame, groups: DataFrame) -> DataFrame:
    """lang, a, b (places, a below b) and the divergence of the two sources.

    With p0 for a count of zero, the sum over all kept terms is kinds * f(p0a, p0b), plus
    for each of the two what its terms add if the other had none of them, plus for shared
    terms the rest. The first needs no entries and the second only counts of equal shares.
    """
    ours = groups.select("lang", "place", "p0", "kinds")
    theirs = groups.select("lang", F.col("place").alias("other"), F.col("p0").alias("q0"))
    # One row per pair of sources of a language, as many as the result has.
    pairs = join_hot_key(ours, theirs, ["lang"]).filter("place < other")
    base = pairs.select(
        "lang",
        F.col("place").alias("a"),
        F.col("other").alias("b"),
        F.coalesce(F.col("kinds") * distance(F.col("p0"), F.col("q0")), F.lit(0)).alias("value"),
    )
    equal = entries.groupBy("lang", "place", "p0", "p").agg(F.count("*").alias("times"))
    alone = (
        join_hot_key(equal, theirs, ["lang"])
        .filter("place != other")
        .select(
            "lang",
            F.least("place", "other").alias("a"),
            F.greatest("place", "other").alias("b"),
            (
                F.col("times")
                * (distance(F.col("p"), F.col("q0")) - distance(F.col("p0"), F.col("q0")))
            ).alias("value"),
        )
    )
    # Terms are dealt to blocks of a bounded number of entries, and sources beyond a bounded
    # number to sides that meet in pairs.
    side = F.floor((F.col("place") - 1) / SOURCES_PER_BLOCK).cast("int")
    last = F.floor((F.col("n_sources") - 1) / SOURCES_PER_BLOCK).cast("int")
    dealt = (
        entries.withColumn("bucket", F.pmod(F.xxhash64("term"), F.col("blocks")))
        .withColumn("side", side)
        .withColumn("opposite", F.explode(F.sequence(F.lit(0), last)))
        .select(
            "lang",
            "bucket",
            F.least("side", "opposite").alias("side_a"),
            F.greatest("side", "opposite").alias("side_b"),
            "term",
            "place",
            "p",
            "p0",
            (F.col("side") <= F.col("opposite")).alias("left_side"),
            (F.col("side") >= F.col("opposite")).alias("right_side"),
        )
    )
    shared = dealt.groupBy("lang", "bucket", "side_a", "side_b").applyInPandas(
        _shared_terms, "lang string, a int, b int, value long"
    )
    return (
        base.unionByName(alone)
        .unionByName(shared)
        .groupBy("lang", "a", "b")
        .agg(F.sum("value").alias("value"))
    )


def source_divergence(docs: DataFrame, min_docs: int = MIN_DOCS, top: int = TOP_TERMS) -> DataFrame:
    """What sets the sources of each language apart: whole sources, and single terms.

    A language keeps the terms that ``min_docs`` of its documents hold. Shares p are
    smoothed by two and scaled to integers. Columns: lang, source, part, item, value, rank.
    Part ``pair`` has a row per other source of the language (item) with f summed over all
    kept terms, 0 if there are none; part ``term`` the ``top`` kept terms the source uses
    more than its language, by f against the language. Ranks start at 1 per source and part,
    by falling value and then by item in byte order. Null texts, languages and sources are
    empty strings; repeated rows count as often as they occur; no documents give no rows.
    """
    named = docs.select(
        *(F.coalesce(col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source"))
    ).distinct()
    counted = stored(term_counts(docs), "term-counts")
    kept = (
        counted.groupBy("lang", "term")
        .agg(F.sum("n").alias("lang_n"), F.sum("n_docs").alias("lang_docs"))
        .filter(F.col("lang_docs") >= min_docs)
        .drop("lang_docs")
    )
    used = stored(counted.drop("n_docs").join(kept, ["lang", "term"]), "kept-terms")

    # One row per source of a language, with the sums of both.
    totals = used.groupBy("lang", "source").agg(
        F.sum("n").alias("total"), F.count("*").alias("n_entries")
    )
    sums = totals.groupBy("lang").agg(
        F.sum("total").alias("lang_total"), F.sum("n_entries").alias("lang_entries")
    )
    kinds = used.select("lang", "term").distinct().groupBy("lang").agg(F.count("*").alias("kinds"))
    order = W.partitionBy("lang").orderBy("source")
    zero = F.lit(0).cast("long")
    groups = (
        named.join(totals, ["lang", "source"], "left")
        .join(sums, "lang", "left")
        .join(kinds, "lang", "left")
        .na.fill(0, ["total", "lang_total", "lang_entries", "kinds"])
        .select(
            "lang",
            "source",
            "total",
            "lang_total",
            "kinds",
            F.row_number().over(order).alias("place"),
            F.count("*").over(W.partitionBy("lang")).alias("n_sources"),
            F.greatest(F.ceil(F.col("lang_entries") / ENTRIES_PER_TASK), F.lit(1)).alias("blocks"),
            F.when(F.col("kinds") > 0, share(zero, F.col("total"), F.col("kinds"))).alias("p0"),
        )
    )
    groups = stored(groups, "source-groups")
    entries = stored(
        join_hot_key(used, groups, ["lang", "source"])
        .withColumn("p", share(F.col("n"), F.col("total"), F.col("kinds")))
        .withColumn("q", share(F.col("lang_n"), F.col("lang_total"), F.col("kinds")))
        .drop("n", "lang_n", "total", "lang_total", "kinds"),
        "term-shares",
    )

    pairs = _pair_sums(entries, groups)
    both_ways = pairs.unionByName(
        pairs.select("lang", F.col("b").alias("a"), F.col("a").alias("b"), "value")
    )
    names = groups.select("lang", "source", "place")
    pair = (
        both_ways.join(names.withColumnRenamed("place", "a"), ["lang", "a"])
        .join(names.select("lang", F.col("source").alias("item"), F.col("place").alias("b")), ["lang", "b"])
        .select("lang", "source", "item", "value")
    )
    ranked = pair.withColumn(
        "rank", F.row_number().over(W.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))
    )
    marked = entries.filter("p > q").select(
        "lang", "source", F.col("term").alias("item"), distance(F.col("p"), F.col("q")).alias("value")
    )
    best = top_per_group(marked, ["lang", "source"], [F.desc("value"), F.col("item")], top, "rank")
    out = ["lang", "source", "part", "item", "value", "rank"]
    return (
        ranked.withColumn("part", F.lit("pair"))
        .select(*out)
        .unionByName(best.withColumn("part", F.lit("term")).select(*out))
    )
