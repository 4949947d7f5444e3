"""Mixing sources to target weights by Poisson replication.

Every source has a target share of the characters of the mix, which gives it a mean
repetition rate. A document's number of copies is drawn from the Poisson distribution of
that mean by inverting its distribution function at a number hashed from the seed and the
document, so a draw needs no state, is the same on every run and expects exactly the rate.
Copies are dealt to a global order by a second hash.

Rates above ``PART_MEAN`` are the sum of several draws of a part each, which has the same
distribution and keeps the inversion short and exact. Where a row needs very many draws,
they and its copies are dealt to tasks in blocks.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from presswork.llm.common import col, fresh, partitions_for
from presswork.operators.joins import join_hot_key
from presswork.session import stored

PART_MEAN = 16.0
# Beyond this many copies a part of mean 16 has a probability below one in 10^28.
STEPS = 80
CHARS_PER_PARTITION = 1 << 26
_COPIES_AT_ONCE = 1024
# Rows with more draws than this are drawn in blocks of as many. Results are the same.
PARTS_AT_ONCE = 1024


def _hash_number(*parts: Column, digits: int) -> Column:
    """Leading hex digits of an md5 as a whole number."""
    return F.conv(F.substring(F.md5(F.concat_ws("/", *parts)), 1, digits), 16, 10).cast("long")


def _cdf(mean: Column) -> Column:
    """P(X <= k) for k = 0 .. STEPS - 1 of a Poisson variable."""
    first = F.exp(-mean)
    start = F.struct(first.alias("term"), F.array(first).alias("sums"))

    def add(state: Column, k: Column) -> Column:
        term = state["term"] * mean / k
        return F.struct(
            term.alias("term"),
            F.concat(state["sums"], F.array(F.element_at(state["sums"], -1) + term)).alias("sums"),
        )

    steps = F.sequence(F.lit(1), F.lit(STEPS - 1))
    return F.aggregate(steps, start, add, lambda s: s["sums"])


def source_rates(
    docs: DataFrame, weights: dict[str, float], other: float = 1.0, total: int | None = None
) -> DataFrame:
    """(source, n_chars, rate) per source of ``docs``: mean copies of each of its documents.

    A source's weight is its entry in ``weights`` or else ``other``; weights count relative
    to those of the sources that hold text. ``total`` is the size of the mix in characters
    (default: that of the input). Sources without text or weight have rate zero.
    """
    sizes = docs.groupBy(F.col("source").cast("string").alias("source")).agg(
        F.coalesce(F.sum(F.length(F.col("text").cast("string"))), F.lit(0)).alias("n_chars")
    )
    weight = F.lit(float(other))
    for name, w in weights.items():
        weight = F.when(F.col("source") == name, F.lit(float(w))).otherwise(weight)
    sizes = stored(sizes.withColumn("weight", weight), "source-sizes")
    chars, all_weight = sizes.agg(
        F.sum("n_chars"), F.sum(F.when(F.col("n_chars") > 0, F.col("weight")))
    ).first()
    wanted = float(chars or 0) if total is None else float(total)
    rate = F.col("weight") / F.lit(float(all_weight or 0) or 1.0) * F.lit(wanted) / F.col("n_chars")
    return sizes.select(
        "source", "n_chars", F.when(F.col("n_chars") > 0, rate).otherwise(F.lit(0.0)).alias("rate")
    )


def _in_blocks(
    many: DataFrame,
    kept: list[str],
    key: str,
    name: str,
    parts_of: str,
    cdf_of: str,
    first: str,
    last: str,
    drawn: Callable[[Column, Column], Column],
) -> DataFrame:
    """Rows of ``many`` once per block of draws, with the first and last copy of the block.

    Blocks are drawn for distinct keys, numbered on by running sums of a few numbers each,
    and meet their rows again; what is dealt out is a row per some 16,000 copies.
    """
    block, n = fresh(many, "draw_block", "n_drawn")
    keys = many.select(*[col(c) for c in (key, name, parts_of, cdf_of)]).dropDuplicates([key, name])
    dealt = keys.withColumn(
        block, F.explode(F.sequence(F.lit(0).cast("long"), F.floor((col(parts_of) - 1) / PARTS_AT_ONCE)))
    )
    tasks = int(many.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    low = col(block) * PARTS_AT_ONCE + 1
    high = F.least(col(parts_of), low + (PARTS_AT_ONCE - 1))
    sums = stored(
        dealt.repartition(tasks, col(key), col(name), col(block)).select(
            col(key), col(name), col(block), drawn(low, high).alias(n)
        ),
        "draws",
    )
    run = F.sum(col(n)).over(W.partitionBy(col(key), col(name)).orderBy(col(block)))
    ends = sums.withColumn(last, run).filter(col(n) > 0)
    ends = ends.withColumn(first, col(last) - col(n) + 1)
    placed = many.join(ends, [key, name]).repartition(tasks, col(key), col(block))
    return placed.select(*[col(c) for c in [*kept, first, last]])


def replicate(
    docs: DataFrame,
    weights: dict[str, float],
    other: float = 1.0,
    total: int | None = None,
    seed: int = 0,
) -> DataFrame:
    """The mix: ``docs`` with copy (from 1) and shuffle_key added, in global random order.

    A document occurs as often as its draw says, perhaps never. Draws depend on the seed and
    doc_id; rows without doc_id draw by their text, and repeated rows draw alike. Null
    source is a source. Draws and copies of a row at a very high rate are spread over tasks. Columns named copy or shuffle_key give way to the new ones. Sizes
    come from whole texts. No rows: no rows.
    """
    rest = docs.drop("copy", "shuffle_key")
    key, block, name = fresh(rest, "draw_key", "copy_block", "source_key")
    rates = source_rates(docs, weights, other, total)
    parts = F.greatest(F.ceil(F.col("rate") / PART_MEAN), F.lit(1))
    by_source = stored(
        rates.select(
            F.coalesce(F.concat(F.lit("="), "source"), F.lit("-")).alias(name),
            parts.alias("parts"),
            _cdf(F.col("rate") / parts).alias("cdf"),
            "n_chars",
            "rate",
        ),
        "source-rates",
    )
    draw_id = F.coalesce(
        F.col("doc_id").cast("string"),
        F.concat(F.lit("text:"), F.md5(F.coalesce(F.col("text").cast("string"), F.lit("")))),
    )
    source_key = F.coalesce(F.concat(F.lit("="), F.col("source").cast("string")), F.lit("-"))
    seeded = F.lit(str(seed))

    parts_of, cdf_of, first, last = fresh(rest, "n_parts", "cdf_steps", "first_copy", "last_copy")
    few = by_source.select(name, F.col("parts").alias(parts_of), F.col("cdf").alias(cdf_of))
    placed = join_hot_key(rest.withColumns({key: draw_id, name: source_key}), few, [name])

    def drawn(low: Column, high: Column) -> Column:
        """The sum of draws ``low`` to ``high`` of a key."""

        def draw(part: Column) -> Column:
            u = _hash_number(seeded, col(key), part.cast("string"), digits=13)
            u = u / F.lit(float(1 << 52))
            return F.size(F.filter(col(cdf_of), lambda c: c <= u)).cast("long")

        zero = F.lit(0).cast("long")
        return F.aggregate(F.sequence(low, high), zero, lambda sum_, part: sum_ + draw(part))

    kept = [*rest.columns, key]
    one = F.lit(1).cast("long")
    few_draws = placed.filter(col(parts_of) <= PARTS_AT_ONCE)
    some = few_draws.withColumn(last, drawn(one, col(parts_of))).withColumn(first, one)
    some = some.filter(col(last) > 0).select(*[col(c) for c in [*kept, first, last]])
    most_draws = by_source.agg(F.max("parts")).first()[0] or 0
    if most_draws > PARTS_AT_ONCE:
        many = placed.filter(col(parts_of) > PARTS_AT_ONCE)
        some = some.unionByName(_in_blocks(many, kept, key, name, parts_of, cdf_of, first, last, drawn))
    # Two steps, so that a document with very many copies needs no very long array.
    blocks = some.withColumn(
        block,
        F.explode(F.sequence(F.lit(0).cast("long"), F.floor((col(last) - col(first)) / _COPIES_AT_ONCE))),
    )
    start = col(first) + col(block) * _COPIES_AT_ONCE
    copies = blocks.withColumn(
        "copy", F.explode(F.sequence(start, F.least(col(last), start + (_COPIES_AT_ONCE - 1))))
    )
    order = _hash_number(
        F.concat(seeded, F.lit("/order")), col(key), F.col("copy").cast("string"), digits=13
    )
    keyed = copies.select(
        *[col(c) for c in rest.columns], "copy", order.alias("shuffle_key")
    )
    size = by_source.agg(F.sum(F.col("n_chars") * F.col("rate"))).first()[0] or 0
    wanted = partitions_for(int(size), CHARS_PER_PARTITION, docs.sparkSession)
    # The keys are uniform, so equal ranges of them are equal parts; no sampling pass.
    part = F.floor(F.col("shuffle_key") / F.lit(float(1 << 52)) * wanted).cast("int")
    dealt = keyed.repartitionById(wanted, part)
    return dealt.sortWithinPartitions("shuffle_key", "doc_id", "copy")
