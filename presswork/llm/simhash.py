"""SimHash near-duplicates by a trie join of the fingerprints.

A fingerprint is a path in a binary trie. The join walks pairs of nodes of the same depth
together, adds up the bits in which the two paths differ and drops a pair as soon as that
exceeds the budget. The trie is never built: a node is a range of the sorted fingerprints.

How Spark deals it out: of two fingerprints with at most three differing bits, one of the
four quarters is equal. So there are four tries, each beginning with another quarter, and
in each the first 16 levels must match without error. Subtrees below them are independent
tasks; four rows per fingerprint are shuffled, whatever the number of fingerprints. A
subtree with more than ``TILE`` fingerprints (a huge group of near copies) is cut into
tiles, and each pair of tiles becomes a unit of work of its own.

Links are not written out as pairs: each task joins what it has linked and sends one row
per fingerprint, its link to the smallest of them. Global components follow from these.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import islice, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from presswork.llm.common import col, fresh, partitions_for, raw_texts, word_blocks
from presswork.llm.components import components
from presswork.operators.joins import checked_broadcast
from presswork.session import stored

SHINGLE_WORDS = 3
MAX_BITS = 3
SEED = 42
TILE = 65_536
ROWS_PER_TASK = 250_000
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
_HASHES_AT_ONCE = 1 << 15
_PAIRS_AT_ONCE = 1 << 18
_LEAF = 16


def _shingles(raw: bytes, width: int) -> Iterator[bytes]:
    """Space-joined runs of ``width`` words, in order; the whole sequence if it is shorter."""
    carried: list[bytes] = []
    emitted = False
    for words in word_blocks(raw):
        words = carried + words
        if len(words) >= width:
            emitted = True
            yield from map(b" ".join, zip(*(words[i:] for i in range(width))))
        carried = words[max(0, len(words) - width + 1) :] if width > 1 else []
    if not emitted and carried:
        yield b" ".join(carried)


def fingerprint(raw: bytes | None, width: int = SHINGLE_WORDS) -> int:
    """64-bit fingerprint as a signed integer; zero for a text without words."""
    ones, total = np.zeros(64, np.int64), 0
    found = _shingles((raw or b"").translate(_LOWER), width)
    hashes = map(xxhash.xxh64_intdigest, found, repeat(SEED))
    while True:
        some = np.fromiter(islice(hashes, _HASHES_AT_ONCE), np.uint64)
        if not len(some):
            break
        bits = np.unpackbits(some.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
        total += len(some)
    packed = np.packbits(ones * 2 > total, bitorder="little")
    return int(packed.view("<i8")[0])


def fingerprints(docs: DataFrame, keep: list[str], width: int = SHINGLE_WORDS) -> DataFrame:
    """Columns ``keep`` of ``docs`` (with column text) and fp, the signed fingerprint."""
    kept = [col(c).alias(f"k{i}") for i, c in enumerate(keep)]
    narrow = docs.select(*kept, F.col("text").cast("string").alias("text"))

    def run(batches):
        for batch in batches:
            made = [fingerprint(t, width) for t in raw_texts(batch.column("text"))]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:-1], pa.array(made, pa.int64())],
                [*batch.schema.names[:-1], "fp"],
            )

    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in narrow.schema.fields[:-1])
    made = narrow.mapInArrow(run, f"{fields}, fp long")
    return made.select(*[F.col(f"k{i}").alias(c) for i, c in enumerate(keep)], "fp")


# ---------------------------------------------------------------- the join inside a task


def _direct(bits, a_lo, a_hi, b_lo, b_hi, budget):
    """All element pairs of small node pairs, kept if within the budget."""
    width = b_hi - b_lo
    count = (a_hi - a_lo) * width
    which = np.repeat(np.arange(len(count)), count)
    at = np.arange(len(which)) - np.repeat(np.cumsum(count) - count, count)
    i, j = a_lo[which] + at // width[which], b_lo[which] + at % width[which]
    near = (i < j) & (np.bitwise_count(bits[i] ^ bits[j]) <= budget)
    return i[near], j[near]


def trie_pairs(
    bits: np.ndarray, starts: np.ndarray, ends: np.ndarray, levels: int, budget: int
) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs (i < j) of ``bits`` inside one root range that differ in <= budget bits.

    ``bits`` (uint64) is sorted inside each root range [start, end); within a root only the
    lowest ``levels`` bits differ. Node pairs of one level are held as arrays; a frontier
    over a bounded size is halved and its second half waits on a stack.
    """
    roots = ends - starts > 1
    lo, hi = starts[roots].astype(np.int64), ends[roots].astype(np.int64)
    stack = [(levels - 1, lo, hi, lo, hi, np.zeros(len(lo), np.int8))]
    while stack:
        level, a_lo, a_hi, b_lo, b_hi, spent = stack.pop()
        while len(a_lo):
            small = (a_hi - a_lo) * (b_hi - b_lo) <= _LEAF
            if level < 0:  # equal paths to the last bit: repeated values
                small[:] = True
            if small.any():
                yield _direct(bits, a_lo[small], a_hi[small], b_lo[small], b_hi[small], budget)
                a_lo, a_hi, b_lo, b_hi, spent = (
                    x[~small] for x in (a_lo, a_hi, b_lo, b_hi, spent)
                )
                if not len(a_lo):
                    break
            if len(a_lo) > _PAIRS_AT_ONCE:
                cut = len(a_lo) // 2
                stack.append((level, *(x[cut:] for x in (a_lo, a_hi, b_lo, b_hi, spent))))
                a_lo, a_hi, b_lo, b_hi, spent = (
                    x[:cut] for x in (a_lo, a_hi, b_lo, b_hi, spent)
                )
            # Children: zeros come first in a range, so one count finds the middle.
            zero = (bits >> np.uint64(level)) & np.uint64(1) == 0
            before = np.concatenate(([0], np.cumsum(zero)))
            a_mid = a_lo + before[a_hi] - before[a_lo]
            b_mid = b_lo + before[b_hi] - before[b_lo]
            own = a_lo == b_lo  # a node with itself has one mixed pair, not two
            children = [
                (a_lo, a_mid, b_lo, b_mid, spent, None),
                (a_mid, a_hi, b_mid, b_hi, spent, None),
                (a_lo, a_mid, b_mid, b_hi, spent + 1, None),
                (a_mid, a_hi, b_lo, b_mid, spent + 1, ~own),
            ]
            parts = []
            for al, ah, bl, bh, d, also in children:
                live = (ah > al) & (bh > bl) & (d <= budget)
                live &= (al != bl) | (ah - al > 1)
                if also is not None:
                    live &= also
                parts.append([x[live] for x in (al, ah, bl, bh, d)])
            a_lo, a_hi, b_lo, b_hi, spent = (np.concatenate(x) for x in zip(*parts))
            level -= 1


def _unite(parent: np.ndarray, i: np.ndarray, j: np.ndarray) -> None:
    """Merge the sets of each pair; ``parent`` stays flat and points to smaller indices."""
    while len(i):
        a, b = parent[i], parent[j]
        apart = a != b
        i, j, a, b = i[apart], j[apart], a[apart], b[apart]
        if not len(i):
            return
        np.minimum.at(parent, np.maximum(a, b), np.minimum(a, b))
        while True:
            up = parent[parent]
            if np.array_equal(up, parent):
                break
            parent[:] = up


def _join_cells(cell, quarter, turned, budget):
    """Star links (turned value, smallest linked) of everything that meets in one cell."""
    order = np.lexsort((turned, quarter, cell))
    cell, quarter, turned = cell[order], quarter[order], turned[order]
    same = (cell[1:] == cell[:-1]) & (quarter[1:] == quarter[:-1])
    # A value may stand in a cell twice, once per tile; one is enough.
    once = np.concatenate(([True], ~(same & (turned[1:] == turned[:-1]))))
    cell, quarter, turned = cell[once], quarter[once], turned[once]
    same = (cell[1:] == cell[:-1]) & (quarter[1:] == quarter[:-1])
    starts = np.concatenate(([0], np.flatnonzero(~same) + 1))
    ends = np.concatenate((starts[1:], [len(cell)]))
    parent = np.arange(len(cell))
    for i, j in trie_pairs(turned, starts, ends, 64, budget):
        _unite(parent, i, j)
    linked = np.flatnonzero(parent != np.arange(len(cell)))
    return quarter[linked], turned[linked], turned[parent[linked]]


def _turn(values: np.ndarray, by: np.ndarray) -> np.ndarray:
    """Rotate 64-bit values left by a multiple of 16 bits below 64."""
    by = by.astype(np.uint64)
    back = (np.uint64(64) - by) % np.uint64(64)
    return np.where(by == 0, values, (values << by) | (values >> back))


# ---------------------------------------------------------------- the join across tasks


def near_links(prints: DataFrame, budget: int = MAX_BITS, tile: int = TILE) -> DataFrame:
    """Links (u, v) that connect all values of column ``fp`` at ``budget`` or fewer bits.

    The values must be distinct. The links are not all pairs: two values are connected by
    them, directly or through others, exactly if they are by pairs within the budget.
    """
    quarters = budget + 1
    if quarters != 4:
        raise ValueError("the four quarters of a fingerprint allow for three differing bits")
    spark = prints.sparkSession
    size = prints.count()
    fp = F.col("fp")
    turned = [fp] + [
        F.shiftleft(fp, 16 * q).bitwiseOR(F.shiftrightunsigned(fp, 64 - 16 * q)) for q in (1, 2, 3)
    ]
    rows = prints.select(
        F.explode(
            F.array(*[F.struct(F.lit(q).alias("q"), t.alias("turned")) for q, t in enumerate(turned)])
        ).alias("x")
    ).select("x.q", "x.turned", F.shiftrightunsigned("x.turned", 48).alias("head"))
    hot = stored(
        rows.groupBy("q", "head")
        .agg(F.count("*").alias("n"))
        .filter(F.col("n") > tile)
        .select("q", "head", "n", F.ceil(F.col("n") / tile).alias("tiles")),
        "hot-subtrees",
    )
    # A row of a cut subtree stands in a cell for each of the other tiles.
    repeats = hot.agg(F.sum(F.col("n") * (F.col("tiles") - 1))).first()[0] or 0
    hot = checked_broadcast(hot.drop("n"))
    tiles = F.coalesce("tiles", F.lit(1).cast("long"))
    own = F.pmod(F.xxhash64("turned"), F.col("tiles"))
    dealt = (
        rows.join(hot, ["q", "head"], "left")
        .withColumn("tiles", tiles)
        .withColumn("own", own)
        .withColumn(
            "other",
            F.explode(
                F.when(F.col("tiles") == 1, F.array(F.col("own"))).otherwise(
                    # A tile alone is covered by its meetings with the others.
                    F.filter(
                        F.sequence(F.lit(0).cast("long"), F.col("tiles") - 1),
                        lambda t: t != F.col("own"),
                    )
                )
            ),
        )
        .select(
            F.xxhash64("q", "head", F.least("own", "other"), F.greatest("own", "other")).alias("cell"),
            "q",
            "turned",
        )
    )
    wanted = partitions_for(4 * size + repeats, ROWS_PER_TASK, spark)

    def run(batches):
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        whole = pa.Table.from_batches(held)
        quarter = whole.column("q").to_numpy()
        value = whole.column("turned").to_numpy().view(np.uint64)
        q, a, b = _join_cells(whole.column("cell").to_numpy(), quarter, value, budget)
        back = (64 - 16 * q) % 64
        yield pa.RecordBatch.from_arrays(
            [pa.array(_turn(x, back).view(np.int64)) for x in (a, b)], ["u", "v"]
        )

    return dealt.repartition(wanted, "cell").mapInArrow(run, "u long, v long")


def classes(prints: DataFrame) -> DataFrame:
    """(fp, root, component_id, has_near) per distinct fingerprint of ``prints`` (doc_id, fp).

    root is one fingerprint of the component, the same for all of them; component_id the
    smallest doc_id of all its documents, null if none has one.
    """
    first = stored(prints.groupBy("fp").agg(F.min("doc_id").alias("least_id")), "fingerprints")
    roots = components(near_links(first.select("fp")))
    in_group = roots.select(F.col("node").alias("fp"), "root").unionByName(
        roots.select(F.col("root").alias("fp"), "root").distinct()
    )
    linked = first.join(in_group, "fp")
    least = linked.groupBy("root").agg(F.min("least_id").alias("group_id"))
    named = linked.join(least, "root").select("fp", "root", "group_id")
    has_near = F.col("root").isNotNull()
    return first.join(named, "fp", "left").select(
        "fp",
        F.coalesce("root", "fp").alias("root"),
        F.when(has_near, F.col("group_id")).otherwise(F.col("least_id")).alias("component_id"),
        has_near.alias("has_near"),
    )


def near_duplicates(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, fingerprint (hex), component_id, has_near.

    Null and wordless texts have fingerprint zero and are linked like any others. Repeated
    rows come out as often as they go in. has_near: another fingerprint is within reach.
    A row without doc_id belongs to a component but never names it. No rows: no rows.
    """
    prints = stored(fingerprints(docs, ["doc_id"]), "prints")
    return prints.join(classes(prints), "fp").select(
        "doc_id",
        F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
        "component_id",
        "has_near",
    )


def keep_one_of_each(docs: DataFrame) -> DataFrame:
    """The documents with one of each component left: the one with the smallest doc_id.

    Components are those of ``near_duplicates``. Where a component has no doc_id at all,
    or several rows share the smallest one, the row with the smallest md5 of its text
    stays, and one row of fully repeated ones. Columns and types as in ``docs``.
    """
    key, mark = fresh(docs, "doc_key", "text_mark")
    keyed = docs.withColumns(
        {
            key: F.coalesce(F.col("doc_id").cast("string"), F.lit("")),
            mark: F.coalesce(F.md5(F.col("text").cast("string")), F.lit("")),
        }
    )
    prints = stored(fingerprints(keyed, ["doc_id", key, mark]), "prints")
    placed = prints.join(classes(prints.select("doc_id", "fp")), "fp")
    chosen = (
        placed.filter(F.col("doc_id").eqNullSafe(F.col("component_id")))
        .groupBy("root")
        .agg(F.min(F.struct(col(key), col(mark))).alias("least"))
        .select("least.*")
    )
    # Rows of one key stand together after the join, so the last step moves nothing.
    kept = keyed.join(chosen, [key, mark], "left_semi").dropDuplicates([key, mark])
    return kept.select(*[col(c) for c in docs.columns])
