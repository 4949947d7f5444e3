"""Exact threshold matching of unit vectors inside a category.

For every probe vector: which anchors with cosine >= t, from another source, come
first in time? The pair list is never written. A tile of probes meets a tile of
anchors in one task as a matrix product and only the first few hits per probe leave
it, so a cluster of n near copies yields a multiple of n rows, not n squared. When all
nodes are compared with each other, a pair of tiles meets once for both directions.

Spark decides which tiles meet:

* Anchors live in one cell each, that of the nearest of a few pivot vectors. A probe
  visits only cells that can hold a match. For unit vectors cos >= t means a distance
  of at most r = sqrt(2 - 2t); an anchor in cell c is on c's side of the plane between
  pivot c and the probe's own pivot h, so a probe with (x.h - x.c) / |h - c| > r cannot
  match there. Nothing else is ruled out, so the result is exact; on unclustered
  vectors every cell is visited and the work is that of a blocked nested loop.
* A cell with many anchors or probes (a third of all rows, say) is cut into tiles of
  bounded size; each probe tile meets each anchor tile of its cell once.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from presswork.operators.joins import is_small, top_per_group
from presswork.session import cut_lineage, stored

TILE_BYTES = 64 * 1024 * 1024
MAX_TILE_ROWS = 32_768
MAX_PIVOTS = 256
_STEP = 2048
_SLACK = 1e-9
# Products are taken in single precision; those this close to the threshold again in double.
_UNSURE = 1e-4
_PAIRS = 4096

HIT_SCHEMA = "category_id int, node_id long, at long, hit_at long, hit_id long, similarity double"
_HIT_ARROW = pa.schema(
    [
        ("category_id", pa.int32()),
        ("node_id", pa.int64()),
        ("at", pa.int64()),
        ("hit_at", pa.int64()),
        ("hit_id", pa.int64()),
        ("similarity", pa.float64()),
    ]
)


def micros(moment: Column) -> Column:
    """Naive timestamp as microseconds, for ordering only."""
    return F.unix_micros(moment.cast("timestamp"))


def unit_rows(vectors: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """List column to a matrix of unit rows; a zero vector stays zero.

    Vectors of different length, and missing vectors or elements, are an error: they would
    silently shift every row behind them.
    """
    if isinstance(vectors, pa.ChunkedArray):
        vectors = vectors.combine_chunks()
    values = vectors.flatten()
    lengths = vectors.value_lengths().to_numpy(zero_copy_only=False)
    if vectors.null_count or values.null_count or len(np.unique(lengths)) > 1:
        raise ValueError("vectors must have one length and no missing elements")
    matrix = values.to_numpy(zero_copy_only=False).astype(np.float64)
    matrix = matrix.reshape(len(vectors), int(lengths[0]) if len(lengths) else 0)
    norms = np.linalg.norm(matrix, axis=1, keepdims=True)
    return np.divide(matrix, norms, out=np.zeros_like(matrix), where=norms > 0)


def pair_dots(a: np.ndarray, b: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Dot products of rows ``a[i]`` and ``b[j]`` in double, a few thousand at a time."""
    out = np.empty(len(i))
    for at in range(0, len(i), _PAIRS):
        part = slice(at, at + _PAIRS)
        out[part] = np.einsum("ij,ij->i", a[i[part]], b[j[part]])
    return out


def _add_cells(nodes: DataFrame, pivots: np.ndarray, radius: float) -> DataFrame:
    """Add ``home``, the nearest pivot, and ``cells``, all cells worth a visit."""
    if len(pivots) <= 1:
        return nodes.withColumns({"home": F.lit(0), "cells": F.array(F.lit(0))})
    gaps = np.linalg.norm(pivots[:, None, :] - pivots[None, :, :], axis=2)

    def assign(batches):
        for batch in batches:
            if batch.num_rows == 0:
                continue
            sims = unit_rows(batch.column("vec")) @ pivots.T
            home = sims.argmax(axis=1)
            behind = sims[np.arange(len(home)), home][:, None] - sims
            cells = [
                np.flatnonzero(b <= radius * gaps[h] + _SLACK).tolist()
                for b, h in zip(behind, home)
            ]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(home, pa.int32()), pa.array(cells, pa.list_(pa.int32()))],
                [*batch.schema.names, "home", "cells"],
            )

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in nodes.schema.fields)
    return nodes.mapInArrow(assign, f"{fields}, home int, cells array<int>")


def place(nodes: DataFrame, threshold: float) -> DataFrame:
    """Decide once where every node meets others; the result is stored.

    Adds ``anchor`` (cell, tile, anchor_tiles, probe_tiles, guest_tiles), the node's place
    as an anchor, and ``visits``, an array of (cell, tile, guest_tile, anchor_tiles), its
    places as a probe. Guests of a cell are its probes from cells with lower numbers.
    ``nodes`` (node_id, category_id, source_id, at in microseconds, vec) should be a
    stored table: it is read four times.
    """
    if not 0 < threshold <= 1:
        raise ValueError("threshold must be in (0, 1]")
    size, dim, least = nodes.agg(F.count("*"), F.max(F.size("vec")), F.min(F.size("vec"))).first()
    if dim != least:
        raise ValueError("vectors must have one length")
    most_rows = max(1, min(MAX_TILE_ROWS, TILE_BYTES // (4 * max(dim or 1, 1))))
    n_pivots = min(MAX_PIVOTS, size // most_rows + 1)
    # Smaller tiles than memory asks for, if that gives every core a few tile pairs.
    cores = nodes.sparkSession.sparkContext.defaultParallelism
    rows = min(most_rows, max(_STEP // 2, math.ceil(size / math.sqrt(4 * cores))))
    pivots = np.zeros((1, dim or 1))
    if n_pivots > 1:
        # A bounded number of vectors, picked by hash so that the choice repeats.
        picked = (
            nodes.select("vec").orderBy(F.xxhash64("vec")).limit(n_pivots).toArrow().column(0)
        )
        pivots = np.unique(unit_rows(picked), axis=0)
    celled = _add_cells(nodes, pivots, math.sqrt(2 - 2 * threshold))

    as_anchor = F.array(
        F.struct(F.col("home").alias("cell"), F.lit(1).alias("anchor"), F.lit(0).alias("guest"))
    )
    as_probe = F.transform(
        "cells",
        lambda c: F.struct(
            c.alias("cell"), F.lit(0).alias("anchor"), (c > F.col("home")).cast("int").alias("guest")
        ),
    )
    counts = (
        celled.select("category_id", F.explode(F.concat(as_anchor, as_probe)).alias("use"))
        .groupBy("category_id", "use.cell")
        .agg(
            F.ceil(F.sum("use.anchor") / rows).cast("int").alias("anchor_tiles"),
            F.ceil(F.sum(1 - F.col("use.anchor")) / rows).cast("int").alias("probe_tiles"),
            F.ceil(F.sum("use.guest") / rows).cast("int").alias("guest_tiles"),
        )
    )
    counts = cut_lineage(counts.filter("anchor_tiles > 0"))
    tiles = counts.groupBy("category_id").agg(  # at most MAX_PIVOTS entries per category
        F.map_from_entries(
            F.collect_list(
                F.struct("cell", F.struct("anchor_tiles", "probe_tiles", "guest_tiles"))
            )
        ).alias("tiles")
    )
    if is_small(counts):
        tiles = F.broadcast(tiles)

    def tile(n_tiles):
        return F.pmod(F.xxhash64("node_id"), n_tiles).cast("int")

    def at(cell):
        return F.element_at("tiles", cell)

    open_cells = F.filter("cells", lambda c: F.map_contains_key("tiles", c))
    visit = F.transform(
        open_cells,
        lambda c: F.struct(
            c.alias("cell"),
            tile(at(c)["probe_tiles"]).alias("tile"),
            F.when(c > F.col("home"), tile(at(c)["guest_tiles"])).alias("guest_tile"),
            at(c)["anchor_tiles"].alias("anchor_tiles"),
        ),
    )
    home = at(F.col("home"))
    anchor = F.struct(
        F.col("home").alias("cell"),
        tile(home["anchor_tiles"]).alias("tile"),
        *[home[c].alias(c) for c in ("anchor_tiles", "probe_tiles", "guest_tiles")],
    )
    placed = celled.join(tiles, "category_id").withColumns({"anchor": anchor, "visits": visit})
    return stored(placed.drop("home", "cells", "tiles"), "placed-nodes")


_PAYLOAD = ["node_id", "source_id", "at", "vec"]
_KEY = ["category_id", "cell", "own", "anchor_tile", "probe_tile"]


def _from(start: Column | int, n: Column) -> Column:
    """``start`` to n - 1, nothing if there are none."""
    first = F.lit(start) if isinstance(start, int) else start
    some = F.sequence(first, F.greatest(n - 1, first))
    return F.explode(F.when(n > first, some).otherwise(F.array().cast("array<int>")))


def _side(rows: DataFrame, cell: Column, own: bool, anchor_tile: Column, probe_tile: Column):
    return rows.select(
        "category_id",
        cell.alias("cell"),
        F.lit(own).alias("own"),
        anchor_tile.alias("anchor_tile"),
        probe_tile.alias("probe_tile"),
        *_PAYLOAD,
    )


def _meet(left: DataFrame, right: DataFrame, match) -> DataFrame:
    # Both sides may come from one table; new names keep their columns apart.
    right = right.toDF(*[f"a_{c}" for c in right.columns])
    return (
        left.groupBy(*_KEY)
        .cogroup(right.groupBy(*[f"a_{c}" for c in _KEY]))
        .applyInArrow(match, HIT_SCHEMA)
    )


class _Side:
    """Nodes of one tile in the order of time, with the first hits found so far."""

    def __init__(self, table: pa.Table, limit: int):
        table = table.sort_by([("at", "ascending"), ("node_id", "ascending")])
        self.unit = unit_rows(table.column("vec"))
        self.single = self.unit.astype(np.float32)
        self.id, self.at, self.source = (
            table.column(c).to_numpy() for c in ("node_id", "at", "source_id")
        )
        self.category = table.column("category_id")[0].as_py()
        self.limit = limit
        self.have = np.zeros(len(self.id), np.int64)
        self.found: list[tuple[np.ndarray, np.ndarray]] = []

    def preceding(self, other: _Side) -> np.ndarray:
        """How many nodes of ``other`` precede each node."""
        out = np.searchsorted(other.at, self.at, "left")
        for i in np.flatnonzero(np.searchsorted(other.at, self.at, "right") > out):
            tied = slice(out[i], np.searchsorted(other.at, self.at[i], "right"))
            out[i] += np.searchsorted(other.id[tied], self.id[i], "left")
        return out

    def take(self, rows: np.ndarray, hit: np.ndarray, first: int) -> None:
        """Add the hits of ``rows`` in a block of the other side that begins at ``first``,
        up to the limit; blocks come in the order of time."""
        i, j = np.nonzero(hit)
        if not len(i):
            return
        n = np.bincount(i, minlength=len(rows))
        place = np.arange(len(i)) - (np.cumsum(n) - n)[i] + self.have[rows[i]]
        keep = place < self.limit
        self.found.append((rows[i[keep]], first + j[keep]))
        self.have[rows] = np.minimum(self.have[rows] + n, self.limit)

    def hits(self, other: _Side) -> pa.Table:
        if not self.found:
            return _HIT_ARROW.empty_table()
        i, j = (np.concatenate(x) for x in zip(*self.found))
        return pa.table(
            [
                pa.array(np.full(len(i), self.category), pa.int32()),
                self.id[i],
                self.at[i],
                other.at[j],
                other.id[j],
                pair_dots(self.unit, other.unit, i, j),
            ],
            schema=_HIT_ARROW,
        )


def _matcher(threshold: float, only_earlier: bool, limit: int, both_ways: bool):
    """Matrix product of two tiles; the first hits of the left side, or of both."""

    def match(left: pa.Table, right: pa.Table) -> pa.Table:
        if left.num_rows == 0 or right.num_rows == 0:
            return _HIT_ARROW.empty_table()
        right = right.rename_columns([c.removeprefix("a_") for c in right.column_names])
        own, i, j = (left.column(c)[0].as_py() for c in ("own", "anchor_tile", "probe_tile"))
        # A tile that meets itself has every pair twice in one product.
        mirrored = both_ways and not (own and i == j)
        p, a = _Side(left, limit), _Side(right, limit)
        before = p.preceding(a)
        for at in range(0, len(a.id), _STEP):
            cols = np.arange(at, min(at + _STEP, len(a.id)))
            for top in range(0, len(p.id), _STEP):
                rows = np.arange(top, min(top + _STEP, len(p.id)))
                rows_open = p.have[rows] < limit
                cols_open = mirrored & (a.have[cols] < limit)
                if not cols_open.any():
                    rows = rows[rows_open]
                    rows_open = np.ones(len(rows), bool)
                if only_earlier and not cols_open.any():
                    rows = rows[before[rows] > at]
                    rows_open = rows_open[: len(rows)]
                if not len(rows):
                    continue
                sims = p.single[rows] @ a.single[cols].T
                hit = (sims >= threshold - _UNSURE) & (p.source[rows, None] != a.source[None, cols])
                x, y = np.nonzero(hit & (sims < threshold + _UNSURE))
                hit[x, y] = pair_dots(p.unit, a.unit, rows[x], cols[y]) >= threshold
                earlier = cols[None, :] < before[rows, None] if only_earlier else True
                p.take(rows[rows_open], (hit & earlier)[rows_open], at)
                if cols_open.any():
                    later = cols[None, :] >= before[rows, None] if only_earlier else True
                    a.take(cols[cols_open], (hit & later).T[cols_open], int(rows[0]))
        return pa.concat_tables([p.hits(a), a.hits(p)]).combine_chunks()

    return match


def first_hits(
    probes: DataFrame, anchors: DataFrame, threshold: float, only_earlier: bool, limit: int = 1
) -> DataFrame:
    """Per probe the first ``limit`` matching anchors in time: (category_id, node_id, at,
    hit_at, hit_id, similarity).

    Both sides are subsets of one ``place``d set of nodes. ``only_earlier`` asks for
    anchors that precede the probe in (at, node_id) order.
    """
    visit, anchor = F.col("v.cell"), F.col("anchor.cell")
    left = _side(
        probes.select("*", F.explode("visits").alias("v")).select(
            "*", _from(0, F.col("v.anchor_tiles")).alias("k")
        ),
        *(visit, False, F.col("k"), F.col("v.tile")),
    )
    right = _side(
        anchors.select("*", _from(0, F.col("anchor.probe_tiles")).alias("k")),
        *(anchor, False, F.col("anchor.tile"), F.col("k")),
    )
    hits = _meet(left, right, _matcher(threshold, only_earlier, limit, False))
    return _first(hits, limit)


def first_neighbours(nodes: DataFrame, threshold: float, only_earlier: bool, limit: int = 1):
    """``first_hits`` of all placed nodes among themselves, with each pair of tiles once.

    Tiles of one cell meet as pairs (i, j) with i <= j; a node goes to other cells only as
    a guest of those with higher numbers, and hits count for both.
    """
    home, tile = F.col("anchor.cell"), F.col("anchor.tile")
    lower = _side(
        nodes.select("*", _from(tile, F.col("anchor.anchor_tiles")).alias("k")),
        *(home, True, F.col("k"), tile),
    )
    upper = _side(nodes.select("*", _from(0, tile + 1).alias("k")), *(home, True, tile, F.col("k")))
    guests = _side(
        nodes.select("*", F.explode("visits").alias("v"))
        .filter("v.guest_tile IS NOT NULL")
        .select("*", _from(0, F.col("v.anchor_tiles")).alias("k")),
        *(F.col("v.cell"), False, F.col("k"), F.col("v.guest_tile")),
    )
    hosts = _side(
        nodes.select("*", _from(0, F.col("anchor.guest_tiles")).alias("k")),
        *(home, False, tile, F.col("k")),
    )
    match = _matcher(threshold, only_earlier, limit, True)
    return _first(_meet(lower.unionByName(guests), upper.unionByName(hosts), match), limit)


def _first(hits: DataFrame, limit: int) -> DataFrame:
    """The first hits over all tiles of a node."""
    if limit == 1:
        best = F.min(F.struct("hit_at", "hit_id", "similarity"))
        found = hits.groupBy("category_id", "node_id", "at").agg(best.alias("b"))
        return found.select("category_id", "node_id", "at", "b.*")
    return top_per_group(hits, ["node_id"], [F.asc("hit_at"), F.asc("hit_id")], limit, "_rank").drop("_rank")
