"""Approximate nearest neighbours by a forest of hash prefixes.

Every tree gives a vector a long hash string, the signs of 64 random projections. A tree is
the sorted array of these strings; the vectors that share the first x bits with a query are
a range of it. A query descends in every tree to its longest match and then ascends in all
trees together, one bit at a time, until the ranges hold enough candidates; these are
compared exactly. How many are enough is measured, not set: a bounded sample of queries is
answered by brute force, and the least number with which the ascent would have found
``TARGET_RECALL`` of their true neighbours is used for all.

Largest inner products become smallest angles by one more component that gives all vectors
the norm of the longest; queries have a zero there.

How Spark deals it out: each sorted array is cut into blocks by the first bits of the hash
string, and a query goes to the block of its own prefix in each tree, or to all blocks below
the prefix to which it has to ascend. Blocks with too many vectors, and blocks that too many
queries visit, are cut into tiles. Equal vectors are one entry that carries its smallest ids
(one more than is asked for, so every query still has its full list without itself).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from presswork.llm.common import col
from presswork.session import stored

TREES = 12
BITS = 64
SAMPLE = 64
TARGET_RECALL = 0.95
BLOCK_ROWS = 16_384
MAX_BLOCK_BITS = 24
SEED = 20_240_501
_SPARE = 8
_ROWS_AT_ONCE = 8_192


def planes(dim: int, trees: int) -> np.ndarray:
    """Random projections of all trees, for vectors of ``dim`` components and the added one."""
    return np.random.default_rng(SEED).standard_normal((dim + 1, trees * BITS))


def hash_strings(vectors: np.ndarray, extra: np.ndarray, projections: np.ndarray) -> np.ndarray:
    """Hash strings (rows x trees, uint64); the first projection is the highest bit."""
    out = np.empty((len(vectors), projections.shape[1] // BITS), np.uint64)
    for at in range(0, len(vectors), _ROWS_AT_ONCE):
        part = slice(at, at + _ROWS_AT_ONCE)
        full = np.concatenate([vectors[part], extra[part, None]], axis=1)
        bits = (full @ projections > 0).reshape(len(full), -1, BITS)
        out[part] = np.packbits(bits, axis=2).view(">u8")[:, :, 0]
    return out


def _matrix(column, dim: int) -> np.ndarray:
    """A list column to rows of doubles."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    if len(flat) != len(column) * dim:
        raise ValueError("vectors of different length")
    return flat.reshape(-1, dim)


def _common_bits(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Length of the common prefix of hash strings."""
    apart = a ^ b
    # Smear the highest set bit down; what is left above it is the common prefix.
    for s in (1, 2, 4, 8, 16, 32):
        apart = apart | (apart >> np.uint64(s))
    return BITS - np.bitwise_count(apart).astype(np.int64)


def _fixed_dots(rows: np.ndarray, query: np.ndarray) -> np.ndarray:
    """Inner products summed in an order that does not depend on the number of rows."""
    return np.ascontiguousarray(rows * query).sum(axis=1)


class Forest:
    """Distinct vectors of a table with the measured number of candidates."""

    def __init__(
        self,
        vectors: DataFrame,
        id_column: str,
        vector_column: str,
        k: int,
        trees: int = TREES,
        block_rows: int = BLOCK_ROWS,
    ):
        """Null, zero, non-finite and part-null vectors are left out, and vectors that do not
        have the most frequent length. Repeated (id, vector) rows count once."""
        self.k, self.trees, self.block_rows = k, trees, block_rows
        vec = col(vector_column).cast("array<double>")
        finite = F.forall("vec", lambda x: x.isNotNull() & (F.abs(x) < float("inf")))
        some = F.exists("vec", lambda x: x != 0)
        rows = vectors.select(col(id_column).cast("long").alias("id"), vec.alias("vec")).filter(
            "id is not null and vec is not null"
        )
        rows = rows.filter(F.coalesce(finite & some, F.lit(False)))
        # Lengths are few; the most frequent one wins, the larger among equals.
        lengths = rows.groupBy(F.size("vec").alias("dim")).count()
        first = lengths.orderBy(F.desc("count"), F.desc("dim")).limit(1).collect()
        self.dim = first[0]["dim"] if first else 0
        rows = rows.filter(F.size("vec") == self.dim)
        rows = rows.withColumn("key", F.md5(F.to_json("vec"))).dropDuplicates(["id", "key"])
        self.rows = stored(rows, "vectors")
        rank = F.row_number().over(W.partitionBy("key").orderBy("id"))
        entries = (
            self.rows.withColumn("rank", rank)
            .filter(F.col("rank") <= k + 1)
            .groupBy("key")
            .agg(F.sort_array(F.collect_list("id")).alias("ids"), F.first("vec").alias("vec"))
        )
        self.entries = stored(entries, "entries")
        norm = F.aggregate("vec", F.lit(0.0), lambda s, x: s + x * x)
        self.size, top = self.entries.agg(F.count("*"), F.max(norm)).first()
        self.top = top or 0.0
        bits = int(max(0, np.floor(np.log2(max(self.size, 1) / block_rows))))
        self.block_bits = min(bits, MAX_BLOCK_BITS)

    # ------------------------------------------------------------------ measuring

    def measure(self, queries: DataFrame, target: float, sample: int = SAMPLE) -> int:
        """The least number of candidates that reaches ``target`` recall on a sample.

        ``sample`` distinct query vectors (the smallest keys, which are digests) are
        compared with every entry; tasks send back counts per depth and their best rows.
        """
        picked = queries.groupBy("key").agg(F.min("id").alias("id"), F.first("vec").alias("vec"))
        asked = picked.orderBy("key").limit(sample).collect()
        if not asked:
            return 1
        dim, k, top, trees = self.dim, self.k, self.top, self.trees
        vecs = np.array([r["vec"] for r in asked])
        own = [r["id"] for r in asked]

        def run(batches):
            project = planes(dim, trees)
            q_hash = hash_strings(vecs, np.zeros(len(vecs)), project)
            seen = np.zeros((len(vecs), BITS + 1), np.int64)
            for batch in batches:
                x = _matrix(batch.column("vec"), dim)
                if not len(x):
                    continue
                ids = batch.column("ids").to_pylist()
                h = hash_strings(x, np.sqrt(np.maximum(0, top - (x * x).sum(axis=1))), project)
                scores = x @ vecs.T
                out = []
                for i in range(len(vecs)):
                    depth = _common_bits(h, q_hash[i])
                    seen[i] += np.bincount(depth.ravel(), minlength=BITS + 1)
                    reach = depth.max(axis=1)
                    near = np.argsort(-scores[:, i], kind="stable")[: k + 1]
                    for j in near:
                        out += [(i, int(reach[j]), float(scores[j, i]), m) for m in ids[j]]
                yield _sample_batch(out, "hit")
            yield _sample_batch(
                [(i, d, float(seen[i, d]), 0) for i in range(len(vecs)) for d in range(BITS + 1)],
                "count",
            )

        found = self.entries.select("ids", "vec").mapInArrow(
            run, "kind string, q int, depth int, value double, id long"
        )
        found = stored(found, "forest-sample")
        counts = found.filter("kind = 'count'").groupBy("q", "depth").agg(F.sum("value").alias("n"))
        within = np.zeros((len(vecs), BITS + 1))
        for r in counts.collect():  # sample x 65 numbers
            within[r["q"], r["depth"]] = r["n"]
        within = within[:, ::-1].cumsum(axis=1)[:, ::-1]  # with that many common bits or more
        rank = F.row_number().over(W.partitionBy("q").orderBy(F.desc("value"), "id"))
        hits = found.filter("kind = 'hit'").withColumn("rank", rank).filter(F.col("rank") <= k + 1)
        depths: dict[int, list[int]] = {}
        for r in hits.orderBy("q", "rank").collect():  # sample x (k + 1) rows
            mine = depths.setdefault(r["q"], [])
            if r["id"] != own[r["q"]] and len(mine) < k:
                mine.append(r["depth"])
        wanted = 1.0
        while wanted < self.trees * max(self.size, 1):
            shares = []
            for q, reach in depths.items():
                enough = np.flatnonzero(within[q] >= wanted)
                level = int(enough[-1]) if len(enough) else 0
                shares += [d >= level for d in reach]
            if not shares or np.mean(shares) >= target:
                break
            wanted *= 1.25
        return int(np.ceil(wanted))

    # ------------------------------------------------------------------ searching

    def _hashed(self, rows: DataFrame, keep: str, with_vec: bool, is_query: bool) -> DataFrame:
        """A row per tree: keep, tree, hash, block (and the vector)."""
        dim, top, trees, bits = self.dim, self.top, self.trees, self.block_bits

        def run(batches):
            project = planes(dim, trees)
            for batch in batches:
                x = _matrix(batch.column("vec"), dim)
                if not len(x):
                    continue
                extra = np.sqrt(np.maximum(0, top - (x * x).sum(axis=1)))
                h = hash_strings(x, np.zeros(len(x)) if is_query else extra, project)
                for t in range(trees):
                    block = (h[:, t] >> np.uint64(BITS - bits)) if bits else np.zeros(len(x))
                    made = [
                        batch.column(keep),
                        pa.array(np.full(len(x), t), pa.int32()),
                        pa.array(h[:, t].view(np.int64)),
                        pa.array(block.astype(np.int64)),
                    ]
                    names = [keep, "tree", "hash", "block"]
                    if with_vec:
                        made, names = [*made, batch.column("vec")], [*names, "vec"]
                    yield pa.RecordBatch.from_arrays(made, names)

        kind = rows.schema[keep].dataType.simpleString()
        extra = ", vec array<double>" if with_vec else ""
        return rows.select(keep, "vec").mapInArrow(
            run, f"{keep} {kind}, tree int, hash long, block long{extra}"
        )

    def _levels(self, asked: DataFrame, placed: DataFrame, blocks: DataFrame, enough: int):
        """(key, level): the common bits to which each query ascends."""
        bits = self.block_bits

        def count(left: pa.Table, right: pa.Table) -> pa.Table:
            have = np.sort(left.column("hash").to_numpy().view(np.uint64))
            query = right.column("q_hash").to_numpy().view(np.uint64)
            n = []
            for level in range(bits, BITS + 1):
                low, high = _prefix_range(query, level)
                n.append(np.searchsorted(have, high, "right") - np.searchsorted(have, low, "left"))
            flat = np.array(n).T.ravel()
            width = BITS + 1 - bits
            lists = pa.ListArray.from_arrays(np.arange(0, len(flat) + 1, width, dtype=np.int32), flat)
            return pa.table({"key": right.column("key"), "n": lists})

        dealt = self._dealt_entries(placed, blocks).select("tree", "block", "tile", "q_tile", "hash")
        asks = self._dealt_queries(asked, blocks).select(
            "tree", "block", "tile", "q_tile", "key", F.col("hash").alias("q_hash")
        )
        place = ["tree", "block", "tile", "q_tile"]
        counted = (
            dealt.groupBy(*place).cogroup(asks.groupBy(*place)).applyInArrow(count, "key string, n array<long>")
        )
        sums = [
            F.sum(F.col("n")[i]).alias(f"n{i + bits}") for i in range(BITS + 1 - bits)
        ]
        below = counted.groupBy("key").agg(*sums)
        level = F.lit(-1)
        for x in range(bits, BITS + 1):
            level = F.when(F.col(f"n{x}") >= enough, F.lit(x)).otherwise(level)
        known = stored(
            asked.select("key").distinct().join(below, "key", "left").select(
                "key", F.coalesce(level, F.lit(-1)).alias("level")
            ),
            "forest-levels",
        )
        if not bits or known.filter("level < 0").limit(1).count() == 0:
            return known.select("key", F.greatest("level", F.lit(0)).alias("level"))
        # Ascend above the blocks, by the number of entries under each shorter prefix.
        upper = F.explode(F.sequence(F.lit(0), F.lit(bits - 1)))
        prefix = F.expr(f"shiftright(block, {bits} - up)")
        sizes = (
            blocks.select("tree", "block", "n", upper.alias("up"))
            .groupBy("tree", "up", prefix.alias("prefix"))
            .agg(F.sum("n").alias("n"))
        )
        open_ = asked.join(known.filter("level < 0"), "key", "left_semi").select("key", "tree", "block")
        reach = (
            open_.withColumn("up", upper)
            .withColumn("prefix", prefix)
            .join(sizes, ["tree", "up", "prefix"])
            .groupBy("key", "up")
            .agg(F.sum("n").alias("n"))
            .groupBy("key")
            .agg(F.max(F.when(F.col("n") >= enough, F.col("up")).otherwise(0)).alias("up"))
        )
        return known.join(reach, "key", "left").select(
            "key",
            F.when(F.col("level") >= 0, F.col("level")).otherwise(F.coalesce("up", F.lit(0))).alias("level"),
        )

    def _dealt_entries(self, placed: DataFrame, blocks: DataFrame) -> DataFrame:
        """Entries with the tile they lie in, once for every tile of queries."""
        tile = F.pmod(F.xxhash64("hash", "ids"), F.col("tiles"))
        return placed.join(blocks, ["tree", "block"]).withColumns(
            {"tile": tile, "q_tile": F.explode(F.sequence(F.lit(0).cast("long"), F.col("q_tiles") - 1))}
        )

    def _dealt_queries(self, visits: DataFrame, blocks: DataFrame) -> DataFrame:
        """Visits with their tile of queries, once for every tile of entries."""
        q_tile = F.pmod(F.xxhash64("key"), F.col("q_tiles"))
        return visits.join(blocks, ["tree", "block"]).withColumns(
            {"q_tile": q_tile, "tile": F.explode(F.sequence(F.lit(0).cast("long"), F.col("tiles") - 1))}
        )

    def _blocks(self, sizes: DataFrame, visits: DataFrame) -> DataFrame:
        """(tree, block, n, tiles, q_tiles) of every block with entries."""
        count = visits.groupBy("tree", "block").agg(F.count("*").alias("visits"))
        tiles = F.ceil(F.col("n") / (4 * self.block_rows))
        q_tiles = F.greatest(F.ceil(F.coalesce("visits", F.lit(0)) / self.block_rows), F.lit(1))
        return stored(
            sizes.join(count, ["tree", "block"], "left").select(
                "tree", "block", "n", tiles.alias("tiles"), q_tiles.alias("q_tiles")
            ),
            "forest-blocks",
        )

    def search(self, queries: DataFrame, enough: int) -> DataFrame:
        """(key, id, score): up to k + 1 best entries for each distinct query vector."""
        k, dim, bits = self.k, self.dim, self.block_bits
        distinct = stored(
            queries.groupBy("key").agg(F.first("vec").alias("vec")), "query-vectors"
        )
        asked = stored(self._hashed(distinct, "key", False, True), "query-hashes")
        placed = self._hashed(self.entries, "ids", False, False)
        sizes = stored(placed.groupBy("tree", "block").agg(F.count("*").alias("n")), "block-sizes")
        level = self._levels(asked, placed, self._blocks(sizes, asked), enough)
        visits = asked.join(level, "key")
        if bits:
            free = f"{bits} - least(level, {bits})"
            low = F.expr(f"shiftleft(shiftright(block, {free}), {free})")
            width = F.expr(f"shiftleft(1L, {free})")
            visits = visits.withColumn("block", F.explode(F.sequence(low, low + width - 1)))
        visits = stored(
            visits.join(distinct, "key").select("key", "tree", "hash", "level", "block", "vec"),
            "forest-visits",
        )
        blocks = self._blocks(sizes, visits)
        with_vecs = self._hashed(self.entries, "ids", True, False)

        def score(left: pa.Table, right: pa.Table) -> pa.Table:
            hashes = left.column("hash").to_numpy().view(np.uint64)
            order = np.argsort(hashes, kind="stable")
            hashes = hashes[order]
            x = _matrix(left.column("vec"), dim)[order]
            ids = left.column("ids").take(pa.array(order)).to_pylist()
            q = _matrix(right.column("q_vec"), dim)
            query = right.column("q_hash").to_numpy().view(np.uint64)
            levels = np.maximum(right.column("level").to_numpy(), bits)
            low, high = np.empty(len(q), np.int64), np.empty(len(q), np.int64)
            for level in np.unique(levels):
                at = levels == level
                if level == bits:  # the whole block; it may be one above the query's own
                    low[at], high[at] = 0, len(hashes)
                    continue
                first, last = _prefix_range(query[at], int(level))
                low[at] = np.searchsorted(hashes, first, "left")
                high[at] = np.searchsorted(hashes, last, "right")
            keys = right.column("key").to_pylist()
            out = []
            ranges, which = np.unique(np.stack([low, high], axis=1), axis=0, return_inverse=True)
            for r, (lo, hi) in enumerate(ranges):
                if lo == hi:
                    continue
                mine = np.flatnonzero(which.ravel() == r)
                for at in range(0, len(mine), 256):
                    some = mine[at : at + 256]
                    dots = q[some] @ x[lo:hi].T
                    keep = min(k + 1 + _SPARE, hi - lo)
                    # All that tie with the last one kept stay in, up to rounding.
                    floor = -np.partition(-dots, keep - 1, axis=1)[:, keep - 1]
                    for i, row, f in zip(some, dots, floor):
                        near = np.flatnonzero(row >= f - 1e-12 * max(1.0, abs(f)))
                        exact = _fixed_dots(x[lo + near], q[i])
                        pairs = [(-s, m) for s, n in zip(exact, near) for m in ids[lo + n]]
                        out += [(keys[i], m, -s) for s, m in sorted(pairs)[: k + 1]]
            return pa.table(
                {
                    "key": pa.array([o[0] for o in out], pa.string()),
                    "id": pa.array([o[1] for o in out], pa.int64()),
                    "score": pa.array([o[2] for o in out], pa.float64()),
                }
            )

        place = ["tree", "block", "tile", "q_tile"]
        entries = self._dealt_entries(with_vecs, blocks).select(*place, "hash", "ids", "vec")
        asks = self._dealt_queries(visits, blocks).select(
            *place, "key", F.col("hash").alias("q_hash"), "level", F.col("vec").alias("q_vec")
        )
        scored = (
            entries.groupBy(*place)
            .cogroup(asks.groupBy(*place))
            .applyInArrow(score, "key string, id long, score double")
        )
        rank = F.row_number().over(W.partitionBy("key").orderBy(F.desc("score"), "id"))
        return (
            scored.groupBy("key", "id", "score").agg(F.lit(1))
            .withColumn("rank", rank)
            .filter(F.col("rank") <= k + 1)
            .select("key", "id", "score")
        )


def _prefix_range(query: np.ndarray, level: int) -> tuple[np.ndarray, np.ndarray]:
    """First and last hash string that share ``level`` bits with each query."""
    if level == 0:
        return np.zeros_like(query), np.full_like(query, np.iinfo(np.uint64).max)
    rest = np.uint64((1 << (BITS - level)) - 1)
    return query & ~rest, query | rest


def _sample_batch(rows: list[tuple], kind: str) -> pa.RecordBatch:
    q, depth, value, ids = zip(*rows) if rows else ((), (), (), ())
    return pa.RecordBatch.from_arrays(
        [
            pa.array([kind] * len(rows), pa.string()),
            pa.array(q, pa.int32()),
            pa.array(depth, pa.int32()),
            pa.array(value, pa.float64()),
            pa.array(ids, pa.int64()),
        ],
        ["kind", "q", "depth", "value", "id"],
    )


def nearest(
    vectors: DataFrame,
    is_query,
    k: int,
    id_column: str = "vec_id",
    vector_column: str = "embedding",
    target: float = TARGET_RECALL,
    trees: int = TREES,
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """(query_id, rank, vec_id, score): the k largest inner products found for each query.

    Queries are the rows of ``vectors`` for which the condition ``is_query`` (on a column
    named id) holds; candidates are all rows but the query's own. Equal scores rank by id.
    Recall is ``target`` on a sample of the queries; everything found has its exact score.
    Unusable vectors take no part; without usable ones the result is empty.
    """
    forest = Forest(vectors, id_column, vector_column, k, trees, block_rows)
    queries = stored(forest.rows.filter(is_query), "queries")
    enough = forest.measure(queries, target)
    found = forest.search(queries, enough)
    pairs = queries.select(F.col("id").alias("query_id"), "key").join(found, "key")
    others = pairs.filter(F.col("id") != F.col("query_id"))
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "id"))
    return (
        others.withColumn("rank", rank)
        .filter(F.col("rank") <= k)
        .select("query_id", F.col("rank").cast("int").alias("rank"), F.col("id").alias("vec_id"), "score")
    )
