"""Best-fit packing into sequences of several permitted lengths.

Longest pieces first, each goes to the open bin with the least room that still holds it.
If there is none, a bin of the least cost per token it can come to hold is opened. At the
end every bin is downsized to the cheapest permitted length that holds its contents. This
is done once for each upper limit on the length of opened bins, and the packing of least
total cost stays, so the permitted lengths are weighed against each other on the contents
at hand.

Spark deals the pieces round-robin to tasks of about ``PIECES_PER_TASK``, each of which
packs its own; pieces are ids and lengths, no text moves. A bin that is not full at the end
of a task is the only loss against packing all pieces together.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from presswork.llm.common import col
from presswork.session import stored

LENGTHS = (512, 1024, 2048, 4096, 8192)
PIECES_PER_TASK = 50_000
FIXED_TOKENS = 64
QUADRATIC = 1 / 32_768


def default_cost(length: int) -> float:
    """Cost of a sequence: its tokens, a share for attention, and a fixed part."""
    return length + QUADRATIC * length * length + FIXED_TOKENS


def _pack_within(sizes: list[int], lengths: list[int], costs: dict[int, float], limit: int):
    """Bin of each piece (sizes falling) if bins up to ``limit`` are opened, and bin fills."""
    bins: list[int] = []
    fills: list[int] = []
    room: list[list[int]] = [[] for _ in range(lengths[-1] + 1)]
    open_rooms = 0  # bit r is set if some bin has room for exactly r more tokens
    rest = sum(sizes)
    for size in sizes:
        fitting = open_rooms >> size
        if fitting:
            left = size + (fitting & -fitting).bit_length() - 1
            at = room[left].pop()
            if not room[left]:
                open_rooms ^= 1 << left
        else:
            allowed = [x for x in lengths if x >= size and x <= limit]
            allowed = allowed or [min(x for x in lengths if x >= size)]
            left = min(allowed, key=lambda x: (costs[x] / min(x, rest), x))
            at = len(fills)
            fills.append(0)
        fills[at] += size
        bins.append(at)
        rest -= size
        left -= size
        if left:
            if not room[left]:
                open_rooms |= 1 << left
            room[left].append(at)
    return bins, fills


def pack_pieces(sizes: list[int], costs: dict[int, float]):
    """(bin per piece, capacity per bin, fill per bin) for piece sizes in falling order."""
    lengths = sorted(costs)
    fit = {}

    def downsized(fill: int) -> int:
        if fill not in fit:
            fit[fill] = min((x for x in lengths if x >= fill), key=lambda x: (costs[x], x))
        return fit[fill]

    best = None
    for limit in lengths:
        bins, fills = _pack_within(sizes, lengths, costs, limit)
        capacity = [downsized(f) for f in fills]
        cost = sum(costs[c] for c in capacity)
        if best is None or cost < best[0]:
            best = cost, bins, capacity, fills
    return best[1:]


_PLAN = T.StructType(
    [
        T.StructField("piece", T.LongType()),
        T.StructField("start", T.LongType()),
        T.StructField("n_tokens", T.LongType()),
        T.StructField("bin_id", T.LongType()),
        T.StructField("bin_start", T.LongType()),
        T.StructField("capacity", T.LongType()),
        T.StructField("fill", T.LongType()),
    ]
)


def pack(
    docs: DataFrame,
    length: str = "n_tokens",
    costs: dict[int, float] | None = None,
    per_task: int = PIECES_PER_TASK,
) -> DataFrame:
    """The packing plan: a row per piece of a document, with its bin and place in it.

    ``docs`` has doc_id and a token count in column ``length``; ``costs`` maps permitted
    lengths to the cost of one bin. A document longer than the longest bin is cut into
    pieces of that length and a rest. Columns: doc_id, piece (from 0), start (token offset
    in the document), n_tokens (of the piece), bin_id, bin_start (offset in the bin),
    capacity and fill of the bin. A document without tokens (null or zero) has one row of
    zero tokens and null bin columns. Repeated rows are packed as often as they occur.
    """
    costs = dict(costs or {x: default_cost(x) for x in LENGTHS})
    if not costs or min(costs) < 1:
        raise ValueError("permitted lengths are positive")
    longest = max(costs)
    total = F.greatest(F.coalesce(col(length).cast("long"), F.lit(0)), F.lit(0))
    whole = docs.select("doc_id", total.alias("total"))
    cut = whole.withColumn(
        "piece",
        F.explode(
            F.sequence(
                F.lit(0).cast("long"), F.greatest(F.ceil(F.col("total") / longest), F.lit(1)) - 1
            )
        ),
    )
    start = F.col("piece") * longest
    pieces = stored(
        cut.select(
            "doc_id",
            "piece",
            start.alias("start"),
            F.least(F.col("total") - start, F.lit(longest)).alias("n_tokens"),
        ),
        "pieces",
    )
    tasks = max(1, -(-pieces.count() // per_task))

    def run(batches):
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        items = pa.Table.from_batches(held)
        order = items.append_column("at", pa.array(np.arange(items.num_rows))).sort_by(
            [("n_tokens", "descending"), ("doc_id", "ascending"), ("piece", "ascending")]
        )
        items = items.take(order.column("at")).combine_chunks()
        sizes = items.column("n_tokens").to_pylist()
        some = sum(1 for s in sizes if s)
        bins, capacity, fills = pack_pieces(sizes[:some], costs) if some else ([], [], [])
        first = TaskContext.get().partitionId() << 32
        used = [0] * len(fills)
        places = []
        for at, size in zip(bins, sizes):
            places.append(used[at])
            used[at] += size
        none = [None] * (len(sizes) - some)
        columns = [
            [first + b for b in bins] + none,
            places + none,
            [capacity[b] for b in bins] + none,
            [fills[b] for b in bins] + none,
        ]
        for name, values in zip(("bin_id", "bin_start", "capacity", "fill"), columns):
            items = items.append_column(name, pa.array(values, pa.int64()))
        yield from items.to_batches()

    schema = T.StructType([pieces.schema["doc_id"], *_PLAN.fields])
    return pieces.repartition(tasks).mapInArrow(run, schema)
