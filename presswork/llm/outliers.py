"""Quality rules: robust multivariate outliers per language and source.

Every text that passes two base rules becomes a vector of transformed statistics. For each
language and source the minimum covariance determinant (MCD) estimate gives a centre and a
covariance from the most concentrated half of its texts, so that junk below about half of
a group cannot pull them towards itself; texts too far from the centre by Mahalanobis
distance go.

The fit covers all rows and no group is gathered anywhere. A concentration step is one
aggregation: distances are counted in fine logarithmic bins, with sums and sums of products
per group and bin, and the bins that hold the nearest half give the next centre and
covariance. Steps start from medians with three covariances (median deviations alone, and
with the correlations of squashed values and of directions) and go on, each for itself,
until the determinant falls no more; the least determinant of a group is its estimate.
Vectors lie on a grid and are summed as whole numbers, so results do not depend on how rows
are dealt out.

A text has three distances: by the estimate of its language and source, of its language, and
of all texts. Their logarithms are averaged with weights that grow smoothly with the texts
behind each estimate (``GROUP_TEXTS``, ``TABLE_TEXTS``), so a large source is judged by itself,
a small one mostly by its language, junk that is the majority of a small group does not
become its norm, and no verdict turns on a group's having one text more. What weight is left
in a tiny table counts as an ordinary distance. A variance floor per statistic keeps constant
statistics from turning small differences into large distances.
"""

from __future__ import annotations

import math
from statistics import NormalDist

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from presswork.llm.common import col, raw_texts
from presswork.llm.text_stats import text_stats
from presswork.operators.joins import join_hot_key
from presswork.session import stored

BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
MORE = ["n_lines", "n_distinct", "n_upper", "n_marks"]
MIN_WORDS = 10
MAX_REPEAT_PERCENT = 20

# An estimate of n texts has weight n / (n + this) against the next wider one, ...
GROUP_TEXTS = 1000
# ... and the one of all texts n / (n + this) against an ordinary distance.
TABLE_TEXTS = 30
GRID = 1024
BINS_PER_OCTAVE = 16
# More steps than this are an error. The determinant falls with every step, so they do end.
MAX_STEPS = 100
# Falls of the logarithm of the determinant that are no more than rounding.
TOLERANCE = 1e-9
# A text of n words counts with n / (n + this) of its squared distance: the statistics of
# short texts scatter widely by chance.
PRIOR_WORDS = 30
TAIL = 1e-9
# Smallest standard deviation that is told apart, in the order of ``_vector``.
FLOORS = [0.05, 0.2, 0.1, 0.1, 0.02, 0.2, 0.2]
DIM = len(FLOORS)


def subset_size(size: int) -> int:
    """Texts of a group that are concentrated on: the size with the highest breakdown point."""
    return min(size, (size + DIM + 1) // 2)


def chi_square(quantile: float, dof: int = DIM) -> float:
    """Quantile of the chi-square distribution (cube-root normal approximation)."""
    z = NormalDist().inv_cdf(quantile)
    return dof * (1 - 2 / (9 * dof) + z * math.sqrt(2 / (9 * dof))) ** 3


def with_stats(rows: DataFrame, text: str) -> DataFrame:
    """``rows`` with the nine statistics of column ``text`` added."""
    at = rows.columns.index(text)

    def run(batches):
        for batch in batches:
            made = [text_stats(t) for t in raw_texts(batch.column(at))]
            more = zip(*made) if made else [()] * len(BASE + MORE)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, *[pa.array(m, pa.int64()) for m in more]],
                [*batch.schema.names, *BASE, *MORE],
            )

    fields = [T.StructField(n, T.LongType()) for n in BASE + MORE]
    return rows.mapInArrow(run, T.StructType([*rows.schema.fields, *fields]))


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (
        100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words")
    )


def _vector() -> list[Column]:
    """The transformed statistics as whole multiples of 1 / ``GRID``."""
    words = F.greatest(F.col("n_words"), F.lit(1)).cast("double")
    chars = F.greatest(F.col("word_chars"), F.lit(1)).cast("double")
    lines = F.greatest(F.col("n_lines"), F.lit(1)).cast("double")

    def share(part: str, whole: Column) -> Column:
        return F.asin(F.sqrt(F.least(F.col(part) / whole, F.lit(1.0))))

    def rate(part: str) -> Column:
        return F.log1p(100 * F.col(part) / chars)

    raw = [
        F.log(chars / words),
        rate("n_symbols"),
        share("n_dup_lines", lines),
        share("n_repeat_words", words),
        F.log(F.greatest(F.col("n_distinct"), F.lit(1)).cast("double"))
        / F.log(F.greatest(words, F.lit(3.0))),
        rate("n_upper"),
        rate("n_marks"),
    ]
    return [F.round(x * GRID).cast("long").alias(f"x{i}") for i, x in enumerate(raw)]


def pair_key(lang: str, source: str) -> Column:
    """One text per (lang, source), nulls included."""

    def part(name: str) -> Column:
        text = col(name).cast("string")
        return F.coalesce(F.concat(F.length(text), F.lit(":"), text), F.lit("-"))

    return F.concat(part(lang), F.lit("/"), part(source))


# Estimates that judge a text, from the narrowest to the widest.
LEVELS = ["own", "language", "all"]


def _groups() -> list[Column]:
    """The group of a text at each level."""
    return [F.concat(F.lit("1"), "pair"), F.concat(F.lit("2"), "language"), F.lit("3")]


# Where steps start from: median deviations, correlations of squashed values, of directions.
STARTS = 3
_SPREAD = T.StructType(
    [
        T.StructField("g", T.StringType()),
        T.StructField("n", T.LongType()),
        T.StructField("mu", T.ArrayType(T.DoubleType())),
        T.StructField("sd", T.ArrayType(T.DoubleType())),
    ]
)
# logdet is null before the first step; a fit that rests has the scale of its own distances.
_FIT = T.StructType(
    [
        T.StructField("g", T.StringType()),
        T.StructField("start", T.IntegerType()),
        T.StructField("n", T.LongType()),
        T.StructField("mu", T.ArrayType(T.DoubleType())),
        T.StructField("inv", T.ArrayType(T.DoubleType())),
        T.StructField("logdet", T.DoubleType()),
        T.StructField("scale", T.DoubleType()),
    ]
)


def _inverse(cov: np.ndarray) -> np.ndarray:
    return np.linalg.inv(cov + np.diag(np.square(FLOORS)))


def _logdet(cov: np.ndarray) -> float:
    return float(np.linalg.slogdet(cov + np.diag(np.square(FLOORS)))[1])


def _weighted_median(values: np.ndarray, counts: np.ndarray) -> float:
    order = np.argsort(values, kind="stable")
    run = np.cumsum(counts[order])
    return float(values[order][np.searchsorted(run, (run[-1] + 1) // 2)])


def _spread(group: pd.DataFrame) -> pd.DataFrame:
    """Medians and median deviations from counts of grid values."""
    mu, sd = [], []
    for i in range(DIM):
        own = group[group["axis"] == i]
        x, n = own["x"].to_numpy() / GRID, own["n"].to_numpy()
        mid = _weighted_median(x, n)
        mu.append(mid)
        sd.append(1.4826 * _weighted_median(np.abs(x - mid), n))
    size = int(group.loc[group["axis"] == 0, "n"].sum())
    return pd.DataFrame([(group["g"].iloc[0], size, mu, sd)], columns=_SPREAD.names)


def _start(group: pd.DataFrame) -> pd.DataFrame:
    """The fits that steps start from, of one group."""
    row = group.iloc[0]
    sd = np.array(row["sd"])
    shapes = [np.eye(DIM)]
    for kind in ("t", "u"):
        cov = np.empty((DIM, DIM))
        for i in range(DIM):
            for j in range(i, DIM):
                cov[i, j] = cov[j, i] = float(int(row[f"{kind}{i}_{j}"]))
        spread = np.sqrt(np.diag(cov))
        spread[spread == 0] = 1.0
        shape = cov / np.outer(spread, spread)
        np.fill_diagonal(shape, 1.0)
        shapes.append(shape)
    return pd.DataFrame(
        [
            (row["g"], i, row["n"], row["mu"], _inverse(shape * np.outer(sd, sd)).ravel().tolist(), None, 1.0)
            for i, shape in enumerate(shapes)
        ],
        columns=_FIT.names,
    )


def _starts(rows: DataFrame, spread: DataFrame, groups: int) -> DataFrame:
    """Starting fits, with the correlations about the medians from one aggregation."""
    placed = join_hot_key(rows, spread.select("g", "mu", "sd"), ["g"], few_rows=3 * groups)
    gap = [
        (F.col(f"x{i}") / F.lit(float(GRID)) - F.col("mu")[i])
        / F.sqrt(F.col("sd")[i] * F.col("sd")[i] + F.lit(f * f))
        for i, f in enumerate(FLOORS)
    ]
    gaps = placed.select("g", *[y.alias(f"y{i}") for i, y in enumerate(gap)])
    length = F.sqrt(sum((F.col(f"y{i}") * F.col(f"y{i}") for i in range(DIM)), F.lit(0.0)))
    away = F.greatest(length, F.lit(1e-9))
    whole = gaps.select(
        "g",
        *[F.round(F.tanh(f"y{i}") * GRID).cast("long").alias(f"t{i}") for i in range(DIM)],
        *[F.round(F.col(f"y{i}") / away * GRID).cast("long").alias(f"u{i}") for i in range(DIM)],
    )
    sums = [
        F.sum(F.col(f"{kind}{i}") * F.col(f"{kind}{j}")).alias(f"{kind}{i}_{j}")
        for kind in ("t", "u")
        for i in range(DIM)
        for j in range(i, DIM)
    ]
    return (
        whole.groupBy("g").agg(*sums).join(spread, "g").groupBy("g").applyInPandas(_start, _FIT)
    )


def _concentrate(group: pd.DataFrame) -> pd.DataFrame:
    """The next fit, of the nearest ``subset_size``, and the scale of the distances in use."""
    group = group.sort_values("bin")
    counts = group["n"].to_numpy()
    run = np.cumsum(counts)
    size = int(run[-1])
    last = int(np.searchsorted(run, subset_size(size)))
    near = group.iloc[: last + 1]
    n = int(run[last])
    sums = [sum(map(int, near[f"s{i}"])) for i in range(DIM)]
    cov = np.empty((DIM, DIM))
    for i in range(DIM):
        for j in range(i, DIM):
            products = sum(map(int, near[f"s{i}_{j}"]))
            exact = n * products - sums[i] * sums[j]
            cov[i, j] = cov[j, i] = exact / (n * n * GRID * GRID)
    middle = group["bin"].iloc[int(np.searchsorted(run, (size + 1) // 2))]
    half = 2.0 ** ((middle + 1) / BINS_PER_OCTAVE)
    mu = [s / (n * GRID) for s in sums]
    # The spread of the nearest half is too small; scaled so that half are within the median.
    return pd.DataFrame(
        [
            (
                *(group["g"].iloc[0], int(group["start"].iloc[0]), size, mu),
                *(_inverse(cov).ravel().tolist(), _logdet(cov)),
                max(1.0, half / chi_square(0.5)),
            )
        ],
        columns=_FIT.names,
    )


def squared_distance(fit: str = "") -> Column:
    """Squared Mahalanobis distance of x0.. from mu, inv (before scaling), or those in ``fit``."""
    at = f"{fit}." if fit else ""
    gap = [F.col(f"x{i}") / F.lit(float(GRID)) - F.col(f"{at}mu")[i] for i in range(DIM)]
    total = F.lit(0.0)
    for i in range(DIM):
        for j in range(i, DIM):
            part = gap[i] * gap[j] * F.col(f"{at}inv")[i * DIM + j]
            total = total + (part if i == j else 2 * part)
    return total


def _step(rows: DataFrame, fits: DataFrame, groups: int) -> DataFrame:
    """The fits after one step more, with ``rests``; those that rest stay as they are."""
    moving = fits.filter("not rests").select("g", "start", "mu", "inv")
    # An estimate is as wide as some fifteen rows of a few numbers.
    placed = join_hot_key(rows, moving, ["g"], few_rows=16 * STARTS * groups)
    place = F.floor(F.log2(F.greatest(squared_distance(), F.lit(1e-9))) * BINS_PER_OCTAVE)
    binned = placed.select(
        "g", "start", place.cast("int").alias("bin"), *[f"x{i}" for i in range(DIM)]
    )
    sums = [F.sum(f"x{i}").alias(f"s{i}") for i in range(DIM)]
    sums += [
        F.sum(F.col(f"x{i}") * F.col(f"x{j}")).alias(f"s{i}_{j}")
        for i in range(DIM)
        for j in range(i, DIM)
    ]
    # At most about 1,000 bins for a group and start, whatever the size of the group.
    found = (
        binned.groupBy("g", "start", "bin")
        .agg(F.count("*").alias("n"), *sums)
        .groupBy("g", "start")
        .applyInPandas(_concentrate, _FIT)
    )
    new = found.select("g", "start", F.struct("mu", "inv", "logdet", "scale").alias("new"))
    falls = F.col("logdet").isNull() | (F.col("new.logdet") < F.col("logdet") - TOLERANCE)
    moves = ~F.col("rests") & falls
    old_scale = F.when(F.col("rests"), F.col("scale")).otherwise(F.col("new.scale"))
    return fits.join(new, ["g", "start"], "left").select(
        "g",
        "start",
        "n",
        *[F.when(moves, F.col(f"new.{c}")).otherwise(F.col(c)).alias(c) for c in ("mu", "inv", "logdet")],
        F.when(moves, F.lit(1.0)).otherwise(old_scale).alias("scale"),
        (~moves).alias("rests"),
    )


def fit(measured: DataFrame, lang: str = "lang", source: str = "source") -> DataFrame:
    """(pair, own, language, all) per language and source of ``measured`` (with statistics).

    Each of ``LEVELS`` is an estimate (mu, inv, scale, n). Rows that fail the base rules take
    no part. Each start of each group is followed until its determinant falls no more; more
    than ``MAX_STEPS`` steps are an error.
    """
    good = measured.filter(~base_failed()).select(
        pair_key(lang, source).alias("pair"),
        F.coalesce(F.concat(F.lit("="), col(lang).cast("string")), F.lit("-")).alias("language"),
        *_vector(),
    )
    good = stored(good, "vectors")
    pairs = good.select("pair", "language").distinct()
    keys = stored(
        pairs.select("pair", *[g.alias(f"g_{level}") for level, g in zip(LEVELS, _groups())]), "fit-keys"
    )
    size = keys.select(F.explode(F.array(*[f"g_{level}" for level in LEVELS]))).distinct().count()
    # A text counts in three estimates; vectors are seven numbers.
    rows = stored(
        good.select(F.explode(F.array(*_groups())).alias("g"), *[f"x{i}" for i in range(DIM)]),
        "grouped-vectors",
    )
    axes = F.array(
        *[F.struct(F.lit(i).alias("axis"), F.col(f"x{i}").alias("x")) for i in range(DIM)]
    )
    values = (
        rows.select("g", F.explode(axes).alias("a"))
        .groupBy("g", "a.axis", "a.x")
        .agg(F.count("*").alias("n"))
    )
    # Grid values of a bounded range: at most some ten thousand for a group and axis.
    spread = stored(values.groupBy("g").applyInPandas(_spread, _SPREAD), "medians")
    now = stored(_starts(rows, spread, size).withColumn("rests", F.lit(False)), "fit")
    steps = 0
    while moving := now.filter("not rests").count():
        if steps == MAX_STEPS:
            raise RuntimeError(f"{moving} estimates do not rest after {MAX_STEPS} steps")
        now = stored(_step(rows, now, size), "fit")
        steps += 1
    best = now.groupBy("g").agg(F.min(F.struct("logdet", "start", "n", "mu", "inv", "scale")).alias("b"))
    best = stored(best.select("g", F.struct("b.mu", "b.inv", "b.scale", "b.n").alias("best")), "estimates")
    out = keys
    for level in LEVELS:
        own = best.select(F.col("g").alias(f"g_{level}"), F.col("best").alias(level))
        out = join_hot_key(out, own, [f"g_{level}"])
    return out.select("pair", *LEVELS)


def _blended(discount: Column) -> Column:
    """Squared distance from the three estimates, as the weighted mean of their logarithms.

    Distances below the median of ordinary texts count as that, so none can outweigh another
    by being tiny.
    """
    ordinary = chi_square(0.5)
    out = F.lit(math.log(ordinary))
    for level in reversed(LEVELS):
        own = squared_distance(level) / F.col(f"{level}.scale") * discount
        n = F.col(f"{level}.n")
        weight = n / (n + F.lit(TABLE_TEXTS if level == "all" else GROUP_TEXTS))
        out = weight * F.log(F.greatest(own, F.lit(ordinary))) + (1 - weight) * out
    return F.exp(out)


def judge(measured: DataFrame, fitted: DataFrame, lang: str = "lang", source: str = "source"):
    """``measured`` with base_failed, distance (squared, scaled, discounted, blended) and kept."""
    names = measured.columns
    framed = measured.withColumns(
        {"pair": pair_key(lang, source), **{f"x{i}": c for i, c in enumerate(_vector())}}
    )
    placed = join_hot_key(framed, fitted, ["pair"], "left")
    distance = _blended(F.col("n_words") / (F.col("n_words") + F.lit(PRIOR_WORDS)))
    far = F.coalesce(distance > chi_square(1 - TAIL), F.lit(False))
    return placed.select(
        *names,
        base_failed().alias("base_failed"),
        F.when(base_failed(), F.lit(None)).otherwise(distance).alias("distance"),
        (~base_failed() & ~far).alias("kept"),
    )


def assess(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, n_words, the base statistics, base_failed, kept, distance.

    Null and empty texts have no words and fail. Null lang and null source are groups of
    their own. Repeated rows count as often as they occur and come out as often.
    """
    narrow = docs.select("doc_id", "lang", "source", "text")
    measured = stored(with_stats(narrow, "text").drop("text"), "text-stats")
    return judge(measured, fit(measured)).select("doc_id", *BASE, "base_failed", "kept", "distance")


def keep_good(docs: DataFrame) -> DataFrame:
    """The documents that ``assess`` keeps; columns and types as in ``docs``."""
    columns = docs.columns
    at = {c: f"c{i}" for i, c in enumerate(columns)}
    lang, source, text = at["lang"], at["source"], at["text"]
    # Texts are stored beside their statistics: a second reading is cheaper than a second
    # count, and rows need no key to find their verdicts by. The fit reads the numbers only.
    measured = stored(with_stats(docs.toDF(*at.values()), text), "text-stats")
    kept = judge(measured, fit(measured, lang, source), lang, source).filter("kept")
    return kept.select(*[col(at[c]).alias(c) for c in columns])
