"""Language identification by rank-order profiles of character n-grams.

A profile is the list of a language's most frequent n-grams of one to three characters.
A document's own most frequent n-grams are compared with each profile: the distance adds
up how far every n-gram is out of place, an n-gram that the profile lacks counts as out
by the profile's whole length, and the language with the least distance is predicted.

N-grams are taken inside words (runs of letters, lower case) with one blank on either
side, so a blank marks a word's beginning or end and no n-gram spans two words. Equal
counts rank by code point. Both counting passes work on whole texts in bounded blocks.
"""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from presswork.llm.common import decoded, raw_texts
from presswork.session import stored

PROFILE = 400
UNKNOWN = "und"
MAX_LANGUAGES = 2_000
# How far below a language's median a text may score, in median deviations: the lowest of
# 10,000 clean documents was 6.3 below. Fewer documents than MIN_LEARNED set no floor.
SPREADS = 8
MIN_LEARNED = 50
# Scores are counted in so many steps; a spread counts as so many of them at least.
_STEPS = 1_000
_LEAST_SPREAD = 20
_BLOCK_CHARS = 1 << 18
_FLUSH = 1 << 19
_OTHER = regex.compile(r"\P{L}+")


@functools.cache
def _letters() -> np.ndarray:
    """Per code point one more than its lower-case letter, or one if it is no letter."""
    low = [ord(c.lower()[0]) + 1 if c.isalpha() else 1 for c in map(chr, range(0x110000))]
    return np.array(low, np.int64)


def _codes(text: str) -> np.ndarray:
    """N-gram codes of a text: up to three characters at 21 bits each, the blank as one."""
    at = _letters()[np.frombuffer(f" {text} ".encode("utf-32-le", "replace"), np.uint32)]
    at = at[np.concatenate(([True], (at[1:] != 1) | (at[:-1] != 1)))]
    if len(at) < 2:
        return np.empty(0, np.int64)
    two = (at[:-1] << 21) | at[1:]
    three = ((two[:-1] << 21) | at[2:])[at[1:-1] != 1]
    return np.concatenate((at[at != 1], two, three))


def _merge(codes: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    found, where = np.unique(codes, return_inverse=True)
    return found, np.bincount(where, counts, len(found)).astype(np.int64)


def gram_counts(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Sorted n-gram codes of a whole text and their counts."""
    total = (np.empty(0, np.int64), np.empty(0, np.int64))
    at = 0
    while at < len(text):
        end = at + _BLOCK_CHARS
        if end < len(text):  # end the block between two words
            gap = _OTHER.search(text, end)
            end = gap.start() if gap else len(text)
        some = np.unique(_codes(text[at:end]), return_counts=True)
        total = some if at == 0 else _merge(*map(np.concatenate, zip(total, some)))
        at = end
    return total


def _ranked(codes: np.ndarray, counts: np.ndarray, k: int) -> np.ndarray:
    """The k most frequent codes, most frequent first, equal counts by code."""
    if len(codes) > k:  # codes are sorted, so a stable sort keeps equal counts in order
        floor = np.partition(counts, len(counts) - k)[len(counts) - k]
        codes, counts = codes[counts >= floor], counts[counts >= floor]
    return codes[np.argsort(-counts, kind="stable")[:k]]


def learn(docs: DataFrame, size: int = PROFILE) -> dict[str, np.ndarray]:
    """Profiles of the languages in ``docs`` (text, lang): n-gram codes in rank order.

    All rows with a text and a lang count. A task sends one row per language and n-gram it
    has met, so what is shuffled follows the alphabets, not the texts; the driver receives
    ``size`` rows per language. No usable rows: no profiles.
    """
    usable = docs.filter("lang is not null and text is not null").select(
        F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text")
    )

    def count(batches):
        held: dict[str, list] = {}
        size_held = 0

        def rows():
            for lang, parts in held.items():
                codes, counts = _merge(*map(np.concatenate, zip(*parts)))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([lang] * len(codes), pa.string()), pa.array(codes), pa.array(counts)],
                    ["lang", "gram", "n"],
                )
            held.clear()

        for batch in batches:
            texts: dict[str, list[str]] = {}
            for lang, raw in zip(batch.column("lang").to_pylist(), raw_texts(batch.column("text"))):
                texts.setdefault(lang, []).append(decoded(raw))
            for lang, own in texts.items():
                # A line break ends words, so texts can be counted together.
                part = gram_counts("\n".join(own))
                if lang in held:
                    before = held[lang][0]
                    size_held -= len(before[0])
                    part = _merge(*map(np.concatenate, zip(before, part)))
                held[lang] = [part]
                size_held += len(part[0])
            if size_held > _FLUSH:
                yield from rows()
                size_held = 0
        yield from rows()

    grams = usable.mapInArrow(count, "lang string, gram long, n long")
    # Read twice below, so counted once: as long as the alphabets allow, not the texts.
    total = stored(grams.groupBy("lang", "gram").agg(F.sum("n").alias("n")), "gram-counts")
    rank = F.row_number().over(W.partitionBy("lang").orderBy(F.desc("n"), "gram"))
    top = total.withColumn("rank", rank).filter(F.col("rank") <= size)
    if total.select("lang").distinct().limit(MAX_LANGUAGES + 1).count() > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages; is lang a language column?")
    profiles: dict[str, list] = {}
    for r in top.orderBy("lang", "rank").toLocalIterator():
        profiles.setdefault(r["lang"], []).append(r["gram"])
    return {lang: np.array(g, np.int64) for lang, g in profiles.items()}


class Profiles:
    """Profiles as one table: a row per n-gram of any of them, a column per language."""

    def __init__(self, profiles: dict[str, np.ndarray], size: int = PROFILE):
        self.size = size
        self.languages = sorted(profiles)
        known = [profiles[x] for x in self.languages]
        self.grams = np.unique(np.concatenate([*known, np.empty(0, np.int64)]))
        self.ranks = np.full((len(self.grams), len(known)), -1, np.int32)
        for at, grams in enumerate(known):
            self.ranks[np.searchsorted(self.grams, grams), at] = np.arange(len(grams))

    def predict(self, text: str | None) -> tuple[str, float, float]:
        """Language, score and lead over the next language, both from 0 to 1.

        The score is one less the distance as a part of the largest possible one. Equal
        distances go to the language first by name.
        """
        own = _ranked(*gram_counts(text or ""), self.size)
        if not len(own) or not self.languages:
            return UNKNOWN, 0.0, 0.0
        at = np.minimum(np.searchsorted(self.grams, own), len(self.grams) - 1)
        met = self.grams[at] == own
        place = self.ranks[at[met]]
        out = np.abs(place - np.flatnonzero(met)[:, None])
        out[place < 0] = self.size
        distance = out.sum(axis=0) + (len(own) - int(met.sum())) * self.size
        best = int(distance.argmin())
        most = len(own) * self.size
        rest = np.delete(distance, best)
        lead = (rest.min() - distance[best]) / most if len(rest) else 1.0
        return self.languages[best], float(1 - distance[best] / most), float(lead)


def predict(
    docs: DataFrame, profiles: dict[str, np.ndarray], size: int = PROFILE, text: str = "text"
) -> DataFrame:
    """``docs`` with lang_pred, score and lead added; columns of these names give way.

    Texts that are null or have no letter are ``und`` with score zero, and so is every text
    if no language was learned. Profiles travel to the tasks with the function: ``size``
    entries per language.
    """
    table = Profiles(profiles, size)
    rest = docs.drop("lang_pred", "score", "lead")
    at = rest.columns.index(text)

    def run(batches):
        for batch in batches:
            made = [
                table.predict(None if t is None else decoded(t))
                for t in raw_texts(batch.column(at))
            ]
            lang, score, lead = zip(*made) if made else ((), (), ())
            yield pa.RecordBatch.from_arrays(
                [
                    *batch.columns,
                    pa.array(lang, pa.string()),
                    pa.array(score, pa.float64()),
                    pa.array(lead, pa.float64()),
                ],
                [*batch.schema.names, "lang_pred", "score", "lead"],
            )

    added = [("lang_pred", T.StringType()), ("score", T.DoubleType()), ("lead", T.DoubleType())]
    schema = T.StructType([*rest.schema.fields, *[T.StructField(n, t) for n, t in added]])
    return rest.mapInArrow(run, schema)


def held_out(doc_id: Column) -> Column:
    """True for the quarter of documents that training never sees."""
    remainder = F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(4))
    return F.coalesce(remainder == 2, F.lit(False))


def learn_from(docs: DataFrame, size: int = PROFILE) -> dict[str, np.ndarray]:
    """Profiles from the documents that are not held out."""
    return learn(docs.filter(~held_out(F.col("doc_id"))), size)


def identify(docs: DataFrame, size: int = PROFILE) -> DataFrame:
    """One row per document: doc_id, held_out, lang_pred, score, lead.

    Profiles are learned from the documents not held out; a null doc_id is not held out.
    The prediction reads the text alone.
    """
    narrow = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text")
    return predict(narrow, learn_from(docs, size), size).drop("text")


def _middle(rows: DataFrame, value: str) -> DataFrame:
    """Per language the weighted median of whole numbers (lang_pred, ``value``, n)."""
    up_to = W.partitionBy("lang_pred").orderBy(value)
    return (
        rows.withColumn("up_to", F.sum("n").over(up_to))
        .withColumn("all", F.sum("n").over(W.partitionBy("lang_pred")))
        .filter(F.col("up_to") * 2 >= F.col("all"))
        .groupBy("lang_pred")
        .agg(F.min(value).alias("middle"), F.first("all").alias("n_learned"))
    )


def score_floors(learned: DataFrame) -> DataFrame:
    """Per language (lang_pred, floor) the least score of a text that is taken to be in it.

    ``learned`` (lang_pred, score) are the learning documents predicted as what they are. The
    floor is ``SPREADS`` median deviations below the median, in steps of 1 / ``_STEPS`` so
    that sums are exact, from all of them. Languages of fewer than ``MIN_LEARNED`` have none.
    """
    step = F.floor(F.col("score") * _STEPS).cast("int")
    steps = learned.groupBy("lang_pred", step.alias("step")).agg(F.count("*").alias("n"))
    steps = stored(steps, "score-steps")
    medians = _middle(steps, "step").withColumnRenamed("middle", "median")
    # A row per language, MAX_LANGUAGES at most.
    away = (
        steps.join(F.broadcast(medians), "lang_pred")
        .withColumn("away", F.abs(F.col("step") - F.col("median")))
        .groupBy("lang_pred", "away")
        .agg(F.sum("n").alias("n"))
    )
    spreads = _middle(away, "away").select("lang_pred", F.col("middle").alias("spread"))
    floor = F.col("median") - SPREADS * F.greatest("spread", F.lit(_LEAST_SPREAD))
    return (
        medians.filter(F.col("n_learned") >= MIN_LEARNED)
        .join(F.broadcast(spreads), "lang_pred")
        .select("lang_pred", (floor / _STEPS).alias("floor"))
    )


def keep_identified(
    docs: DataFrame, languages: list[str] | None = None, min_score: float | None = None
) -> DataFrame:
    """The documents in a learned language (one of ``languages``, if given).

    Goes: every text that is ``und``, of another language, or scored below ``min_score``; if
    none is given, below the floor of its language, which the learning documents set: text in
    a language that was not learned and encoded data match no profile, but one is nearest.
    The predictions are then stored beside the documents. Columns and types as in ``docs``.
    """
    columns = docs.columns
    renamed = docs.toDF(*[f"c{i}" for i in range(len(columns))])
    judged = predict(renamed, learn_from(docs), text=f"c{columns.index('text')}")
    if min_score is None:
        judged = stored(judged, "identified")
        lang, doc_id = (F.col(f"c{columns.index(c)}") for c in ("lang", "doc_id"))
        own = (lang.cast("string") == F.col("lang_pred")) & ~held_out(doc_id)
        floors = score_floors(judged.filter(own))
        judged = judged.join(F.broadcast(floors), "lang_pred", "left")
        good = F.col("score") >= F.coalesce("floor", F.lit(0.0))
    else:
        good = F.col("score") >= min_score
    good &= F.col("lang_pred") != UNKNOWN
    if languages is not None:
        good &= F.col("lang_pred").isin(languages)
    return judged.filter(good).select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(columns)])
