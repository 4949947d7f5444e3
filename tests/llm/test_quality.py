import math
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from presswork.llm import common, outliers, text_stats
from tests.llm import cases

SF = "/root/testdata/sf0.01"


def brute_base(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    runs = Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
    covered = {
        i + k for i in range(len(words) - 4) for k in range(5) if runs[tuple(words[i : i + 5])] > 1
    }
    seen, dup = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    symbols = sum(text.count(c) for c in "#*$%&|<>")
    n = len(words)
    failed = n < 10 or 100 * len(covered) > 20 * n
    return n, sum(map(len, words)), symbols, dup, len(covered), failed


def test_chi_square():
    # From printed tables, 7 degrees of freedom.
    for q, x in [(0.5, 6.346), (0.95, 14.067), (0.99, 18.475), (0.999, 24.322)]:
        assert outliers.chi_square(q) == pytest.approx(x, rel=0.01)


def test_base_statistics(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = {r.doc_id: r.text for r in docs.collect()}
    got = outliers.assess(docs).collect()
    assert len(got) == len(rows)
    for r in got:
        own = (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed)
        assert own == brute_base(rows[r.doc_id])
        assert not (r.base_failed and r.kept)


@pytest.mark.parametrize("limit", [1, 50, 4_000])
def test_blocks_do_not_change_statistics(limit, monkeypatch):
    text = ("one two three four five six.\n\nSEVEN! \n" * 9 + "é|漢 \n").encode()
    want = text_stats.text_stats(text)
    assert want[:5] == brute_base(text.decode())[:5]
    monkeypatch.setattr(text_stats, "word_blocks", lambda raw: common.word_blocks(raw, limit))
    monkeypatch.setattr(text_stats, "_LINES_AT_ONCE", limit)
    assert text_stats.text_stats(text) == want


def test_verdicts_against_labels(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    rows = outliers.assess(docs).join(labels, "doc_id").filter("not base_failed").collect()
    good = [r.kept for r in rows if r.quality == 1]
    bad = [r.kept for r in rows if r.quality == 0]
    assert sum(good) / len(good) > 0.995 and sum(bad) / len(bad) < 0.1


def test_a_third_of_junk_does_not_move_the_centre(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").filter("lang = 'en'")
    plain = docs.filter("doc_id % 2 = 0").withColumn("source", F.lit("s"))
    junk = plain.filter("doc_id % 4 = 0").select(
        (F.col("doc_id") + 1_000_000).alias("doc_id"),
        F.regexp_replace("text", r"(\S+)", "$1 | <%%%>").alias("text"),
        *["lang", "source", "n_chars"],
    )
    got = outliers.assess(plain.unionByName(junk)).filter("not base_failed").collect()
    assert not any(r.kept for r in got if r.doc_id >= 1_000_000)
    alone = {r.doc_id for r in outliers.assess(plain).filter("kept").collect()}
    assert len(alone - {r.doc_id for r in got if r.kept}) <= 0.02 * len(alone)


def test_odd_rows(spark):
    docs = cases.clashing(spark, ["n_words", "pair", "g", "x0", "mu", "kept", "distance"])
    got = outliers.assess(docs).collect()
    assert len(got) == len(cases.ROWS)
    # Too few to judge: only the base rules count.
    assert all(r.kept != r.base_failed for r in got)
    kept = outliers.keep_good(docs)
    assert kept.columns == docs.columns and kept.dtypes == docs.dtypes
    want = [r for r in cases.ROWS if not brute_base(r[1])[-1]]
    assert kept.count() == len(want)
    assert cases.as_set(kept.select(*cases.SCHEMA.names)) == sorted(want, key=repr)
    empty = cases.documents(spark, [])
    assert outliers.assess(empty).count() == outliers.keep_good(empty).count() == 0


def test_equal_texts_have_no_spread(spark):
    rows = [(i, cases.ENGLISH, "en", "a", 1) for i in range(200)]
    odd = (999, "### " + "| ".join(f"w{i}" for i in range(60)), "en", "a", 1)
    got = outliers.assess(cases.documents(spark, [*rows, odd])).collect()
    assert {r.doc_id for r in got if not r.kept} == {999}


def test_a_tight_third_of_junk_that_passes_the_base_rules_goes(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").filter("lang = 'en'")
    plain = docs.withColumn("source", F.lit("s"))
    n = outliers.assess(plain).filter("not base_failed").count()
    menus = [
        (10_000_000 + i, " | ".join(f"<item{i}x{k}>" for k in range(60)), "en", "s", 1)
        for i in range(n // 2)
    ]
    got = outliers.assess(plain.unionByName(cases.documents(spark, menus))).collect()
    junk = [r for r in got if r.doc_id >= 10_000_000]
    assert len(junk) == n // 2 and not any(r.base_failed for r in junk)
    assert not any(r.kept for r in junk)
    good = [r.kept for r in got if r.doc_id < 10_000_000 and not r.base_failed]
    alone = outliers.assess(plain).filter("kept").count()
    assert sum(good) >= 0.98 * alone


def brute_step(x, mu, inv):
    """Next centre, covariance with floors and its log determinant, and the scale in use."""
    gap = x - mu
    d2 = np.einsum("ij,jk,ik->i", gap, inv, gap)
    place = np.floor(np.log2(np.maximum(d2, 1e-9)) * outliers.BINS_PER_OCTAVE)
    ordered = np.sort(place)
    near = x[place <= ordered[min(len(x), (len(x) + outliers.DIM + 1) // 2) - 1]]
    cov = np.cov(near.T, bias=True) + np.diag(np.square(outliers.FLOORS))
    half = 2 ** ((ordered[(len(x) + 1) // 2 - 1] + 1) / outliers.BINS_PER_OCTAVE)
    return near.mean(axis=0), cov, np.linalg.slogdet(cov)[1], max(1.0, half / outliers.chi_square(0.5))


def brute_rest(x, mu, inv):
    last = math.inf
    while True:
        new, cov, logdet, scale = brute_step(x, mu, inv)
        if logdet >= last - 1e-9:
            return last, mu, inv, scale
        last, mu, inv = logdet, new, np.linalg.inv(cov)


def test_no_step_and_no_start_lowers_the_determinant(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").withColumn("source", F.lit("s"))
    measured = outliers.with_stats(docs.select("doc_id", "lang", "source", "text"), "text")
    fitted = {r.pair: r.own for r in outliers.fit(measured).collect()}
    good = measured.filter(~outliers.base_failed()).select(
        outliers.pair_key("lang", "source").alias("pair"), *outliers._vector()
    ).collect()
    seen = 0
    for name, size in Counter(r.pair for r in good).items():
        if size < 50:
            continue
        x = np.array([list(r)[1:] for r in good if r.pair == name]) / outliers.GRID
        got = fitted[name]
        own = -np.linalg.slogdet(np.reshape(got.inv, (outliers.DIM,) * 2))[1]
        mu = np.array([np.sort(c)[(len(c) + 1) // 2 - 1] for c in x.T])
        sd = 1.4826 * np.array([np.sort(c)[(len(c) + 1) // 2 - 1] for c in np.abs(x - mu).T])
        floors = np.array(outliers.FLOORS)
        y = (x - mu) / np.sqrt(sd**2 + floors**2)
        shapes = [np.eye(outliers.DIM)]
        for z in (np.tanh(y), y / np.maximum(np.sqrt((y**2).sum(axis=1, keepdims=True)), 1e-9)):
            z = np.sign(z) * np.floor(np.abs(z) * outliers.GRID + 0.5)
            cov = z.T @ z
            spread = np.where(np.diag(cov) == 0, 1.0, np.sqrt(np.diag(cov)))
            shape = cov / np.outer(spread, spread)
            np.fill_diagonal(shape, 1.0)
            shapes.append(shape)
        ends = [
            brute_rest(x, mu, np.linalg.inv(s * np.outer(sd, sd) + np.diag(floors**2))) for s in shapes
        ]
        logdet, centre, inv, scale = min(ends, key=lambda e: e[0])
        assert own == pytest.approx(logdet, abs=1e-6)
        assert np.allclose(got.mu, centre, atol=1e-6) and got.scale == pytest.approx(scale)
        assert brute_step(x, np.array(got.mu), np.reshape(got.inv, inv.shape))[2] >= own - 1e-6
        seen += 1
    assert seen > 1


def test_junk_that_is_the_majority_of_a_small_group_goes(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").filter("lang = 'en'")
    first = docs.orderBy("doc_id").limit(50).withColumn("source", F.lit("small"))
    plain = first.unionByName(docs.join(first, "doc_id", "left_anti").withColumn("source", F.lit("s")))
    menus = [
        (10_000_000 + i, " | ".join(f"<item{i}x{k}>" for k in range(60)), "en", "small", 1)
        for i in range(80)
    ]
    got = outliers.assess(plain.unionByName(cases.documents(spark, menus))).collect()
    junk = [r for r in got if r.doc_id >= 10_000_000]
    assert len(junk) == 80 and not any(r.base_failed or r.kept for r in junk)
    alone = {r.doc_id for r in outliers.assess(plain).filter("kept").collect()}
    assert len(alone - {r.doc_id for r in got if r.kept}) <= 0.02 * len(alone)
    small = {r.doc_id for r in first.collect()} & alone
    assert len(small - {r.doc_id for r in got if r.kept}) <= 2


def test_one_text_more_turns_no_other_verdict(spark):
    """A distance moves little when a group grows from 49 texts to 50."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").filter("lang = 'en'").orderBy("doc_id")
    rest = docs.withColumn("source", F.lit("s")).filter("doc_id % 2 = 0")
    small = docs.filter("doc_id % 2 = 1").withColumn("source", F.lit("small"))
    seen = []
    for n in (49, 50):
        got = outliers.assess(rest.unionByName(small.limit(n))).filter("distance is not null")
        seen.append({r.doc_id: r.distance for r in got.collect()})
    for a, b in zip(seen, seen[1:]):
        moved = [abs(math.log(a[d] / b[d])) for d in a if d in b]
        assert max(moved) < 0.5 and sum(moved) / len(moved) < 0.05


def test_estimates_that_do_not_rest_are_an_error(spark, monkeypatch):
    monkeypatch.setattr(outliers, "MAX_STEPS", 1)
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang", "source", "text")
    with pytest.raises(RuntimeError, match="do not rest"):
        outliers.fit(outliers.with_stats(docs, "text"))


def test_leftovers_are_judged_by_all_texts(spark):
    plain = spark.read.parquet(f"{SF}/documents.parquet").filter("lang = 'en'")
    plain = plain.withColumn("source", F.lit("s"))
    rare = [
        (10_000_000 + i, " | ".join(f"<item{i}x{k}>" for k in range(60)), f"rare{i % 3}", "r", 1)
        for i in range(9)
    ]
    fine = plain.limit(20).select(
        (F.col("doc_id") + 20_000_000).alias("doc_id"),
        *["text", F.lit("rare9").alias("lang"), "source", "n_chars"],
    )
    docs = plain.unionByName(cases.documents(spark, rare)).unionByName(fine)
    got = outliers.assess(docs).filter("not base_failed").collect()
    junk = [r.kept for r in got if 10_000_000 <= r.doc_id < 20_000_000]
    assert len(junk) == 9 and not any(junk)
    assert all(r.distance is not None for r in got)
    assert {r.doc_id - 20_000_000 for r in got if r.doc_id >= 20_000_000 and r.kept} == {
        r.doc_id for r in got if r.kept
    } & {r.doc_id - 20_000_000 for r in got if r.doc_id >= 20_000_000}
