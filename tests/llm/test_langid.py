import base64
import random
import unicodedata
import zlib
from collections import Counter

import pytest

from presswork.llm import langid
from tests.llm import cases

SF = "/root/testdata/sf0.01"


def brute_grams(text):
    """N-grams in rank order, and their counts."""
    low = "".join(c.lower()[0] if unicodedata.category(c)[0] == "L" else " " for c in text or "")
    counts = Counter()
    for word in low.split():
        counts.update(word)
        framed = f" {word} "
        counts.update(framed[i : i + 2] for i in range(len(framed) - 1))
        counts.update(framed[i : i + 3] for i in range(len(framed) - 2))
    code = lambda g: sum((1 if c == " " else ord(c) + 1) << 21 * i for i, c in enumerate(reversed(g)))
    return [g for g, _ in sorted(counts.items(), key=lambda x: (-x[1], code(x[0])))]


def brute_profiles(rows, size):
    texts = {}
    for doc_id, text, lang in rows:
        held = doc_id is not None and zlib.crc32(str(doc_id).encode()) % 4 == 2
        if not held and lang is not None and text is not None:
            texts.setdefault(lang, []).append(text)
    grams = {lang: brute_grams("\n".join(t))[:size] for lang, t in texts.items()}
    return {lang: {g: i for i, g in enumerate(own)} for lang, own in grams.items() if own}


def brute_prediction(text, profiles, size):
    own = brute_grams(text)[:size]
    if not own or not profiles:
        return "und", 0.0
    distance = {
        lang: sum(abs(i - ranks[g]) if g in ranks else size for i, g in enumerate(own))
        for lang, ranks in profiles.items()
    }
    best = min(sorted(distance), key=distance.get)
    return best, 1 - distance[best] / (len(own) * size)


@pytest.mark.parametrize("size", [30, 400])
def test_against_a_plain_statement(spark, size):
    rows = [
        (r.doc_id, r.text, r.lang)
        for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()
    ]
    rows += [(1_000_000 + i, *r[1:3]) for i, r in enumerate(cases.ROWS)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    profiles = brute_profiles(rows, size)
    want = {d: brute_prediction(t, profiles, size) for d, t, _ in rows}
    got = langid.identify(docs.repartition(5), size).collect()
    assert len(got) == len(rows)
    for r in got:
        assert (r.lang_pred, pytest.approx(r.score)) == want[r.doc_id]
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2)


def test_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = langid.identify(docs).filter("held_out").join(docs.select("doc_id", "lang"), "doc_id")
    rows = got.collect()
    assert len(rows) > 200
    assert sum(r.lang_pred == r.lang for r in rows) / len(rows) > 0.97


def test_odd_rows(spark):
    docs = cases.clashing(spark, ["score", "lead", "lang_pred", "c0"])
    got = langid.identify(docs).collect()
    assert len(got) == len(cases.ROWS)
    nothing = [r for r in got if r.doc_id in (4, 5, 7, 8)]
    assert all((r.lang_pred, r.score) == ("und", 0.0) for r in nothing) and len(nothing) == 4
    assert all(0 <= r.score <= 1 for r in got)
    assert not any(r.held_out for r in got if r.doc_id is None)
    kept = langid.keep_identified(docs)
    assert kept.columns == docs.columns and kept.dtypes == docs.dtypes
    wordless = {4, 5, 7, 8}
    assert {r.doc_id for r in kept.collect()} == {r[0] for r in cases.ROWS} - wordless
    assert kept.count() == sum(r[1] is not None and r[0] not in wordless for r in cases.ROWS)


def test_no_rows_and_nothing_to_learn_from(spark):
    empty = cases.documents(spark, [])
    assert langid.identify(empty).count() == 0
    assert langid.keep_identified(empty).columns == empty.columns
    unlabelled = cases.documents(spark, [(1, cases.ENGLISH, None, "a", 1)])
    assert [tuple(r)[2:4] for r in langid.identify(unlabelled).collect()] == [("und", 0.0)]


def test_blocks_do_not_change_counts(monkeypatch):
    text = (cases.ENGLISH + " " + cases.GERMAN + "\n") * 5
    want = [x.tolist() for x in langid.gram_counts(text)]
    monkeypatch.setattr(langid, "_BLOCK_CHARS", 13)
    assert [x.tolist() for x in langid.gram_counts(text)] == want


def test_a_language_asked_for(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    german = langid.keep_identified(docs, languages=["de"])
    share = german.filter("lang = 'de'").count() / german.count()
    assert share > 0.95


def test_texts_far_from_every_profile_go(spark):
    """Nearest is not near: another alphabet, another language and encoded data have scores."""
    rnd = random.Random(3)
    other = [
        "Все люди рождаются свободными и равными в своем достоинстве и правах.",
        "Kaikki ihmiset syntyvät vapaina ja tasavertaisina arvoltaan ja oikeuksiltaan.",
        base64.b64encode(rnd.randbytes(3000)).decode(),
        rnd.randbytes(1500).hex(),
    ]
    clean = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang")
    junk = spark.createDataFrame([(-1 - i, x, None) for i, x in enumerate(other)], clean.schema)
    docs = clean.unionByName(junk)
    kept = {r.doc_id for r in langid.keep_identified(docs).select("doc_id").collect()}
    assert kept == {r.doc_id for r in clean.select("doc_id").collect()}
    assert langid.keep_identified(docs, min_score=0.0).count() == docs.count()
