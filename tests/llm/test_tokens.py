import random

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from presswork.llm import tokens
from tests.llm import cases

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


@pytest.fixture(scope="module")
def ours():
    return tokens.ByteBpe(PATH)


def wanted(library, texts):
    return [len(e.ids) for e in library.encode_batch(texts, add_special_tokens=False)]


def odd_texts():
    rnd = random.Random(3)
    letters = " \n\tabcXYZ'.,!0129éß漢̀\x1c\x85​　<|>end"
    made = ["".join(rnd.choices(letters, k=rnd.randint(0, 80))) for _ in range(3_000)]
    return [
        *made, "", " ", "\n", "don't I'll 's''s x's", "<|endoftext|>", "a<|endoftext|><|endoftext|>b<|endoftext|",
        "x\x1cy\x1d \x1f", "a\xa0b c d​e", "a" * 900, "你好世界" * 40, "١٢٣ ²³ Ⅷ", "﻿z", "a\x00b",
    ]


def test_odd_texts(library, ours):
    texts = odd_texts()
    assert ours.count_texts(texts) == wanted(library, texts)


@pytest.mark.parametrize("limit", ["_STRETCH", "_MEMO", "_MEMO_CHARS", "LONG"])
def test_limits_change_nothing(library, limit, monkeypatch):
    monkeypatch.setattr(tokens, limit, 12)
    ours = tokens.ByteBpe(PATH)
    texts = [*odd_texts()[:600], cases.LONG[:20_000]]
    assert ours.count_texts(texts) == wanted(library, texts)


def test_narrow_texts_are_cut_alike(ours):
    rnd = random.Random(6)
    letters = [chr(c) for c in range(256)] + [" "] * 60 + ["'s", "'ll", "\n\n"] * 5
    for _ in range(2_000):
        text = "".join(rnd.choices(letters, k=rnd.randint(0, 60)))
        assert ours.narrow.findall(text) == ours.pattern.findall(text)


def test_long_sequences(library, ours):
    rnd = random.Random(4)
    texts = ["".join(rnd.choices("abcdefgh", k=n)) for n in (3_000, 40_000)] + ["ab" * 20_000]
    assert ours.count_texts(texts) == wanted(library, texts)


def test_table(spark, library):
    docs = cases.clashing(spark, ["n_tokens", "n_bytes"])
    got = tokens.token_counts(docs, PATH, 100).collect()
    texts = [r[1] or "" for r in cases.ROWS]
    want = [
        (r[0], len(t.encode()), n, n > 100) for r, t, n in zip(cases.ROWS, texts, wanted(library, texts))
    ]
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)
    assert tokens.token_counts(cases.documents(spark, []), PATH).count() == 0


def test_whole_table(spark, library):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    texts = docs.collect()
    want = dict(zip((r.doc_id for r in texts), wanted(library, [r.text for r in texts])))
    assert {r.doc_id: r.n_tokens for r in tokens.token_counts(docs, PATH).collect()} == want


def test_other_vocabularies_are_refused():
    with pytest.raises(ValueError):
        tokens.ByteBpe(public_tokenizers.path("word_bpe_49k.json"))
