import hashlib
import random

import public_tokenizers
import pytest
import sentencepiece

from presswork.llm import pieces
from presswork.llm.queries import QUERIES
from tests.llm import cases

PATH = public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=PATH)


@pytest.fixture(scope="module")
def ours():
    return pieces.PieceModel(PATH)


def library_pieces(library, text):
    """(id, begin byte, end byte) of each piece."""
    found = library.encode(text, out_type="serialized_proto")
    rows = [dict(pieces.proto_fields(v)) for n, v in pieces.proto_fields(found) if n == 2]
    return [(r.get(2, 0), r.get(4, 0), r.get(5, 0)) for r in rows]


def odd_texts(n=1_500):
    rnd = random.Random(1)
    letters = " \n\tabcXYZ'.,!0129éß漢́\x1c\x85​　<|>end▁  the and\x00🤦🏼"
    made = ["".join(rnd.choices(letters, k=rnd.randint(0, 60))) for _ in range(n)]
    spaced = [" " * i + "the" + " " * (40 - i) for i in range(40)]
    return [*made, *spaced, "", " ", "▁", "<s>", "<0x41>", "</s><unk>", "a" * 300, "你好世界" * 40, "﻿z"]


def test_pieces_and_spans(library, ours):
    for text in odd_texts():
        ids, begins, ends = ours.encode(text.encode())
        assert list(zip(ids.tolist(), begins.tolist(), ends.tolist())) == library_pieces(library, text)
        assert ours.decode(ids.tolist()) == library.decode(ids.tolist())


def test_spans_cover_the_text(ours):
    for text in odd_texts(300):
        raw = text.encode()
        _, begins, ends = ours.encode(raw)
        assert b"".join(raw[a:b] for a, b in zip(begins, ends)) == raw


@pytest.mark.parametrize("limit", ["_STRETCH", "_MEMO", "_SHORT"])
def test_limits_change_nothing(library, limit, monkeypatch):
    monkeypatch.setattr(pieces, limit, 5)
    small = pieces.PieceModel(PATH)
    for text in [*odd_texts(300), cases.LONG[:30_000]]:
        ids, begins, ends = small.encode(text.encode())
        assert list(zip(ids.tolist(), begins.tolist(), ends.tolist())) == library_pieces(library, text)


def test_any_ids_decode(library, ours):
    rnd = random.Random(2)
    signs = [ours.id_of["▁"], ours.id_of["▁▁"], ours.id_of["▁the"]]
    for _ in range(2_000):
        ids = [
            rnd.choice([rnd.randrange(32_000), rnd.randrange(3), rnd.randrange(3, 259), rnd.choice(signs)])
            for _ in range(rnd.randint(0, 12))
        ]
        assert ours.decode(ids) == library.decode(ids)
    with pytest.raises(ValueError):
        ours.decode([32_000])


@pytest.mark.parametrize("rule", ["nmt_nfkc", "nfkc", "nmt_nfkc_cf", "nfkc_cf", "identity"])
@pytest.mark.parametrize("extra", [True, False])
def test_compiled_character_maps(rule, extra):
    """Longest-prefix normalisation and its sources, against the library's own maps."""
    theirs = sentencepiece.SentencePieceNormalizer(
        rule_name=rule, add_dummy_prefix=True, escape_whitespaces=True, remove_extra_whitespaces=extra
    )
    spec = dict(pieces.proto_fields(theirs.serialized_model_proto()))[3]
    ours = pieces.Normalizer(spec)
    rnd = random.Random(3)
    letters = " \n\tabcXYZ'.,!09éß漢́\x1c\x85​　ﬁ①Å̊ÅA̧　  가ㄱㅏ™½…ｶﾞ🤦🏼▁"
    for _ in range(600):
        text = "".join(rnd.choices(letters, k=rnd.randint(0, 30)))
        raw = text.encode()
        normal, source = ours.normalize(raw)
        want, places = theirs.normalize(text, with_offsets=True)
        assert normal.decode() == want
        starts, at = [], 0
        for c in want:
            starts.append(at)
            at += len(c.encode())
        assert [len(raw[: source[i]].decode()) for i in [*starts, at]] == list(places)


def test_table(spark, library):
    docs = cases.clashing(spark, ["ids", "begins", "ends", "decoded"])
    encoded = pieces.encode(docs, PATH)
    assert encoded.columns == [*cases.SCHEMA.names, "decoded", "ids", "begins", "ends"]
    got = pieces.decode(encoded, PATH).collect()
    assert len(got) == len(cases.ROWS)
    for r in got:
        assert list(zip(r.ids, r.begins, r.ends)) == library_pieces(library, r.text or "")
        assert r.decoded == library.decode(r.ids)
    assert pieces.encode(cases.documents(spark, []), PATH).count() == 0
    odd = spark.createDataFrame([([1, None, 3],), (None,)], "ids array<int>")
    assert [r.decoded for r in pieces.decode(odd, PATH).collect()] == [library.decode([1, 0, 3]), None]


def test_query_on_a_whole_table(spark, library):
    sf = "/root/testdata/sf0.01"
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}

    def digest(text):
        return hashlib.sha256(text.encode()).hexdigest()

    got = QUERIES["op13_pieces"](spark, sf).collect()
    assert len(got) == len(texts)
    for r in got:
        ids = library.encode(texts[r.doc_id])
        wanted = (len(ids), digest(",".join(map(str, ids))), digest(library.decode(ids)))
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == wanted
        assert r.n_bytes == len(texts[r.doc_id].encode())


def test_query_on_odd_rows(spark, library, tmp_path):
    cases.documents(spark).write.parquet(f"{tmp_path}/documents.parquet")
    got = QUERIES["op13_pieces"](spark, str(tmp_path)).collect()
    lengths = sorted(len(library.encode(r[1] or "")) for r in cases.ROWS)
    assert sorted(r.n_tokens for r in got) == lengths


def test_other_models_are_refused(tmp_path):
    empty = tmp_path / "x.model"
    empty.write_bytes(b"")
    with pytest.raises(ValueError):
        pieces.PieceModel(str(empty))
