import itertools
import random
import re

import numpy as np
import pytest

from presswork.llm import interaction
from presswork.llm.queries import QUERIES
from tests.llm import cases

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute_mask(rows, doc_id, text):
    text = text or ""
    words = WORD.findall(text)
    capitals = sum("A" <= c <= "Z" for c in text)
    return (
        (len(words) < 100)
        + 2 * (100 * len(set(words)) < 80 * len(words))
        + 4 * (100 * capitals > 10 * len(text))
        + 8 * any(c in "#$%&*|" for c in text)
        + 16 * any(
            None not in (r[0], doc_id) and r[0] < doc_id and (r[1] or "") == text for r in rows
        )
    )


def brute_audit(rows, labels):
    """The rule by running every order of the filters over every part."""
    good = {i for i, q, _ in labels if q == 1 and i is not None}
    toxic = {i for i, _, t in labels if t == 1 and i is not None}
    out = []
    for part in {r[2] or "" for r in rows}:
        mine = [(r[0], brute_mask(rows, r[0], r[1])) for r in rows if (r[2] or "") == part]
        steps, share = [], dict.fromkeys("ABCDE", 0)
        for order in itertools.permutations("ABCDE"):
            left = mine
            for step, letter in enumerate(order, 1):
                bit = 1 << "ABCDE".index(letter)
                gone = [r for r in left if r[1] & bit]
                left = [r for r in left if not r[1] & bit]
                fails = sum(1 for r in mine if r[1] & bit)
                alone = sum(1 for r in mine if r[1] == bit)
                share[letter] += len(gone)
                steps.append(
                    (part, "".join(order), step, len(left), len(gone), fails - len(gone), alone,
                     sum(r[0] in good for r in gone), sum(r[0] in toxic for r in gone), letter)
                )
        out += [(*s[:-1], share[s[-1]]) for s in steps]
    return sorted(out)


def labels_frame(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")


def odd_rows():
    rnd = random.Random(5)
    words = ["alpha", "BETA", "gamma", "Delta", "x$", "ÄÖ", "n"]
    made = []
    for i in range(120):
        text = " ".join(rnd.choices(words, k=rnd.choice([3, 99, 100, 130])))
        made.append((rnd.randint(0, 80), text, rnd.choice(["en", "de", None, ""]), "s", 0))
    spread = [f"w{i}" for i in range(125)]
    return [*made, *made[:20], (200, " ".join(spread[:100]), "en", "s", 0),
            (201, " ".join(spread[:100]), "de", "s", 0), (None, " ".join(spread[:100]), "en", "s", 0),
            (202, " ".join(spread[:80] + ["w0"] * 20), "en", "s", 0),
            (203, " ".join(spread[:79] + ["w0"] * 21), "en", "s", 0)]


LABELS = [(1, 1, 0), (2, 0, 1), (2, 1, 0), (3, None, 1), (7, 1, 1), (None, 1, 1), (200, 1, 0), (999, 1, 1)]


@pytest.mark.parametrize("rows", [cases.ROWS, odd_rows()])
def test_audit_against_running_every_order(spark, rows):
    docs = cases.clashing(spark, ["part", "mask", "digest", "n", "times"], rows)
    got = interaction.audit_documents(docs, labels_frame(spark, LABELS))
    assert sorted(map(tuple, got.collect())) == brute_audit(rows, LABELS)


def test_whole_small_table(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    labels = [tuple(r) for r in spark.read.parquet(f"{SF}/labels.parquet").collect()]
    got = QUERIES["op11_filter_audit"](spark, SF)
    assert sorted(map(tuple, got.collect())) == brute_audit(rows, labels)


def test_no_documents_and_no_labels(spark):
    none = labels_frame(spark, [])
    assert interaction.audit_documents(cases.documents(spark, []), none).count() == 0
    got = interaction.audit_documents(cases.documents(spark), none).collect()
    assert len(got) == 600 * 3 and not any(r.good_lost or r.toxic_lost for r in got)


def test_walk_toggles_one_filter_at_a_time():
    for k in range(1, 9):
        subsets = [0, *(s for _, s in interaction.gray_walk(k))]
        assert sorted(subsets) == list(range(1 << k))
        assert all((a ^ b).bit_count() == 1 for a, b in zip(subsets, subsets[1:]))


def test_states_against_counting_each_subset():
    rnd = np.random.default_rng(2)
    for k in (1, 3, 5, 7):
        masks = np.arange(1 << k)
        counts = rnd.integers(0, 1 << 40, (1 << k, 3))
        states = interaction.survivor_states(masks, counts, k)
        for subset in range(1 << k):
            assert (states[subset] == counts[masks & subset == 0].sum(axis=0)).all()


def test_other_sets_of_filters(spark):
    counted = spark.createDataFrame(
        [("p", 0, 5, 1, 0), ("p", 1, 3, 0, 1), ("p", 3, 2, 1, 1)],
        "part string, mask int, n long, good long, toxic long",
    )
    got = {(r.filter_order, r.step): r for r in interaction.audit(counted, "XY").collect()}
    assert (got["XY", 1].removed, got["XY", 2].removed, got["XY", 2].redundant) == (5, 0, 2)
    assert (got["YX", 1].removed, got["YX", 2].removed, got["YX", 2].shapley) == (2, 3, 8)
    for names in ("", "XX", "ABCDEFGHI"):
        with pytest.raises(ValueError):
            interaction.audit(counted, names)
    with pytest.raises(Exception, match="more filters"):
        interaction.audit(counted, "X").collect()


def test_long_text_in_blocks(monkeypatch):
    text = " ".join(f"w{i % 300}" for i in range(2_000)).encode()
    want = interaction.text_failures(text)
    monkeypatch.setattr("presswork.llm.common.BLOCK_BYTES", 64)
    assert interaction.text_failures(text) == want == 2
