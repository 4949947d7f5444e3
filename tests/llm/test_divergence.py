import random
import re
from collections import Counter

import pytest

from presswork.llm import divergence
from presswork.llm.queries import QUERIES
from tests.compare import duck, compare
from presswork.llm.oracles import ORACLES
from tests.llm import cases

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows, min_docs=10, top=10):
    """The rule with every kept term for every source, in whole numbers."""
    out = []
    for lang in {r[2] or "" for r in rows}:
        docs = [(r[3] or "", TERM.findall((r[1] or "").translate(LOWER))) for r in rows if (r[2] or "") == lang]
        held = Counter(t for _, found in docs for t in set(found))
        kept = [t for t, n in held.items() if n >= min_docs]
        sources = sorted({s for s, _ in docs}, key=str.encode)
        of = {s: Counter(t for x, found in docs if x == s for t in found) for s in sources}
        all_ = Counter(t for _, found in docs for t in found)

        def shares(counts):
            total = sum(counts[t] for t in kept)
            return {t: 1 + 10**9 * (counts[t] + 2) // (total + 2 * len(kept)) for t in kept}

        def f(p, q):
            return (p - q) ** 2 // (p + q)

        p = {s: shares(of[s]) for s in sources}
        q = shares(all_)
        for s in sources:
            pairs = [(x, sum(f(p[s][t], p[x][t]) for t in kept)) for x in sources if x != s]
            pairs.sort(key=lambda r: (-r[1], r[0].encode()))
            words = [(t, f(p[s][t], q[t])) for t in kept if of[s][t] and p[s][t] > q[t]]
            words.sort(key=lambda r: (-r[1], r[0].encode()))
            out += [(lang, s, "pair", *r, i) for i, r in enumerate(pairs, 1)]
            out += [(lang, s, "term", *r, i) for i, r in enumerate(words[:top], 1)]
    return sorted(out)


def made_rows():
    rnd = random.Random(11)
    words = ["Ab", "ab", "ÄB", "äb", "c9d", "e-f", "日本", "zz", "Q", "r_s", "ta\x00ta", "naïve"]
    rows = []
    for i in range(400):
        source = rnd.choice(["s1"] * 6 + ["s2", "s3", "S4", "ß", None, ""])
        mine = words[: 4 + len(source or "")] + [f"w{rnd.randint(0, 30)}x" for _ in range(3)]
        rows.append((i, " ".join(rnd.choices(mine, k=rnd.randint(0, 30))), rnd.choice(["en", "de"]), source, 0))
    rows += rows[:50]
    return rows + [(900, None, "en", "none", 0), (901, "123", "xx", "a", 0), (902, "", "xx", "b", 0),
                   (903, "one two", None, None, 0)]


def rows_of(df):
    return sorted(map(tuple, df.collect()))


@pytest.mark.parametrize("rows", [cases.ROWS, made_rows()])
def test_against_brute_force(spark, rows):
    docs = cases.clashing(spark, ["term", "item", "rank", "place", "n", "value"], rows)
    assert rows_of(divergence.source_divergence(docs)) == brute(rows)


def test_small_limits_change_nothing(spark, monkeypatch):
    monkeypatch.setattr(divergence, "HELD", 20)
    monkeypatch.setattr(divergence, "ENTRIES_PER_TASK", 10)
    monkeypatch.setattr(divergence, "SOURCES_PER_BLOCK", 2)
    rows = made_rows()
    docs = cases.documents(spark, rows)
    assert rows_of(divergence.source_divergence(docs, 3, 4)) == brute(rows, 3, 4)


def test_no_documents(spark):
    assert divergence.source_divergence(cases.documents(spark, [])).count() == 0


def test_large_counts_stay_exact(spark):
    n = 9 * 10**17
    row = spark.createDataFrame([(n, n, 5)], "n long, total long, kinds long")
    got = row.select(divergence.share(row.n, row.total, row.kinds)).first()[0]
    assert got == 1 + 10**9 * (n + 2) // (n + 10)


def test_terms(monkeypatch):
    text = "Don't STOP\tÉté été A_b x1y ÀÉ\n日本!".encode()
    want = [b"don", b"t", b"stop", "Été".encode(), "été".encode(), b"a", b"b", b"x", b"y",
            "ÀÉ".encode(), "日本".encode()]
    assert [t for part in divergence.terms(text) for t in part] == want
    monkeypatch.setattr(divergence, "BLOCK_BYTES", 3)
    assert [t for part in divergence.terms(text) for t in part] == want
    assert divergence.count_text(b"a A b") == {b"a": 2, b"b": 1}


def test_query_against_sql(spark):
    sf = "/root/testdata/sf0.001"
    got = QUERIES["op12_source_divergence"](spark, sf)
    assert compare(got, duck(sf), ORACLES["op12_source_divergence"]) is None
