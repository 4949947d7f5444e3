import itertools
import random
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from presswork.llm import common, simhash
from presswork.llm.components import components
from tests.llm import cases


def brute_fingerprint(text):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", lower)
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(prints):
    """Smallest doc_id per row of (doc_id, fingerprint), by all pairs."""
    group = list(range(len(prints)))
    for i, j in itertools.combinations(range(len(prints)), 2):
        if bin(prints[i][1] ^ prints[j][1]).count("1") <= 3:
            a, b = group[i], group[j]
            group = [a if g == b else g for g in group]
    least = {}
    for g, (doc, _) in zip(group, prints):
        if doc is not None:
            least[g] = min(doc, least.get(g, doc))
    return [least.get(g) for g in group]


def expected(rows):
    prints = [(r[0], brute_fingerprint(r[1])) for r in rows]
    named = brute_components(prints)
    return sorted(((d, f"{p:016x}", c) for (d, p), c in zip(prints, named)), key=repr)


def test_fingerprint_and_components_of_odd_rows(spark):
    got = simhash.near_duplicates(cases.clashing(spark, ["fp", "root", "u", "v", "component_id"]))
    got = cases.as_set(got.select("doc_id", "fingerprint", "component_id"))
    assert got == expected(cases.ROWS)


def test_whole_small_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    got = simhash.near_duplicates(docs).select("doc_id", "fingerprint", "component_id")
    want = expected(rows)
    assert cases.as_set(got) == want
    assert len({c for _, _, c in want}) < len(want)


def test_no_rows(spark):
    empty = cases.documents(spark, [])
    assert simhash.near_duplicates(empty).count() == 0
    assert simhash.keep_one_of_each(empty).schema == empty.schema


@pytest.mark.parametrize("size", [1, 4, 20, 1 << 22])
def test_blocks_do_not_change_a_fingerprint(size, monkeypatch):
    text = " ".join(f"w{i % 17}" for i in range(300)).encode()
    want = simhash.fingerprint(text)
    monkeypatch.setattr(simhash, "word_blocks", lambda raw: common.word_blocks(raw, size))
    monkeypatch.setattr(simhash, "_HASHES_AT_ONCE", 7)
    assert simhash.fingerprint(text) == want


def near_values(n, seed, flips=4):
    rnd = random.Random(seed)
    centres = [rnd.getrandbits(64) for _ in range(3)]
    values = set()
    while len(values) < n:
        v = rnd.choice(centres)
        for _ in range(rnd.randint(0, flips)):
            v ^= 1 << rnd.randrange(64)
        values.add(v)
    return sorted(values)


@pytest.mark.parametrize("at_once", [3, 1 << 18])
def test_trie_pairs_are_all_near_pairs(at_once, monkeypatch):
    monkeypatch.setattr(simhash, "_PAIRS_AT_ONCE", at_once)
    values = near_values(250, 5)
    bits = np.array(values, np.uint64)
    found = simhash.trie_pairs(bits, np.array([0, 120]), np.array([120, 250]), 64, 3)
    got = sorted((int(i), int(j)) for a, b in found for i, j in zip(a, b))
    want = [
        (i, j)
        for i, j in itertools.combinations(range(250), 2)
        if (i < 120) == (j < 120) and bin(values[i] ^ values[j]).count("1") <= 3
    ]
    assert got == want and len(want) > 100


@pytest.mark.parametrize("tile", [20, 10_000])
def test_links_connect_what_is_near(spark, tile):
    """Also if a subtree is cut into tiles."""
    values = near_values(400, 9, flips=7)
    signed = [(v - (1 << 64) if v >> 63 else v,) for v in values]
    links = simhash.near_links(spark.createDataFrame(signed, "fp long"), tile=tile)
    root = {r.node: r.root for r in components(links).collect()}
    got = {}
    for v, (s,) in zip(values, signed):
        got.setdefault(root.get(s, s), set()).add(v)
    named = brute_components(list(zip(range(400), values)))
    want = {}
    for v, c in zip(values, named):
        want.setdefault(c, set()).add(v)
    assert sorted(map(sorted, got.values())) == sorted(map(sorted, want.values()))


def test_one_of_each_stays(spark):
    rows = [*cases.ROWS, (20, cases.ENGLISH + " ", "xx", "z", 3), (None, "x", "en", None, 1)]
    docs = cases.clashing(spark, ["doc_key", "text_mark", "root"], rows)
    got = simhash.keep_one_of_each(docs)
    assert got.columns == docs.columns and got.schema == docs.schema
    kept = got.collect()
    prints = [(r[0], brute_fingerprint(r[1])) for r in rows]
    groups = len({(c, None) if c is not None else (None, p) for c, (_, p) in zip(brute_components(prints), prints)})
    assert len(kept) == groups
    ids = {r.doc_id for r in kept}
    assert {-11, 3, 9, 10} <= ids and not {1, 2, 20} & ids


def test_components_of_chains_stars_and_loops(spark):
    chain = [(i, i + 1) for i in range(300)]
    star = [(1_000, 1_001 + i) for i in range(200)]
    odd = [(5_000, 5_000), (None, 7), (7, None), (6_001, 6_000), (6_000, 6_001)]
    links = spark.createDataFrame(chain + star + odd, "u long, v long")
    got = {r.node: r.root for r in components(links).collect()}
    want = {i: 0 for i in range(1, 301)} | {1_001 + i: 1_000 for i in range(200)} | {6_001: 6_000}
    assert got == want
    assert components(links.filter(F.lit(False))).count() == 0
