"""Recommendations against the rule for one user at a time."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from presswork.operators import recommend
from presswork.operators.joins import top_per_group

START = datetime(2024, 3, 1)


def page_for(slots, articles, limit, page, seen, user):
    """``slots``: (category, number) of the user's categories in order of preference."""
    skip = (page - 1) * limit
    newest = sorted((a for a in articles if a[4] and not a[5]), key=lambda a: (-a[3].timestamp(), a[0]))
    if not slots:
        return [a[0] for a in newest[skip : skip + limit]]
    piles = []
    for category, n in slots:
        pile = [a[0] for a in newest if a[2] == category and (user, a[0]) not in seen]
        piles.append(pile[skip : skip + n])
    longest = max(map(len, piles))
    return [pile[i] for i in range(longest) for pile in piles if i < len(pile)]


@pytest.fixture(scope="module")
def world(spark):
    rnd = random.Random(3)
    articles = [
        (i, rnd.randint(1, 6), rnd.choice([1, 1, 1, 2, 3]), START + timedelta(minutes=rnd.randint(0, 400)),
         rnd.random() < 0.9, rnd.random() < 0.2)
        for i in range(400)
    ]
    prefs = [
        (u, c, rnd.randint(1, 10)) for u in range(30) if u % 6 for c in (1, 2, 3, 4) if rnd.random() < 0.7
    ]
    seen = {(u, a) for u in range(30) for a in rnd.sample(range(400), rnd.choice([0, 5, 120, 390]))}
    df = spark.createDataFrame(
        articles,
        "article_id long, source_id int, category_id int, published_at timestamp_ntz, "
        "is_processed boolean, is_duplicate boolean",
    ).select("*", F.lit("t").alias("title"), F.lit("d").alias("description"), F.lit("u").alias("url"))
    return {
        "articles": articles, "prefs": prefs, "seen": seen,
        "df": df,
        "categories": spark.createDataFrame([(c, f"c{c}") for c in (1, 2, 3, 4)], "category_id int, name string"),
        "sources": spark.createDataFrame([(s, 1, f"s{s}_x") for s in range(1, 7)], "source_id int, category_id int, name string"),
        "users": spark.range(30).withColumnRenamed("id", "user_id"),
        "prefs_df": spark.createDataFrame(prefs, "user_id long, category_id int, weight int"),
        "seen_df": spark.createDataFrame(sorted(seen), "user_id long, article_id long"),
    }


def got_pages(w, **options):
    rows = recommend.recommend(
        w["df"], w["categories"], w["sources"], w["users"], w["prefs_df"], **options
    ).select("user_id", "position", "article_id").collect()
    pages = {}
    for r in sorted(rows, key=lambda r: (r.user_id, r.position)):
        assert r.position == len(pages.setdefault(r.user_id, [])) + 1
        pages[r.user_id].append(r.article_id)
    return pages


def want_pages(w, limit, page, seen=frozenset()):
    # How many of each category is checked by itself below.
    slots = {}
    for r in recommend.allocation(w["prefs_df"], limit).orderBy("user_id", "pref_rank").collect():
        slots.setdefault(r.user_id, []).append((r.category_id, r.slots))
    pages = {
        u: page_for(slots.get(u, []), w["articles"], limit, page, seen, u) for u in range(30)
    }
    return {u: p for u, p in pages.items() if p}


@pytest.mark.parametrize("limit, page", [(1, 1), (9, 1), (12, 2), (50, 1), (50, 3)])
def test_pages(world, limit, page):
    assert got_pages(world, limit=limit, page=page) == want_pages(world, limit, page)


@pytest.mark.parametrize("group_limit", [1000, 8])
@pytest.mark.parametrize("limit, page", [(9, 1), (12, 2)])
def test_pages_without_seen(world, monkeypatch, group_limit, limit, page):
    """A small first depth makes users who have seen nearly everything take several rounds."""
    monkeypatch.setattr(recommend, "GROUP_LIMIT", group_limit)
    got = got_pages(world, limit=limit, page=page, seen=world["seen_df"])
    assert got == want_pages(world, limit, page, world["seen"])


def test_joins_by_shuffle_give_the_same(world, monkeypatch):
    from presswork.operators import joins

    monkeypatch.setattr(joins, "BROADCAST_ROWS", 0)
    monkeypatch.setattr(joins, "is_small", lambda df: False)
    assert got_pages(world, limit=9) == want_pages(world, 9, 1)


def test_allocation_examples(spark):
    prefs = spark.createDataFrame(
        [(1, 1, 9), (1, 2, 6), (1, 3, 3), (2, 7, 4), (3, 1, 1), (3, 2, 1), (3, 3, 1)],
        "user_id long, category_id int, weight int",
    )

    def got(limit):
        rows = recommend.allocation(prefs, limit).orderBy("user_id", "pref_rank").collect()
        return [[r.slots for r in rows if r.user_id == u] for u in (1, 2, 3)]

    assert got(12) == [[6, 4, 2], [12], [4, 4, 4]]
    assert got(9) == [[4, 3, 2], [9], [3, 3, 3]]
    assert got(1)[2] == [1, 1, 0]  # at least one each, even past the limit


def test_allocation_rules(spark):
    """Order, floor of one, proportion and remainder, for many weights."""
    rnd = random.Random(9)
    people = {u: [(c, rnd.randint(1, 10)) for c in range(1, rnd.randint(2, 6))] for u in range(400)}
    prefs = spark.createDataFrame(
        [(u, c, w) for u, ps in people.items() for c, w in ps], "user_id long, category_id int, weight int"
    )
    for limit in (1, 2, 7, 12, 50):
        got = {}
        for r in recommend.allocation(prefs, limit).orderBy("user_id", "pref_rank").collect():
            got.setdefault(r.user_id, []).append(r)
        assert set(got) == set(people)
        for u, rows in got.items():
            total = sum(w for _, w in people[u])
            order = [(-r.weight, r.category_id) for r in rows]
            assert order == sorted((-w, c) for c, w in people[u])
            for r in rows[:-1]:
                assert r.slots >= 1 and (r.slots == 1 or abs(r.slots - limit * r.weight / total) <= 0.5)
            used = sum(r.slots for r in rows)
            assert rows[-1].slots >= 0 and (used == limit or (rows[-1].slots == 0 and used > limit))


def test_allocation_halves(spark):
    """Halves go to the even neighbour: 2.5 to 2, 3.5 to 4, 0.5 to the floor of one."""
    prefs = spark.createDataFrame(
        [(1, 1, 5), (1, 2, 5), (2, 1, 7), (2, 2, 7), (3, 1, 9), (3, 2, 1)],
        "user_id long, category_id int, weight int",
    )

    def got(user, limit):
        rows = recommend.allocation(prefs, limit).filter(F.col("user_id") == user)
        return [r.slots for r in rows.orderBy("pref_rank").collect()]

    assert got(1, 5) == [2, 3] and got(2, 7) == [4, 3] and got(1, 1) == [1, 0]
    assert got(3, 5) == [4, 1] and got(3, 1) == [1, 0]


def test_seen_id_lists(spark):
    lists = [(1, "1,2"), (2, "1,,2"), (3, "1,x"), (4, None), (5, ""), (6, " 7 , 8")]
    df = spark.createDataFrame(lists, "user_id long, exclude_ids string")
    got = sorted(map(tuple, recommend.parse_seen_ids(df).collect()))
    assert got == [(1, 1), (1, 2), (2, 1), (2, 2), (6, 7), (6, 8)]


def test_top_per_group_past_the_limit(spark):
    df = spark.range(5000).select((F.col("id") % 3).alias("k"), F.hash("id").alias("v"))
    deep = top_per_group(df, ["k"], [F.asc("v")], 1500)
    plain = top_per_group(df, ["k"], [F.asc("v")], 900)
    assert deep.filter("rn <= 900").exceptAll(plain).count() == 0
    assert deep.count() == 4500


def test_unseen_ranks(spark):
    """The n-th rank that is not in the list of seen ones."""
    cases = [([], 12), ([1, 2, 3], 12), ([2, 3, 7, 12], 12), ([12], 3), (None, 5), (list(range(1, 12)), 2)]
    df = spark.createDataFrame([(i, s, n) for i, (s, n) in enumerate(cases)], "i int, seen array<int>, n int")
    got = df.withColumn("unseen_before", recommend._unseen_before(F.col("seen"))).select(
        "i", F.explode(F.sequence(F.lit(1), "n")).alias("k"), "unseen_before"
    ).withColumn("rank", recommend._unseen_rank(F.col("k")))
    ranks = {}
    for r in got.orderBy("i", "k").collect():
        ranks.setdefault(r.i, []).append(r["rank"])
    for i, (seen, n) in enumerate(cases):
        assert ranks[i] == [r for r in range(1, 100) if r not in (seen or [])][:n]
