import random

from pyspark.sql import functions as F

from presswork.functions import text
from presswork.operators.chunking import chunk_articles


def run_chunks(spark, texts, size=200, keep=30):
    df = spark.createDataFrame(list(enumerate(texts)), "id int, t string").repartition(4)
    got = df.select("id", text.chunk_text(F.col("t"), size, keep).alias("c")).collect()
    return [list(r.c) for r in sorted(got, key=lambda r: r.id)]


def test_chunk_edges(spark):
    """Worked by hand with 200 characters and an overlap of 30."""
    word = "x" * 199
    loop = ("no final period " * 30).strip()
    smile = "emoji 😀😀."
    cases = {
        "": [],
        "  \n　 ": [],
        "a" * 200: ["a" * 200],
        # Windows begin 170 apart: 0-200, 170-201.
        "a" * 201: ["a" * 200, "a" * 31],
        # The second sentence fits with no other but is led by the tail of the first.
        word + ". " + word + ". tail": [
            word + ".",
            "x" * 29 + ". " + word + ".",
            "x" * 29 + ". tail",
        ],
        "Short one. Short two! Short three? End": ["Short one. Short two! Short three? End"],
        # A full stop without white space behind it ends nothing.
        "一つ目。 二つ目。　三つ目。四つ目": ["一つ目。 二つ目。 三つ目。四つ目"],
        "a." + " " + "b. c": ["a. b. c"],
        "x" * 120 + ". " + "y" * 90 + ".": [
            "x" * 120 + ".",
            "x" * 29 + ". " + "y" * 90 + ".",
        ],
        loop: [loop[0:200].strip(), loop[170:370].strip(), loop[340:].strip()],
        "One.\n\nTwo.\tThree.  Four.": ["One. Two. Three. Four."],
        "\x1cleading separator. trailing\x1f": ["leading separator. trailing"],
        # Twenty sentences of nine characters and their blanks are 199; the tail of 30
        # holds three of them, so ten new ones make thirteen.
        (smile + " ") * 30: [" ".join([smile] * 20), " ".join([smile] * 13)],
    }
    assert run_chunks(spark, list(cases)) == list(cases.values())


def test_exact_boundaries(spark):
    one, two, three = run_chunks(spark, ["a" * 200, "a" * 201, "a" * 371])
    assert [len(c) for c in one] == [200]
    assert [len(c) for c in two] == [200, 31]
    assert [len(c) for c in three] == [200, 200, 31]


def test_overlap_lead_may_pass_the_limit(spark):
    first, second = "a" * 150 + ".", "b" * 199 + "."
    (chunks,) = run_chunks(spark, [f"{first} {second}"])
    assert [len(c) for c in chunks] == [151, 30 + 1 + 200]


def bare(t):
    return "".join(t.split())


def test_random_texts(spark):
    """What every chunking must hold to, whatever the text."""
    rnd = random.Random(7)
    alphabet = ["a", "bc", "。", ".", "!", " ", "  ", "\n", "　", "long" * 13, "long. ", "é"]
    texts = ["".join(rnd.choices(alphabet, k=rnd.randint(0, 120))) for _ in range(300)]
    size, keep = 60, 12
    for t, chunks in zip(texts, run_chunks(spark, texts, size, 0)):
        # Without overlap nothing is lost, repeated or too long.
        assert bare("".join(chunks)) == bare(t)
        assert all(0 < len(c) <= size and c == c.strip() for c in chunks)
    led = 0
    for t, chunks in zip(texts, run_chunks(spark, texts, size, keep)):
        assert bool(chunks) == bool(bare(t))
        for before, chunk in zip(["", *chunks], chunks):
            assert chunk and chunk == chunk.strip()
            if len(chunk) > size:  # only the tail of the chunk before can make it longer
                assert chunk.startswith(before[-keep:].strip()) and len(chunk) <= size + keep + 1
                led += 1
            assert bare(chunk) in bare(t) or chunk.startswith(before[-keep:].strip())
    assert led > 3


def test_short_chunks_leave_index_gaps(spark):
    df = spark.createDataFrame(
        [(1, "T", "b" * 300 + ". tiny."), (2, "Title only", None), (3, "Just a title here", "")],
        "article_id long, title string, description string",
    )
    rows = sorted((r.article_id, r.chunk_index, r.content) for r in chunk_articles(df).collect())
    # Article 1: "T." stands alone as chunk 0 and is too short.
    assert [r[:2] for r in rows if r[0] == 1] == [(1, 1), (1, 2)]
    assert [r for r in rows if r[0] > 1] == [(3, 0, "Just a title here")]


def test_clean_html(spark):
    cases = {
        "<b>Hi</b> there": "Hi there",
        "  <p>x\n</p>　": "x",
        "a < b and c > d": "a  d",
        "<>": "<>",
        "1 < 2": "1 < 2",
        "<br/\n>line": "line",
        None: "",
        "\x1c\x85 y  ": "y",
    }
    df = spark.createDataFrame([(k,) for k in cases], "t string")
    got = {r.t: r.c for r in df.select("t", text.clean_html(F.col("t")).alias("c")).collect()}
    assert got == cases


def test_publisher(spark):
    df = spark.createDataFrame([("Daily_Economy",), ("Daily",), ("_x",)], "n string")
    assert [r[0] for r in df.select(text.publisher(F.col("n"))).collect()] == ["Daily", "Daily", ""]
