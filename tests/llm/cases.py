"""Small document tables with everything that may go wrong in them."""

from pyspark.sql import types as T

SCHEMA = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("text", T.StringType()),
        T.StructField("lang", T.StringType()),
        T.StructField("source", T.StringType()),
        T.StructField("n_chars", T.LongType()),
    ]
)
ENGLISH = "the cat sat on the mat and looked at the old dog near the warm fire all day long"
GERMAN = "der Hund lag auf der Matte und sah die alte Katze neben dem warmen Ofen den ganzen Tag"
LONG = " ".join(f"word{i % 9973} sentence{i % 89}." for i in range(60_000))

ROWS = [
    (1, ENGLISH, "en", "a", 80),
    (2, ENGLISH, "en", "a", 80),
    (2, ENGLISH, "en", "a", 80),
    (3, GERMAN, "de", "b", 88),
    (4, None, "en", "a", None),
    (5, "", None, "a", 0),
    (None, "x", "en", None, 1),
    (None, None, None, None, None),
    (7, "123 456 !!! ...", "de", "b", 15),
    (8, "  \t\n ", "en", "a", 5),
    (9, LONG, "en", "c", len(LONG)),
    (10, "naïve Ωmega 漢字 🤦🏼‍♂️ İx ŉ", None, "c", 20),
    (-11, ENGLISH.upper(), "en", "a", 80),
]


def documents(spark, rows=ROWS):
    return spark.createDataFrame(rows, SCHEMA)


def clashing(spark, names, rows=ROWS):
    """The same with extra columns of the given names."""
    df = documents(spark, rows)
    for i, name in enumerate(names):
        df = df.withColumn(name, df["doc_id"] * 0 + i)
    return df


def as_set(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)
