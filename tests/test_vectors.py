import math

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from presswork.functions import vectors
from presswork.functions.encoder import EncoderSpec, HashedNgrams, embed
from presswork.operators.similarity import unit_rows


def test_parse_vector(spark):
    cases = ["[1,2.5,-3e-1]", "[ 1 , 2 ]", "1,2", "", "[]", None, "[1,x]", "[1,,2]"]
    want = [[1.0, 2.5, -0.3], [1.0, 2.0], [1.0, 2.0], None, None, None, None, None]
    df = spark.createDataFrame([(i, c) for i, c in enumerate(cases)], "i int, t string")
    got = df.select("i", vectors.parse_vector(F.col("t")).alias("v")).orderBy("i").collect()
    for row, w in zip(got, want):
        assert (row.v is None) == (w is None)
        if w is not None:
            assert np.allclose(row.v, w)


def test_round_trip_and_norms(spark):
    df = spark.createDataFrame([([3.0, 4.0], [0.0, 0.0])], "v array<float>, z array<float>")
    row = df.select(
        vectors.parse_vector(vectors.format_vector(F.col("v"))).alias("back"),
        vectors.l2_norm(F.col("v")).alias("norm"),
        vectors.l2_normalize(F.col("v")).alias("unit"),
        vectors.cosine(F.col("v"), F.col("v")).alias("self"),
        vectors.cosine(F.col("v"), F.col("z")).alias("zero"),
    ).first()
    assert row.back == [3.0, 4.0] and row.norm == 5.0
    assert np.allclose(row.unit, [0.6, 0.8])
    assert math.isclose(row["self"], 1.0) and row.zero is None


def test_encoder_is_repeatable_and_unit(spark):
    texts = ["The council met today.", "the COUNCIL met today.", "", "한국은행 기준금리 동결", "x"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    rows = embed(df.repartition(3), "t").orderBy("i").collect()
    got = np.array([r.embedding for r in rows])
    assert got.shape == (5, 768)
    norms = np.linalg.norm(got, axis=1)
    assert np.allclose(norms, [1, 1, 0, 1, norms[4]]) and norms[4] in (0, 1)
    assert np.allclose(got[0], got[1])
    together = HashedNgrams().encode(texts)
    alone = np.concatenate([HashedNgrams().encode([t]) for t in texts])
    assert np.array_equal(together, alone)


def test_custom_encoder_and_batches(spark):
    class Lengths:
        def encode(self, batch):
            assert len(batch) <= 4
            return np.array([[len(t), 1.0] for t in batch])

    df = spark.createDataFrame([("a" * n,) for n in range(11)], "t string")
    got = embed(df, "t", spec=EncoderSpec(Lengths), batch_size=4).collect()
    for r in got:
        n = len(r.t)
        assert np.allclose(r.embedding, np.array([n, 1]) / math.hypot(n, 1))


def test_percent_match(spark):
    df = spark.createDataFrame([(0.125, 13), (0.8849, 88), (-0.005, 0), (1.0, 100)], "s double, p int")
    got = df.select(vectors.percent_match(F.col("s")).alias("g"), "p").collect()
    assert all(r.g == r.p for r in got)


def test_encoders_never_answer_for_each_other(spark):
    """Two encoders of one kind in one worker, without names to mix up."""

    def constant(value):
        class Constant:
            def encode(self, batch):
                return np.array([[1.0, value] for _ in batch])

        return EncoderSpec(Constant)

    df = spark.createDataFrame([("a",)], "t string").coalesce(1)
    for value in (0.0, 2.0, -3.0, 0.0):
        (row,) = embed(df, "t", spec=constant(value)).collect()
        assert np.allclose(row.embedding, np.array([1, value]) / math.hypot(1, value))


@pytest.mark.parametrize(
    "vectors", [[[1.0, 2.0], [1.0, 2.0, 3.0, 4.0]], [[1.0, None]], [[1.0, 2.0], None], [[], [1.0]]]
)
def test_ragged_vectors_are_refused(vectors):
    with pytest.raises(ValueError):
        unit_rows(pa.array(vectors, pa.list_(pa.float64())))


def test_unit_rows():
    got = unit_rows(pa.array([[3.0, 4.0], [0.0, 0.0]], pa.list_(pa.float64())))
    assert got.tolist() == [[0.6, 0.8], [0.0, 0.0]]
    assert unit_rows(pa.array([], pa.list_(pa.float64()))).shape == (0, 0)
