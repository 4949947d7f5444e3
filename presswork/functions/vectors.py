"""Vector expressions on ``array<float>``; arithmetic is in double."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def parse_vector(text: Column) -> Column:
    """``[a,b,...]`` text to an array; NULL for empty or unreadable text."""
    inner = F.btrim(text, F.lit("[] \t\r\n"))
    numbers = F.transform(F.split(inner, ","), lambda x: F.btrim(x).try_cast("float"))
    return F.when(
        (inner != "") & ~F.exists(numbers, lambda x: x.isNull()), numbers
    )


def format_vector(vector: Column) -> Column:
    """Array to ``[a,b,...]`` text."""
    return F.concat(
        F.lit("["),
        F.array_join(F.transform(vector, lambda x: x.cast("string")), ","),
        F.lit("]"),
    )


def dot(a: Column, b: Column) -> Column:
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda total, x: total + x)


def l2_norm(vector: Column) -> Column:
    return F.sqrt(dot(vector, vector))


def l2_normalize(vector: Column) -> Column:
    """Unit vector; a zero vector has no direction and gives NULL elements."""
    norm = l2_norm(vector)
    return F.transform(vector, lambda x: F.try_divide(x.cast("double"), norm))


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity; NULL if either vector is zero."""
    return F.try_divide(dot(a, b), l2_norm(a) * l2_norm(b))


def percent_match(similarity: Column) -> Column:
    """Similarity as a whole percentage, halves rounded up."""
    return F.floor(similarity * 100 + 0.5)
