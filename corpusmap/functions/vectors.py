"""Dense vector arithmetic as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _double(col: Column) -> Column:
    return col.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    """Inner product in double precision."""
    products = F.zip_with(_double(a), _double(b), lambda x, y: x * y)
    return F.aggregate(products, F.lit(0.0), lambda acc, x: acc + x)


def l2_norm(col: Column) -> Column:
    """Euclidean length."""
    return F.sqrt(F.aggregate(_double(col), F.lit(0.0), lambda acc, x: acc + x * x))


def normalize(col: Column) -> Column:
    """The vector at unit length; a zero vector stays zero.

    The scaling is the finish step of the sum of squares: the length is then found once, not per element.
    """
    v = _double(col)
    return F.aggregate(
        v,
        F.lit(0.0),
        lambda acc, x: acc + x * x,
        lambda s: F.when(s > 0, F.transform(v, lambda x: x / F.sqrt(s))).otherwise(v),
    )


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity; 0 when either vector is zero."""
    length = l2_norm(a) * l2_norm(b)
    return F.when(length > 0, dot(a, b) / length).otherwise(F.lit(0.0))


def cosine_distance(a: Column, b: Column) -> Column:
    """One minus the cosine similarity."""
    return F.lit(1.0) - cosine(a, b)
