"""Column functions over arrays of numbers, computed in double precision."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda s, v: s + v)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def over_norms(product: Column, norms: Column) -> Column:
    """A dot product over both norms; NaN, as in SQL, where a vector has length zero and so no direction."""
    return F.when(norms == 0, F.lit(float("nan"))).otherwise(product / norms)


def cosine(a: Column, b: Column) -> Column:
    return over_norms(dot(a, b), norm(a) * norm(b))


def l2_normalised(a: Column) -> Column:
    n = norm(a)
    return F.when(n > 0, F.transform(a, lambda x: x.cast("double") / n)).otherwise(F.transform(a, lambda x: x.cast("double")))
