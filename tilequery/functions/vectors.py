"""Column expressions over vectors stored as arrays.

Single-pass distances stay in the JVM (higher-order functions, sums in double
and in array order); pairwise work lives in :mod:`tilequery.operators.knn`.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda acc, v: acc + v)


def diff(a: Column | str, b: Column | str) -> Column:
    """Component-wise ``a - b`` in double."""
    return F.zip_with(_col(a), _col(b), lambda x, y: x.cast("double") - y.cast("double"))


def squared_distance(a: Column | str, b: Column | str) -> Column:
    return F.aggregate(diff(a, b), F.lit(0.0), lambda acc, d: acc + d * d)


def norm(v: Column | str, ord: float = 2) -> Column:
    """Vector norm: 1, 2, ``inf`` or any positive p."""
    v = _col(v)
    if ord == 1:
        return F.aggregate(v, F.lit(0.0), lambda acc, x: acc + F.abs(x.cast("double")))
    if ord == 2:
        return F.sqrt(
            F.aggregate(v, F.lit(0.0), lambda acc, x: acc + x.cast("double") * x.cast("double"))
        )
    if ord == float("inf"):
        return F.aggregate(v, F.lit(0.0), lambda acc, x: F.greatest(acc, F.abs(x.cast("double"))))
    if ord <= 0:
        raise ValueError("norm order must be positive")
    p = float(ord)
    return F.pow(_sum(F.transform(v, lambda x: F.pow(F.abs(x.cast("double")), F.lit(p)))), F.lit(1.0 / p))


METRICS = ("l1", "l2", "sqeuclidean")


def distance(a: Column | str, b: Column | str, metric: str = "l2") -> Column:
    """Distance between two vector columns."""
    if metric == "l1":
        return norm(diff(a, b), 1)
    if metric == "l2":
        return F.sqrt(squared_distance(a, b))
    if metric == "sqeuclidean":
        return squared_distance(a, b)
    raise ValueError(f"unknown metric {metric!r}; one of {METRICS}")


def vector_literal(values) -> Column:
    """A fixed vector as a constant array column."""
    return F.array(*[F.lit(float(v)) for v in values])
