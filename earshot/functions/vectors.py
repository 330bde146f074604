"""Vector expressions over ARRAY<FLOAT | DOUBLE> columns, computed in DOUBLE."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(v: Column | str) -> Column:
    return F.col(v) if isinstance(v, str) else v


def dot(a: Column | str, b: Column | str) -> Column:
    product = F.zip_with(_col(a), _col(b), lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(product, F.lit(0.0), lambda acc, x: acc + x)


def norm(v: Column | str) -> Column:
    return F.sqrt(F.aggregate(_col(v), F.lit(0.0), lambda acc, x: acc + x.cast("double") * x.cast("double")))


def scale(v: Column | str, divisor: Column) -> Column:
    """``v / divisor``; a zero divisor leaves ``v`` as it is.  Pass ``divisor`` as a column, not as an expression on ``v``."""
    by = F.when(divisor == 0, F.lit(1.0)).otherwise(divisor)
    return F.zip_with(
        F.transform(_col(v), lambda x: x.cast("double")), F.array_repeat(by, F.size(_col(v))), lambda x, d: x / d
    )


def euclidean(a: Column | str, b: Column | str) -> Column:
    square = F.zip_with(
        _col(a), _col(b), lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))
    )
    return F.sqrt(F.aggregate(square, F.lit(0.0), lambda acc, x: acc + x))
