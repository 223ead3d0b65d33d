"""Vector arithmetic on array<double> columns."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Lengths below this count as this.
TINY = 1e-12


def literal(values: Sequence[float]) -> Column:
    """A constant array<double>."""
    return F.array(*[F.lit(float(x)) for x in values])


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def scaled(a: Column, by: Column) -> Column:
    return F.transform(a, lambda x: x.cast("double") * by)


def unit(a: Column) -> Column:
    """a / max(|a|, TINY)."""
    # the length is bound to a name: inside the lambda it would be computed again for each element
    length = F.array(F.greatest(norm(a), F.lit(TINY)))
    return F.transform(length, lambda n: F.transform(a, lambda x: x.cast("double") / n))[0]


def unit_list(values: Sequence[float]) -> list[float]:
    length = max(math.sqrt(sum(float(x) ** 2 for x in values)), TINY)
    return [float(x) / length for x in values]


def cosine(a: Column, direction: Sequence[float]) -> Column:
    """Cosine of a column with a constant direction."""
    return dot(unit(a), literal(unit_list(direction)))
