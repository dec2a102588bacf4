"""Vector expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from .text import col, let


def l2_normalise(v) -> Column:
    """Unit length; a zero vector stays zero. Summed in double, returned as float."""
    def scaled(d: Column) -> Column:
        square = F.aggregate(d, F.lit(0.0), lambda acc, x: acc + x * x)
        norm = let(square, lambda q: F.when(q == 0, 1.0).otherwise(F.sqrt(q)))
        return let(norm, lambda n: F.transform(d, lambda x: (x / n).cast("float")))

    return let(F.transform(col(v), lambda x: x.cast("double")), scaled)
