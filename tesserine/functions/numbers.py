"""Numbers. Column in, Column out, JVM only."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def rounded(x: Column, digits: int) -> Column:
    """A double to ``digits`` places as SQL engines do it: scaled, rounded half away from zero and scaled back. Spark's own round takes the halves of the shortest decimal form."""
    scale = F.lit(float(10**digits))
    return F.round(x * scale, 0) / scale
