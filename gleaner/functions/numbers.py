"""Number expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def rounded(x: Column, places: int) -> Column:
    """A double rounded in binary, halves away from zero, as DuckDB and C do.
    ``F.round`` rounds the decimal digits, and drops the sign of what becomes
    zero."""
    y = x * float(10**places)
    whole = F.floor(F.abs(y)).cast("double")
    near = F.signum(y) * (whole + F.when(F.abs(y) - whole >= 0.5, 1.0).otherwise(0.0)) / float(10**places)
    # from 2^52 there is nothing to round, and from 2^63 no whole number
    return F.when(F.abs(y) < float(1 << 52), near).otherwise(x)
