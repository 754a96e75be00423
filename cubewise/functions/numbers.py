"""Numeric helpers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

GUARD_DIGITS = 9


def stable_round(c: str | Column, digits: int = 6) -> Column:
    """Round half-up to ``digits`` places after snapping to 9 places.

    Means are sums divided by counts, and a sum's last bits depend on the
    order partial sums are merged in, which differs between runs, partition
    counts and engines. Snapping first removes that noise, so a mean whose
    exact value ends in 5 at the 7th place rounds the same way every time.
    """
    col = F.col(c) if isinstance(c, str) else c
    return F.round(F.round(col, GUARD_DIGITS), digits)
