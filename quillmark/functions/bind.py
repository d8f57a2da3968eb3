"""Values worked out once inside an expression."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def bound(value: Column, body) -> Column:
    """body(value), with the value worked out once: what a lambda or a large expression refers to would be worked out at each place."""
    return F.transform(F.array(value), body)[0]
