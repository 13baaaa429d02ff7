"""Tag values are strings or numbers; between the two kinds every string is larger than every number, and null is smallest."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def rank() -> Column:
    return F.when(F.col("value_str").isNotNull(), 2).when(F.col("value_num").isNotNull(), 1).otherwise(0)


def compare(op: str, value: str | float) -> Column:
    """A predicate on value_str / value_num. CONTAINS and NOTCONTAINS look into strings, in lower case; an unknown operator means equality."""
    text = isinstance(value, str)
    own, kind = (F.col("value_str"), 2) if text else (F.col("value_num"), 1)
    v = F.lit(value if text else float(value))
    no = F.lit(False)
    contains = F.coalesce(F.lower("value_str").contains(str(value).lower()), no)
    table = {
        "CONTAINS": contains,
        "NOTCONTAINS": ~contains,
        "!=": ~F.coalesce(own == v, no),
        "<": (rank() < kind) | F.coalesce(own < v, no),
        "<=": (rank() < kind) | F.coalesce(own <= v, no),
        ">": (rank() > kind) | F.coalesce(own > v, no),
        ">=": (rank() > kind) | F.coalesce(own >= v, no),
    }
    return table.get(op.upper(), F.coalesce(own == v, no))


def conjunction(parts: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, parts, F.lit(True))
