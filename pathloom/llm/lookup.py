"""A join with a table of keys that knows how many rows hold each key."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A key that holds more than one in so many rows is joined by broadcast; there are no more such keys than this.
SHARES = 20_000


def join_counted(rows: DataFrame, keys: DataFrame, on: list[str], count: str, total: int) -> DataFrame:
    """``rows`` joined with ``keys`` on columns ``on`` (null equal to null); ``keys`` has each combination once, with the number
    ``count`` of rows that hold it, ``total`` in sum.  The keys that hold more than one row in ``SHARES`` are at most as many;
    they are broadcast, so no task gets all rows of such a key, and the rest is joined by a shuffle."""
    frequent = keys.where(F.col(count) * SHARES >= total)
    hot = F.broadcast(frequent.select(*[F.col(c).alias(f"__hot_{c}") for c in on], *[c for c in keys.columns if c not in (*on, count)]))
    same = [F.col(c).eqNullSafe(F.col(f"__hot_{c}")) for c in on]
    marked = [f"__hot_{c}" for c in on]
    met = rows.join(hot, same).drop(*marked)
    rare = keys.where(F.col(count) * SHARES < total)
    rare = rare.select(*[F.col(c).alias(f"__hot_{c}") for c in on], *[c for c in keys.columns if c not in (*on, count)])
    left = rows.join(F.broadcast(frequent.select(*[F.col(c).alias(f"__hot_{c}") for c in on])), same, "left_anti")
    return met.unionByName(left.join(rare, same).drop(*marked))
