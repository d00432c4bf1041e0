"""Salted joins for hot keys.

When many rows of one key (a site holding a third of all pages) meet a table
with one row per key, a shuffle join by key sends the whole hot key to one
task.  Salting splits it: each big-side row takes a salt from a column that
varies inside the key, the one-row-per-key side is replicated once per salt,
and the join runs on (key, salt).  The replicated side grows by ``buckets``
rows per key only, and the result is exactly the unsalted join.
AQE's skew-join split remains on as a second line of defence.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SALT = "_salt"


def salted_join(big: DataFrame, small: DataFrame, key: str, spread_by: str, how: str = "left", buckets: int = 16) -> DataFrame:
    """``big JOIN small USING (key)`` with the hot keys of ``big`` spread over ``buckets`` tasks.

    ``small`` must have at most one row per ``key``; ``spread_by`` is a column
    of ``big`` that varies within a key (``page_id``, ``word``).
    """
    b = big.withColumn(SALT, F.pmod(F.xxhash64(F.col(spread_by)), F.lit(buckets)))
    s = small.withColumn(SALT, F.explode(F.sequence(F.lit(0).cast("long"), F.lit(buckets - 1).cast("long"))))
    return b.join(s, [key, SALT], how).drop(SALT)
