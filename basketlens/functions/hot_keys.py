"""Joins of raw rows whose keys are uneven.

Heavy hitters come from an approximate top-k aggregate (a frequent-items
sketch of bounded size, merged over tasks).  The rows of such a key are dealt
over ``salts`` parts by a hash of the row and its input partition (a task that
is run again deals the same rows the same way), the rows of the other side
with that key are repeated once for each part, and the join is on (key, part).
All other keys have one part.  So a key that holds a third of all rows is
spread whatever the engine's settings, and a wrong guess of the sketch costs a
few repeated rows but never changes the result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from basketlens.functions.bounds import bounded_broadcast

TRACKED = 1000  # items of the sketch; its error is about 1/TRACKED of the rows
MOST_HOT = 200


def heavy_hitters(rows: DataFrame, key: str, share: float) -> DataFrame:
    """(``key``) of at most ``MOST_HOT`` values that hold more than ``share`` of the rows, by estimate."""
    if share * MOST_HOT < 1:
        raise ValueError(f"a share of {share} allows more than {MOST_HOT} keys")
    found = rows.where(F.col(key).isNotNull()).agg(
        F.call_function("approx_top_k", F.col(key), F.lit(MOST_HOT), F.lit(TRACKED)).alias("top"), F.count(F.lit(1)).alias("total")
    )
    each = found.select("total", F.explode("top").alias("one"))
    return each.where(F.col("one.count") > F.col("total") * share).select(F.col("one.item").alias(key))


def spread_join(rows: DataFrame, lookup: DataFrame, key: str, how: str = "inner", salts: int = 32, share: float = 0.01) -> DataFrame:
    """``rows`` joined with ``lookup`` on ``key`` (inner or left), hot keys of ``rows`` dealt over ``salts`` parts."""
    if how not in ("inner", "left"):
        raise ValueError("only inner and left joins can be spread")
    if salts < 2:
        return rows.join(lookup, key, how)
    hot = bounded_broadcast(heavy_hitters(rows, key, share).withColumn("_hot", F.lit(True)), MOST_HOT)
    part = F.when(F.col("_hot"), F.pmod(F.xxhash64(*rows.columns, F.spark_partition_id()), F.lit(salts))).otherwise(0)
    dealt = rows.join(hot, key, "left").withColumn("_part", part.cast("int")).drop("_hot")
    parts = F.when(F.col("_hot"), F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0)))
    repeated = lookup.join(hot, key, "left").withColumn("_part", F.explode(parts)).drop("_hot")
    return dealt.join(repeated, [key, "_part"], how).drop("_part")
