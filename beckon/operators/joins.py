"""Lookups that stay balanced when one key holds a large share of rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from beckon.session import staged

# a key up to this many rows is never split
HOT_ROWS = 200_000


def hot_keys(df: DataFrame, keys: Sequence[str], hot_rows: int = HOT_ROWS) -> DataFrame:
    """All keys with more than ``hot_rows`` rows, with the number of salts each needs.

    Counts rows per key by partial aggregation, so a hot key shuffles one row per
    task.  The result is a stored table: its size is known to the join planner, which
    decides on a broadcast, and nothing comes to the driver.  Runs a job at once.
    """
    present = " AND ".join(f"{key} IS NOT NULL" for key in keys)
    counted = df.where(present).groupBy(*keys).agg(F.count(F.lit(1)).alias("_rows"))
    return hot_among(counted, keys, "_rows", hot_rows)


def hot_among(counted: DataFrame, keys: Sequence[str], rows: str,
              hot_rows: int = HOT_ROWS) -> DataFrame:
    """The hot keys of a table that already holds row counts per key, stored."""
    return staged(counted.where(F.col(rows) > hot_rows).select(
        *keys, F.ceil(F.col(rows) / hot_rows).cast("int").alias("_salts")), "hot-keys")


def lookup(left: DataFrame, right: DataFrame, keys: Sequence[str], salt_by: str,
           hot: DataFrame | None = None, hot_on: Sequence[str] | None = None,
           how: str = "left") -> DataFrame:
    """``left JOIN right USING (keys)`` with ``right`` unique per key.

    Without ``hot`` this is a plain join: Spark broadcasts a right side that it
    knows to be small and AQE splits skewed partitions when both sides come
    from a scan.  With ``hot`` (from ``hot_keys``) rows of hot keys are spread
    over salts and the matching right rows are repeated once per salt, which
    also covers right sides that are aggregates, where AQE cannot split.
    """
    if hot is None:
        return left.join(right, list(keys), how)
    on = list(hot_on or keys)
    salted_left = left.join(hot, on, "left").withColumn("_salt", F.expr(
        f"if(_salts IS NULL, 0, int(pmod(xxhash64({salt_by}), _salts)))")).drop("_salts")
    salted_right = right.join(hot, on, "left").withColumn("_salt", F.expr(
        "explode(sequence(0, coalesce(_salts, 1) - 1))")).drop("_salts")
    return salted_left.join(salted_right, [*keys, "_salt"], how).drop("_salt")
