"""Sums along a key's rows, for keys of any number of rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from beckon.llm.common import stored


def sums_from_here(rows: DataFrame, key: str, order: str, columns: list[str], purpose: str) -> DataFrame:
    """``rows`` with each of ``columns`` summed over the key's rows from this one on.

    ``(key, order)`` is unique.  Rows go to ranges of key and order, so a long key lies in
    many parts; each sums its own rows, and adds what the key's later parts hold.
    """
    cut = stored(rows.repartitionByRange(key, order).withColumn("__part", F.spark_partition_id()), purpose)
    parts = cut.groupBy(F.col(key).alias("__key"), F.col("__part").alias("__at")).agg(
        *[F.sum(c).alias(f"__{c}") for c in columns])
    later = "OVER (PARTITION BY __key ORDER BY __at DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
    rest = parts.select("__key", "__at", *[F.expr(f"sum(__{c}) {later}").alias(f"__{c}") for c in columns]).where(
        " OR ".join(f"__{c} IS NOT NULL" for c in columns))
    own = f"OVER (PARTITION BY {key}, __part ORDER BY {order} DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
    summed = cut.select(*[c for c in cut.columns if c not in columns],
                        *[F.expr(f"sum({c}) {own}").alias(c) for c in columns])
    joined = summed.join(rest, (F.col(key) == F.col("__key")) & (F.col("__part") == F.col("__at")), "left")
    return joined.select(*[c for c in rows.columns if c not in columns],
                         *[(F.col(c) + F.coalesce(f"__{c}", F.lit(0))).alias(c) for c in columns])
