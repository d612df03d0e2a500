"""What was known of a key at a time: sums and maxima over earlier rows.

Questions and facts of all keys are put in one order of key and time and dealt out by
ranges of both, so a key of any size lies in many tasks.  Each task runs over its own
rows; a row per key and task then carries over what the tasks before hold of that key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from beckon.session import staged


def micros(time: Column) -> Column:
    """A timestamp as microseconds."""
    return F.unix_micros(time.cast("timestamp"))


def as_of(asked: DataFrame, facts: DataFrame, keys: list[str], sums: list[str] = (), maxima: list[str] = (),
          at: str = "at") -> DataFrame:
    """``asked`` with ``sums`` and ``maxima`` over the ``facts`` of its key that are strictly older.

    ``at`` orders both (microseconds, say); facts without a time or a key count for
    nobody.  Without facts a sum is 0 and a maximum null.  Runs jobs at once.
    """
    sums, maxima = list(sums), list(maxima)
    values = [*sums, *maxima]
    known = facts.where(" AND ".join(f"{c} IS NOT NULL" for c in [*keys, at])).select(
        *keys, at, *values, F.lit(1).alias("_fact"))
    both = asked.withColumn("_fact", F.lit(0)).unionByName(known, allowMissingColumns=True)
    # At equal times questions come first, so facts of the same moment are not known yet.
    order = [*keys, at, "_fact"]
    cut = staged(both.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()), "as-of")
    functions = {**{c: "sum" for c in sums}, **{c: "max" for c in maxima}}
    parts = cut.groupBy(*keys, "_part").agg(*[F.expr(f"{f}({c})").alias(f"_all_{c}") for c, f in functions.items()])
    key = ", ".join(keys)
    before = f"OVER (PARTITION BY {key} ORDER BY _part ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
    carried = parts.select(*[F.col(c).alias(f"_key_{c}") for c in keys], F.col("_part").alias("_at_part"),
                           *[F.expr(f"{f}(_all_{c}) {before}").alias(f"_before_{c}") for c, f in functions.items()])
    carried = carried.where(" OR ".join(f"_before_{c} IS NOT NULL" for c in values))
    own = f"OVER (PARTITION BY {key}, _part ORDER BY {at}, _fact ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
    run = cut.select(*[c for c in cut.columns if c not in values],
                     *[F.expr(f"{f}({c}) {own}").alias(f"_own_{c}") for c, f in functions.items()]).where("_fact = 0")
    on = [F.col(c) == F.col(f"_key_{c}") for c in keys] + [F.col("_part") == F.col("_at_part")]
    zero = F.lit(0)
    return run.join(carried, on, "left").select(
        *asked.columns,
        *[(F.coalesce(f"_before_{c}", zero) + F.coalesce(f"_own_{c}", zero)).alias(c) for c in sums],
        *[F.greatest(f"_before_{c}", f"_own_{c}").alias(c) for c in maxima])
