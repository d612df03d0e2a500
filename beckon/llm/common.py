"""Small helpers that the training-data operators share."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from beckon.session import staged

#: White space of the contracts: blank and the characters 9 to 13.
WORD = "[^\\x20\\x09-\\x0D]+"


def read(spark: SparkSession, sf_dir: str, table: str = "documents") -> DataFrame:
    """A whole table of a data folder."""
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def without(df: DataFrame, names: Iterable[str]) -> DataFrame:
    """Drop input columns whose name, in any case, an operator gives to a result."""
    taken = {n.lower() for n in names}
    return df.drop(*[c for c in df.columns if c.lower() in taken])


def text_crc32(text: Column) -> Column:
    """Unsigned CRC-32 of a text's UTF-8 bytes, 0 for null."""
    return F.crc32(F.coalesce(text, F.lit("")).cast("binary"))


def fold(doc_id: Column, parts: int) -> Column:
    """Remainder of the CRC-32 of the id as text; a null id counts as the empty text."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")),
                  F.lit(parts))


def bounded_sample(df: DataFrame, rows: int, key: Column) -> DataFrame:
    """Rows with the ``rows`` smallest hashes of ``key``, one row a hash.

    Runs a job at once on the hashes alone; the rows themselves are then filtered
    where they are, so no task gets more than the sample.
    """
    hashed = df.withColumn("__order", F.xxhash64(F.lit("sample"), key))
    last = (hashed.select("__order").distinct().orderBy("__order").limit(rows)
            .agg(F.max("__order")).first()[0])
    return hashed.where(F.col("__order") <= F.lit(last).cast("long")).dropDuplicates(["__order"]).drop("__order")


def bounded_sample_each(df: DataFrame, rows: int, key: Column, of: str) -> DataFrame:
    """The same for each value of the column ``of``, which has few values and no null.

    Hashes are even, so a bound from the number of distinct ones leaves about twice
    the sample to be ranked, whatever the size of the input.
    """
    hashed = df.withColumn("__order", F.xxhash64(F.lit("sample"), key))
    hashes = hashed.select(of, "__order").distinct()
    counts = hashes.groupBy(F.col(of).alias("__of")).agg(F.count("*").alias("__many"))
    near = hashes.join(F.broadcast(counts), F.col(of) == F.col("__of")).where(
        f"__order <= -9223372036854775808D + 18446744073709551616D * {2 * rows + 100} / __many")
    ranked = near.withColumn("__n", F.expr(f"row_number() OVER (PARTITION BY {of} ORDER BY __order)"))
    last = ranked.where(F.col("__n") <= rows).groupBy(F.col(of).alias("__of")).agg(F.max("__order").alias("__last"))
    return (hashed.join(F.broadcast(last), (F.col(of) == F.col("__of")) & (F.col("__order") <= F.col("__last")))
            .drop("__of", "__last").dropDuplicates([of, "__order"]).drop("__order"))


def stored(df: DataFrame, purpose: str) -> DataFrame:
    """Written to the shared folder and read back: cuts lineage, survives lost executors."""
    return staged(df, purpose)


def parts_for(rows: int, each: int) -> int:
    """How many parts of about ``each`` rows."""
    return max(1, -(-rows // each))
