"""Mix sources to target weights by repeating documents.

Aggregate words per source, derive each source's repetition rate, then emit each
document floor(rate) times, plus one copy drawn by a hash of its id with the
fraction as probability.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from beckon.llm.common import WORD, stored, without

#: Weights of the sources in code-point order, repeating.
WEIGHTS = (3, 1, 2)
RESULTS = ("size", "source_size", "target", "copies", "taken")


def words(text: Column) -> Column:
    """Number of words of a text, 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, share: float = 1.5, most: float = 2.0,
                   weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """``source, source_size, target`` from rows of ``source, size``; null sources last.

    The budget is ``share`` of all sizes.  It is dealt by weight; a target stops at
    ``most`` times its source's size and what is over is dealt again among the
    others until none is above.  Each round is one distributed sum.
    """
    totals = stored(
        sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
        .repartitionByRange(F.col("source").asc_nulls_last())
        .sortWithinPartitions(F.col("source").asc_nulls_last())
        .withColumn("__row", F.monotonically_increasing_id()), "mix-sources")
    # Global position without a sort in one task: rows before this part, plus the row in it.
    part = F.shiftright("__row", 33)
    offsets, seen = {}, 0
    for p, n in sorted(totals.groupBy(part.alias("part")).count().collect()):
        offsets[p], seen = seen, seen + n
    position = F.col("__row").bitwiseAND(F.lit((1 << 33) - 1))
    if offsets:
        position = position + F.element_at(
            F.create_map(*[F.lit(x) for kv in offsets.items() for x in kv]), part)
    ranked = totals.select(
        "source", "source_size",
        F.element_at(F.array(*[F.lit(float(w)) for w in weights]),
                     (F.pmod(position, F.lit(len(weights))) + 1).cast("int")).alias("weight"))
    ranked = stored(ranked, "mix-weights")
    cap = F.col("source_size") * F.lit(most)
    budget = share * float(ranked.agg(F.sum("source_size")).first()[0] or 0)
    level = None  # words a unit of weight gets
    while True:
        full = F.lit(False) if level is None else cap <= F.col("weight") * F.lit(level)
        used, rest = ranked.agg(F.sum(F.when(full, cap)), F.sum(F.when(~full, F.col("weight")))).first()
        found = (budget - (used or 0.0)) / rest if rest else float("inf")
        if level is not None and found <= level:
            break
        level = found
        if rest is None:
            break
    return ranked.select("source", "source_size",
                         F.least(cap, F.col("weight") * F.lit(level)).cast("double").alias("target"))


def mix(docs: DataFrame, share: float = 1.5, most: float = 2.0,
        weights: tuple[int, ...] = WEIGHTS, seed: int = 0) -> DataFrame:
    """All documents with ``size, source_size, target, copies, taken``.

    ``copies`` is how often the mix takes the document (0 to ``ceil(most)``) and
    ``taken`` the words it takes that way.  A null text has size 0; a null source
    is a source of its own, after all others; a source without words has target 0
    and no copies.  Rows with the same id get the same draw.  Input columns
    named like a result are replaced.  Runs jobs at once to find the targets.
    """
    sized = without(docs, RESULTS).withColumn("size", words(F.col("text")))
    targets = source_targets(sized.select("source", "size"), share, most, weights)
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    # 48 bits of a digest of seed and id, which SQL elsewhere can repeat.
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).cast("binary"))
    draw = F.conv(F.substring(digest, 1, 12), 16, 10).cast("double") / F.lit(float(1 << 48))
    keys = targets.withColumnRenamed("source", "__source")
    return (
        sized.join(keys, F.col("source").eqNullSafe(F.col("__source")), "left").drop("__source")
        .withColumn("copies", (F.floor(rate) + F.when(draw < rate - F.floor(rate), 1).otherwise(0)).cast("int"))
        .withColumn("taken", F.col("size") * F.col("copies")))


def emit(mixed: DataFrame) -> DataFrame:
    """One row per copy that the mix takes."""
    return mixed.where("copies > 0").withColumn(
        "__copy", F.explode(F.sequence(F.lit(1), F.col("copies")))).drop("__copy")
