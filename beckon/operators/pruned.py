"""Exact top-k by cosine plus recency, with blocks that are skipped by a bound.

The rows of a scope are sorted by their heaviest terms and cut into blocks, so a block holds
similar vectors.  A block is summed up by the largest weight of each of its terms and by its
newest row; that bounds the score of any of its rows for a message.  Each message visits the
block of its highest bound first.  Its k-th best score there then decides which other blocks
can still hold a better row; the rest are skipped.  Messages and bounds travel as rows, a hot
scope's blocks lie in many tasks, and nothing comes to the driver.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from beckon.operators.blocks import LEFT_ROWS, RIGHT_ROWS, block_pairs, list_column
from beckon.session import staged

LEADING_TERMS = 3
SUMMARY_ROWS = 1024  # block summaries (or messages) that meet in one call
RECENCY_WEIGHT = 0.15
RECENCY_DAYS = 60.0
SLACK = 1e-6  # scores are rounded, bounds are not


def dense(table: pa.Table, size: int, idf: list[float] | None = None):
    """Rows of sparse vectors as a matrix: ``weights`` as they are, or ``counts`` weighed by ``idf`` to length one."""
    import numpy as np

    ids, ends = list_column(table["term_ids"])
    values, _ = list_column(table["weights" if idf is None else "counts"])
    ids, weights = ids.to_numpy(zero_copy_only=False), values.to_numpy(zero_copy_only=False)
    matrix = np.zeros((table.num_rows, size))
    rows = np.repeat(np.arange(table.num_rows), np.diff(ends))
    if idf is not None:
        weights = weights * np.asarray(idf, float)[ids]
        weights /= np.sqrt(np.bincount(rows, weights * weights, table.num_rows))[rows]
    matrix[rows, ids] = weights
    return matrix


def doubles(values: list[float]) -> str:
    """An array of doubles as SQL text."""
    return f"cast(array({', '.join(f'{v!r}D' for v in values)}) AS array<double>)"


def boost_of_days(days):
    """The recency boost of rows of an age in days, as arrays."""
    import numpy as np

    return np.exp(-days / RECENCY_DAYS) * RECENCY_WEIGHT


@dataclass(frozen=True)
class Visits:
    """What was found, and which message visited which block."""

    found: DataFrame  # query_id, score, at, evidence_id: k rows a visit at most
    visits: DataFrame  # query_id, block
    blocks: DataFrame  # scope_key, block, block_rows, newest_at, oldest_at, best_boost
    bins: DataFrame  # block, block_rows: rows of small scopes that share a call


def in_blocks(candidates: DataFrame, block_rows: int, idf: list[float]) -> DataFrame:
    """``candidates`` with ``block``: runs of similar rows of one scope, stored.

    The order is by scope and heaviest terms, dealt out by ranges of it; a block is a run of
    positions in a task, so a scope of any size is cut without a window over it.
    """
    heaviest = F.expr(f"transform(slice(sort_array(transform(arrays_zip(term_ids, counts), z -> struct("
                      f"z.counts * {doubles(idf)}[z.term_ids] AS w, z.term_ids AS t)), false), 1, {LEADING_TERMS}), z -> z.t)")
    order = ["scope_key", "_lead", "evidence_id"]
    dealt = candidates.withColumn("_lead", heaviest).repartitionByRange(*order).sortWithinPartitions(*order)
    # the lower 33 bits number the rows of a task, the others the task
    run = F.expr(f"concat_ws('.', shiftright(_at, 33), cast((_at & 8589934591) DIV {int(block_rows)} AS string))")
    return staged(dealt.withColumn("_at", F.monotonically_increasing_id()).withColumn(
        "block", F.concat_ws("|", "scope_key", run)).drop("_lead", "_at"), "evidence-candidates")


def _summaries(candidates: DataFrame, blocks: DataFrame, idf: list[float]) -> DataFrame:
    """The largest weight of each term of the blocks: ``term_ids, weights``, at most the vocabulary."""
    weight = f"z.counts * {doubles(idf)}[z.term_ids]"
    length = F.expr(f"sqrt(aggregate(arrays_zip(term_ids, counts), 0.0D, (acc, z) -> acc + {weight} * {weight}))")
    terms = candidates.select("block", length.alias("_length"), F.explode(F.arrays_zip("term_ids", "counts")).alias("z"))
    largest = terms.groupBy("block", F.col("z.term_ids").alias("t")).agg(F.expr(f"max({weight} / _length)").alias("w"))
    listed = largest.groupBy("block").agg(F.collect_list(F.struct("t", "w")).alias("_z"))
    return blocks.join(listed, "block").withColumns(
        {"term_ids": F.col("_z.t"), "weights": F.col("_z.w")}).drop("_z")


def _bounds(size: int, least: float, idf: list[float], point_in_time: bool):
    """A function that bounds the score of each message in each block; hopeless blocks are left out."""
    import numpy as np

    schema = pa.schema([("query_id", pa.string()), ("block", pa.string()), ("bound", pa.float64())])

    def bound(left: pa.Table, right: pa.Table) -> pa.Table:
        # vectors are of length one, so no cosine is above one
        bounds = np.minimum(dense(left, size, idf) @ dense(right, size).T, 1.0)
        if not point_in_time:
            bounds += right["best_boost"].to_numpy()[None, :]
        else:  # only rows older than the message, aged against the newest of them
            asked, newest = (left[c].fill_null(np.iinfo(np.int64).min).to_numpy()[:, None]
                             for c in ("asked_at", "asked_newest"))
            known = right["newest_at"].is_valid().to_numpy()
            last, first = (right[c].fill_null(0).to_numpy()[None, :] for c in ("newest_at", "oldest_at"))
            age = np.maximum(newest.astype(float) - last, 0.0)
            bounds = np.where(known[None, :] & (first < asked), bounds + boost_of_days(age / 86_400_000_000.0), -1.0)
        row, col = np.nonzero(bounds > least - SLACK)
        return pa.table([left["query_id"].take(pa.array(row)).cast(pa.string()),
                         right["block"].take(pa.array(col)).cast(pa.string()), pa.array(bounds[row, col])],
                        schema=schema)

    return bound


def _visit(asked: DataFrame, candidates: DataFrame, blocks: DataFrame, block_rows: int, function) -> DataFrame:
    """The best rows of each visit; ``asked`` has a row with its vector for each."""
    met = staged(asked.groupBy("block").agg(F.count(F.lit(1)).alias(LEFT_ROWS)).join(
        blocks.select("block", F.col("block_rows").alias(RIGHT_ROWS)), "block"), "visited-blocks")
    return block_pairs(
        asked.join(met, "block"), candidates.join(met, "block"), key="block",
        left_id="query_id", right_id="evidence_id", block_rows=block_rows, function=function,
        schema=T.StructType([
            T.StructField("query_id", T.StringType()), T.StructField("score", T.DoubleType()),
            T.StructField("at", T.LongType()), T.StructField("evidence_id", T.StringType())]))


def pruned_top_k(queries: DataFrame, candidates: DataFrame, k: int, size: int, block_rows: int,
                 function, least: float, idf: list[float], point_in_time: bool = False) -> Visits:
    """The rows among which the top ``k`` of each query are, found by visits to blocks.

    ``queries`` (stored) have ``query_id, scope_key, term_ids, counts, asked_at, asked_newest``,
    ``candidates`` ``scope_key, evidence_id, at, boost, term_ids, counts``; ``idf`` weighs the counts.  ``function`` returns
    the best ``k`` right rows above ``least`` of the scope of each left row of two blocks.  With ``point_in_time``
    only rows older than the query count, and their boost depends on the query.  Runs jobs at once.
    """
    # stored before it is dealt out, since finding the ranges reads it once more
    candidates = staged(candidates, "candidates")
    sizes = staged(candidates.groupBy("scope_key").agg(
        F.count(F.lit(1)).alias("block_rows"), F.max("at").alias("newest_at"), F.min("at").alias("oldest_at"),
        F.max("boost").alias("best_boost")).join(
            queries.groupBy("scope_key").agg(F.count(F.lit(1)).alias(LEFT_ROWS)), "scope_key"), "scopes-asked")
    # Scopes of one block are visited without a bound, many in one call: they share bins of
    # about half the rows of a block on either side, and only rows of one scope are compared.
    # A bin with more rows than a block is cut, and the other side is sent once per part.
    small = F.col("block_rows") <= block_rows
    totals = sizes.agg(F.sum(F.when(small, F.greatest("block_rows", LEFT_ROWS))), F.count_if(~small)).first()
    bins = max(1, math.ceil(2 * (totals[0] or 0) / block_rows))
    binned = sizes.where(small).withColumn("block", F.pmod(F.xxhash64("scope_key"), F.lit(bins)).cast("string"))
    single = queries.join(binned.select("scope_key", "block"), "scope_key")
    filled = binned.groupBy("block").agg(F.sum("block_rows").alias("block_rows"))
    found = _visit(single, candidates.join(binned.select("scope_key", "block"), "scope_key"), filled, block_rows, function)
    whole = binned.drop(LEFT_ROWS).withColumn("block", F.col("scope_key"))
    single = single.select("query_id", F.col("scope_key").alias("block"))
    if not totals[1]:
        return Visits(found, single, whole, filled)
    large = sizes.where(~small).select("scope_key", LEFT_ROWS)
    candidates = in_blocks(candidates.join(large.select("scope_key"), "scope_key"), block_rows, idf)
    blocks = staged(candidates.groupBy("scope_key", "block").agg(
        F.count(F.lit(1)).alias("block_rows"), F.max("at").alias("newest_at"), F.min("at").alias("oldest_at"),
        F.max("boost").alias("best_boost")), "evidence-blocks")
    met = staged(blocks.groupBy("scope_key").agg(F.count(F.lit(1)).alias(RIGHT_ROWS)).join(large, "scope_key"),
                 "blocks-of-scopes")
    summed = staged(_summaries(candidates, blocks, idf), "block-summaries")
    bounds = staged(block_pairs(
        queries.join(met, "scope_key"), summed.join(met, "scope_key"), key="scope_key", left_id="query_id",
        right_id="block", block_rows=SUMMARY_ROWS, function=_bounds(size, least, idf, point_in_time),
        schema=T.StructType([T.StructField("query_id", T.StringType()), T.StructField("block", T.StringType()),
                             T.StructField("bound", T.DoubleType())])), "evidence-bounds")
    first = staged(bounds.groupBy("query_id").agg(F.max(F.struct("bound", "block")).alias("b")).select(
        "query_id", "b.block"), "first-visits")
    best = staged(_visit(queries.join(first, "query_id"), candidates, blocks, block_rows, function), "first-evidence")
    # k rows of one visit: the smallest of k scores is what another block has to reach
    kth = best.groupBy("query_id").agg(F.expr(f"if(count(*) >= {int(k)}, min(score), NULL)").alias("_kth"))
    rest = staged(bounds.join(kth, "query_id", "left").where(F.expr(
        f"bound >= coalesce(_kth, {float(least)}D) - {SLACK}D")).select("query_id", "block").join(
            first, ["query_id", "block"], "left_anti"), "further-visits")
    more = _visit(queries.join(rest, "query_id"), candidates, blocks, block_rows, function)
    return Visits(found.unionByName(best).unionByName(more), single.unionByName(first).unionByName(rest),
                  whole.unionByName(blocks), filled)
