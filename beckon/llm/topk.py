"""Exact top-k by inner product: columnar branch and bound.

Vectors of a block lie by dimension.  Scores grow dimension block by dimension block;
what the rest can add is bounded by the norms of the remaining components, and
candidates that can no longer reach a query's k best are dropped from the columns.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from beckon.llm.common import parts_for, stored

#: Dimensions added at once, and the rows of a block of candidates and of queries.
DIMENSIONS, CANDIDATES, QUERIES = 16, 4096, 2048


def quantized(vectors: DataFrame, levels: int = 256) -> DataFrame:
    """``vec_id, vec``: components as ``floor(levels * x)``.

    Left out are rows with a null id, a null or empty vector, or a component that is
    null or not finite.  Equal rows count once.
    """
    bad = F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return (vectors.where(F.col("vec_id").isNotNull() & (F.size("embedding") > 0) & ~bad)
            .select(F.col("vec_id").cast("long").alias("vec_id"), F.transform(
                "embedding", lambda x: F.floor(x.cast("double") * levels).cast("long")).alias("vec"))
            .distinct())


def best_in_block(queries: np.ndarray, block: np.ndarray, k: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Per query the places and scores of all candidates that reach its k-th best score.

    Sums are whole numbers; they are added as doubles where none can pass 2^53.
    """
    largest = float(np.abs(queries).max()) * float(np.abs(block).max()) * queries.shape[1]
    kind = np.float64 if largest < 2.0 ** 53 else np.int64
    columns = np.ascontiguousarray(block.T.astype(kind))
    queries = queries.astype(kind)
    starts = list(range(0, len(columns), DIMENSIONS))
    rest = lambda rows, d: np.sqrt((rows[:, d:].astype(np.float64) ** 2).sum(1))
    after = [s + DIMENSIONS for s in starts]
    block_rest = [rest(block, d) for d in after]
    query_rest = [rest(queries, d) for d in after]
    first = queries[:, :DIMENSIONS] @ columns[:DIMENSIONS]
    result = []
    for q in range(len(queries)):
        alive, sums, reached = None, first[q], -np.inf
        for b, start in enumerate(starts):
            if b:
                part = columns[start:after[b]]
                sums = sums + queries[q, start:after[b]] @ (part if alive is None else part[:, alive])
            # The square roots are rounded; the slack keeps the bound safe.
            slack = block_rest[b] if alive is None else block_rest[b][alive]
            slack = slack * (query_rest[b][q] * (1 + 1e-9)) + 1e-6 * (start + DIMENSIONS < len(columns))
            if len(sums) > k:
                least = sums - slack
                reached = max(reached, np.partition(least, len(least) - k)[len(least) - k])
            keep = sums + slack >= reached
            if not keep.all():
                alive = np.flatnonzero(keep) if alive is None else alive[keep]
                sums = sums[keep]
        result.append((np.arange(len(block)) if alive is None else alive, sums.astype(np.int64)))
    return result


def top_k(vectors: DataFrame, every: int = 50, k: int = 5) -> DataFrame:
    """``query_id, rank, vec_id, score`` of the k highest scores of each query.

    Queries are the vectors with ids divisible by ``every``; candidates are all but
    those with the query's own id; ties go to the smaller id; only vectors of the same
    length are compared.  Unequal vectors of one id are ranked each for itself.  Equal
    vectors are scored once: of a vector's ids the k + 1 smallest can matter.  Blocks of
    queries meet blocks of candidates and return k rows a query and as many more as a
    query's id has vectors, since those are not counted.  Runs jobs to size the blocks.
    """
    rows = stored(quantized(vectors), "quantized")
    # Filtering the row number lets every task drop surplus ids before the shuffle.
    few = rows.withColumn("__n", F.expr("row_number() OVER (PARTITION BY vec ORDER BY vec_id)")).where(
        F.col("__n") <= k + 1)
    candidates = stored(few.groupBy("vec").agg(F.sort_array(F.collect_list("vec_id")).alias("ids")), "candidates")
    asked = stored(rows.where(F.pmod("vec_id", F.lit(every)) == 0).select("vec").distinct()
                   .withColumn("query", F.monotonically_increasing_id()), "queries")
    own = rows.where(F.pmod("vec_id", F.lit(every)) == 0).groupBy("vec_id").count().agg(F.max("count")).first()[0] or 1
    most = k + own
    n_candidates, n_queries = candidates.count(), asked.count()
    blocks, groups = parts_for(n_candidates, CANDIDATES), parts_for(n_queries, QUERIES)
    left = asked.select(
        "query", "vec", F.size("vec").alias("dims"),
        F.pmod(F.xxhash64("vec"), F.lit(groups)).cast("int").alias("group"),
        F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"))
    right = candidates.select(
        "ids", "vec", F.size("vec").alias("dims"),
        F.pmod(F.xxhash64("vec"), F.lit(blocks)).cast("int").alias("block"),
        F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("group"))

    def meet(asked: pa.Table, block: pa.Table) -> pa.Table:
        queries, out = [], ([], [], [])
        if asked.num_rows and block.num_rows:
            flat = lambda t: t["vec"].combine_chunks().flatten().to_numpy().reshape(t.num_rows, -1)
            queries = asked["query"].to_pylist()
            ids = block["ids"].to_pylist()
            for query, (places, scores) in zip(queries, best_in_block(flat(asked), flat(block), most)):
                pairs = sorted((-s, i) for p, s in zip(places.tolist(), scores.tolist()) for i in ids[p])[:most]
                for score, vec_id in pairs:
                    for column, value in zip(out, (query, vec_id, -score)):
                        column.append(value)
        return pa.table([pa.array(c, pa.int64()) for c in out], ["query", "vec_id", "score"])

    keys = ("dims", "group", "block")
    met = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(
        meet, "query long, vec_id long, score long")
    best = met.withColumn("__n", F.expr(
        "row_number() OVER (PARTITION BY query ORDER BY score DESC, vec_id)")).where(F.col("__n") <= most)
    owners = rows.where(F.pmod("vec_id", F.lit(every)) == 0).join(asked, "vec").select(
        F.col("vec_id").alias("query_id"), "query")
    found = owners.join(best.drop("__n"), "query").where("query_id <> vec_id")
    return (found.withColumn("rank", F.expr(
        "int(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id))"))
        .where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score"))
