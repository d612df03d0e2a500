"""Uniform shuffle into shards of exact sizes by a communication matrix.

How many rows each source partition sends to each shard is drawn first, from the
multivariate hypergeometric law that a uniform permutation of all rows would give.
Then rows are permuted within their partition, dealt out by the drawn counts, and
permuted again within their shard.  Only DataFrame and SQL functions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from beckon.llm.common import parts_for, stored, without

RESULTS = ("shard", "slot")
#: Rows of a shard that are ranked in one task.
RANK_ROWS = 100_000
#: Levels of the tree of draws between two writes.
LEVELS = 6


def _let(names: dict[str, str], body: str) -> str:
    """SQL: ``body`` with names for expressions, as fields of ``v``."""
    fields = ", ".join(f"{e} AS {n}" for n, e in names.items())
    return f"element_at(transform(array(struct({fields})), v -> {body}), 1)"


def hypergeometric(u: str, n: str, good: str, total: str) -> str:
    """SQL for a draw: how many of ``n`` taken from ``total`` are among its ``good``.

    By inversion of ``u``.  Weights relative to the mode follow from the ratio of
    neighbours, within twelve deviations and 20 of the mode; so no factorials.
    """
    up = "double(v.k - x) * (v.n - x) / (double(x + 1) * (v.t - v.k - v.n + x + 1))"
    down = "double(x) * (v.t - v.k - v.n + x) / (double(v.k - x + 1) * (v.n - x + 1))"
    mass = lambda xs, ratio: (
        f"aggregate({xs}, struct(1D AS w, 0D AS sum), (s, x) ->"
        f" struct(s.w * {ratio} AS w, s.sum + s.w * {ratio} AS sum), s -> s.sum)")
    walk = lambda xs, ratio, first, step: (
        f"aggregate({xs}, struct(1D AS w, {first} AS sum, v.m AS at), (s, x) -> if(s.sum > v.u, s,"
        f" struct(s.w * {ratio} AS w, s.sum + s.w * {ratio} AS sum, x + {step} AS at)), s -> s.at)")
    ups, downs = "v.ups", "v.downs"
    picked = _let(
        {"u": f"v.u * (1D + v.right + v.left)", "m": "v.m", "k": "v.k", "n": "v.n", "t": "v.t",
         "ups": ups, "downs": downs, "right": "v.right"},
        f"if(v.u < 1D + v.right, {walk('v.ups', up, '1D', '1L')},"
        f" {walk('v.downs', down, '1D + v.right', '-1L')})")
    masses = _let(
        {"u": "v.u", "m": "v.m", "k": "v.k", "n": "v.n", "t": "v.t", "ups": ups, "downs": downs,
         "right": mass("v.ups", up), "left": mass("v.downs", down)}, picked)
    ranges = _let(
        {"u": "v.u", "m": "v.m", "k": "v.k", "n": "v.n", "t": "v.t",
         "ups": "if(least(v.high, v.m + v.wide) > v.m, sequence(v.m, least(v.high, v.m + v.wide) - 1), array())",
         "downs": "if(greatest(v.low, v.m - v.wide) < v.m, sequence(v.m, greatest(v.low, v.m - v.wide) + 1), array())"},
        masses)
    mode = _let(
        {"u": "v.u", "k": "v.k", "n": "v.n", "t": "v.t", "low": "v.low", "high": "v.high",
         "m": "greatest(v.low, least(v.high, bigint(floor(double(v.n + 1) * (v.k + 1) / (v.t + 2)))))",
         "wide": "bigint(20 + 12 * sqrt(greatest(0D, double(v.n) * v.k / v.t * (v.t - v.k) / v.t"
                 " * (v.t - v.n) / greatest(1, v.t - 1))))"}, ranges)
    ends = _let(
        {"u": u, "k": good, "n": n, "t": total,
         "low": f"greatest(0L, {n} - ({total} - {good}))", "high": f"least({n}, {good})"}, mode)
    return f"if({n} = 0 OR {good} = 0, 0L, {ends})"


def _uniform(*keys: str) -> str:
    return f"pmod(xxhash64({', '.join(keys)}), {1 << 53}) / double({1 << 53})"


def communication_matrix(counts: DataFrame, shards: int, seed: int = 0) -> DataFrame:
    """``part, sent``: rows that each source partition sends to each shard.

    ``counts`` has ``part, rows``.  A tree over the partitions is split in halves: a
    node draws how its shards' rows fall on the left half, shard by shard, and the
    right half gets the rest.  So rows and columns add up exactly, and nodes of a
    level are independent.  A row holds one number a partition at most.
    """
    spark = counts.sparkSession
    tree = counts.agg(
        F.sort_array(F.collect_list(F.struct("part", "rows"))).alias("parts"),
        F.coalesce(F.sum("rows"), F.lit(0)).cast("long").alias("n")).where(F.size("parts") > 0)
    tree = stored(tree.selectExpr("parts", f"transform(sequence(0, {shards - 1}), s ->"
                                  f" n DIV {shards} + if(s < n % {shards}, 1L, 0L)) AS sent"), "shard-counts")
    levels = max(0, ((tree.agg(F.max(F.size("parts"))).first()[0] or 1) - 1).bit_length())
    draw = hypergeometric(
        _uniform(str(seed), "parts[0].part", "size(parts)", "size(s.sent)"), "s.n", "k", "s.total")
    half = "aggregate(slice(parts, 1, size(parts) DIV 2), 0L, (a, p) -> a + p.rows)"
    whole = "aggregate(parts, 0L, (a, p) -> a + p.rows)"
    # The draw is in the state, so that what is left counts it once.
    drawn = (
        f"aggregate(sent, struct({half} AS n, {whole} AS total, cast(array() AS array<bigint>) AS sent),"
        f" (s, k) -> " + f"element_at(transform(array({draw}), d -> struct(s.n - d AS n, s.total - k AS total,"
        " concat(s.sent, array(d)) AS sent)), 1), s -> s.sent)")
    for level in range(levels):
        tree = (
            tree.withColumn("left", F.expr(f"if(size(parts) = 1, sent, {drawn})"))
            .withColumn("node", F.explode(F.expr(
                "if(size(parts) = 1, array(struct(parts, sent)), array("
                "struct(slice(parts, 1, size(parts) DIV 2) AS parts, left AS sent),"
                "struct(slice(parts, size(parts) DIV 2 + 1, size(parts)) AS parts,"
                " zip_with(sent, left, (a, b) -> a - b) AS sent)))")))
            .select("node.parts", "node.sent"))
        if (level + 1) % LEVELS == 0:
            tree = stored(tree.repartition(F.expr("parts[0].part")), "shard-tree")
    return tree.selectExpr("parts[0].part AS part", "sent")


def shard(docs: DataFrame, shards: int = 16, seed: int = 0) -> DataFrame:
    """All rows and columns with ``shard`` (from 0) and ``slot`` (gapless from 0).

    Shard sizes differ by one at most and every assignment is as likely as any other,
    up to the hash that orders rows.  Rows are numbered when they are first written
    to the shared folder, so a lost executor changes nothing later; nulls and
    repeated rows are rows like others.  Input columns named like a result are
    replaced.  Planning moves 16 bytes a row; texts are exchanged once, to their shard.
    """
    numbered = stored(
        without(docs, RESULTS).withColumn("__part", F.spark_partition_id())
        .withColumn("__row", F.monotonically_increasing_id()), "shard-rows")
    rows = numbered.select("__part", "__row")
    counts = rows.groupBy(F.col("__part").alias("part")).agg(F.count("*").alias("rows"))
    matrix = stored(communication_matrix(counts, shards, seed), "shard-matrix").selectExpr(
        "part", "transform(sequence(1, size(sent)), i ->"
        " aggregate(slice(sent, 1, i), 0L, (a, x) -> a + x)) AS upto")
    total = numbered.count()
    parts = parts_for(total, shards * RANK_ROWS)
    dealt = (
        rows.withColumn("__first", F.expr(
            f"row_number() OVER (PARTITION BY __part ORDER BY xxhash64({seed}L, 1, __row), __row)"))
        .join(matrix, F.col("__part") == F.col("part"))
        .select("__row", F.expr("size(filter(upto, x -> x < __first))").alias("shard"))
        .withColumn("__second", F.expr(f"xxhash64({seed}L, 2, __row)"))
        .withColumn("__range", F.expr(f"int(pmod(__second, {parts}))")))
    dealt = stored(dealt, "shard-dealt") if parts > 1 else dealt
    slot = F.expr("row_number() OVER (PARTITION BY shard, __range ORDER BY __second, __row) - 1").cast("long")
    placed = dealt.withColumn("slot", slot)
    if parts > 1:
        before = dealt.groupBy("shard", "__range").count().selectExpr(
            "shard AS __shard", "__range AS __of",
            "sum(count) OVER (PARTITION BY shard ORDER BY __range) - count AS __before")
        placed = placed.join(before, (F.col("shard") == F.col("__shard")) & (
            F.col("__range") == F.col("__of"))).withColumn("slot", F.col("slot") + F.col("__before"))
    placed = placed.select(F.col("__row").alias("__at"), "shard", "slot")
    return numbered.join(placed, F.col("__row") == F.col("__at")).drop("__part", "__row", "__at")


def write_shards(sharded: DataFrame, path: str) -> None:
    """One folder a shard, rows in slot order, files of bounded ranges of slots."""
    (sharded.repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot")
     .write.partitionBy("shard").parquet(path))
