"""Exact top-k and sharding."""

import math
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from beckon.llm import sharding, topk
from beckon.llm.components import connected_components


@pytest.mark.parametrize("block", [4096, 16])
def test_top_k_matches_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(topk, "CANDIDATES", block)
    monkeypatch.setattr(topk, "QUERIES", 3)
    rng = random.Random(9)
    rows = [(i, [round(rng.gauss(0, 0.2), 2) for _ in range(40)]) for i in range(150)]
    rows += [(200 + i, rows[0][1]) for i in range(60)]  # copies, queries among them
    rows += [(300, None), (301, [None] + [0.1] * 39), (302, [float("nan")] * 40), (303, [float("inf")] * 40),
             (None, [0.5] * 40), (304, []), (0, rows[0][1]), (306, [0.1] * 3), (350, [0.2] * 3)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(3)
    good = {i: [math.floor(256 * float(np.float32(x))) for x in v] for i, v in rows
            if i is not None and v and all(x is not None and math.isfinite(x) for x in v)}
    expected = []
    for q, v in good.items():
        if q % 50 == 0:
            scored = sorted((-sum(a * b for a, b in zip(v, w)), i) for i, w in good.items()
                            if i != q and len(w) == len(v))
            expected += [(q, k + 1, i, -s) for k, (s, i) in enumerate(scored[:5])]
    assert sorted(map(tuple, topk.top_k(df).collect())) == sorted(expected)
    assert topk.top_k(df.limit(0)).count() == 0


def test_top_k_ranks_unequal_vectors_of_an_id(spark):
    rng = random.Random(4)
    vectors = lambda scale: [round(rng.gauss(0, scale), 2) for _ in range(20)]
    rows = [(i, vectors(0.2)) for i in range(1, 60)] + [(7, vectors(2.0)) for _ in range(30)]
    rows += [(0, vectors(0.4)) for _ in range(12)] + [(100, vectors(0.3))]
    good = {(i, tuple(math.floor(256 * float(np.float32(x))) for x in v)) for i, v in rows}
    expected = []
    for q in (0, 50, 100):
        scored = sorted((-sum(a * b for a, b in zip(v, w)), i) for j, v in good if j == q for i, w in good if i != q)
        expected += [(q, n + 1, i, -s) for n, (s, i) in enumerate(scored[:5])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(3)
    assert sorted(map(tuple, topk.top_k(df).collect())) == sorted(expected)


def test_shards_are_exact_and_repeatable(spark, monkeypatch):
    monkeypatch.setattr(sharding, "RANK_ROWS", 20)
    monkeypatch.setattr(sharding, "LEVELS", 2)
    docs = spark.range(1003).select(F.col("id").alias("doc_id"), F.lit("t").alias("text")).repartition(11)
    got = sharding.shard(docs, 16).collect()
    slots = defaultdict(list)
    for r in got:
        slots[r.shard].append(r.slot)
    assert sorted(map(len, slots.values())) == [62] * 5 + [63] * 11
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert len({r.doc_id for r in got}) == 1003


def test_matrix_adds_up(spark):
    counts = spark.createDataFrame([(i, n) for i, n in enumerate([5, 0, 1000, 77, 3, 300, 1])], "part int, rows long")
    rows = sharding.communication_matrix(counts, 5).collect()
    assert {r.part: sum(r.sent) for r in rows} == dict(enumerate([5, 0, 1000, 77, 3, 300, 1]))
    assert [sum(r.sent[k] for r in rows) for k in range(5)] == [278, 277, 277, 277, 277]
    assert all(x >= 0 for r in rows for x in r.sent)


@pytest.mark.parametrize("n, good, total", [(10, 4, 30), (400, 700, 1000), (3, 3, 3), (50, 1, 60)])
def test_draws_follow_the_law(spark, n, good, total):
    draw = sharding.hypergeometric("u", f"{n}L", f"{good}L", f"{total}L")
    many = 4000
    got = Counter(r.x for r in spark.range(many).selectExpr(f"(id + 0.5D) / {many} AS u").selectExpr(
        f"{draw} AS x").collect())
    for x, seen in got.items():
        p = math.comb(good, x) * math.comb(total - good, n - x) / math.comb(total, n)
        assert abs(seen - many * p) <= 2


def test_components_of_chains_and_stars(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 30)] + [(7, 7), (205, 200)]
    got = {r.node: r.component for r in connected_components(
        spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, **{100 + i: 100 for i in range(30)}, 200: 200, 205: 200}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0
