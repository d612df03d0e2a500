"""Blocked comparisons, salted lookups and top-k against brute force."""

import math
import random
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from beckon import lexicons as L
from beckon.operators import evidence as ev
from beckon.operators import history as hist
from beckon.operators.consistency import enforce_consistency
from beckon.operators.joins import hot_keys, lookup
from beckon.operators.model import stratified_split
from beckon.sources.tables import SCHEMAS

WORDS = "lake tree road bread train paper cloud music stone river lamp chair".split()


def make_rows(n, seed, users=3):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        kind = rng.choice(["personal", "group", "business"])
        # one user holds most of the rows, and copies of one text abound
        user = "u_0" if rng.random() < 0.6 else f"u_{rng.randrange(users)}"
        text = "road tree lake bread" if rng.random() < 0.3 else " ".join(
            rng.choices(WORDS, k=rng.randint(1, 7)))
        rows.append((f"x{seed}_{i}", user, f"s_{rng.randrange(4)}" if kind != "business" else None,
                     f"g_{rng.randrange(2)}" if kind == "group" else None,
                     f"b_{rng.randrange(2)}" if kind == "business" else None, kind,
                     f"2024-01-{rng.randint(1, 28):02d} {rng.randrange(24):02d}:00:00", text))
    return rows


@pytest.fixture(scope="module")
def data(spark):
    def frame(rows):
        schema = SCHEMAS["message_history"].replace("created_at timestamp", "created_at string")
        return spark.createDataFrame(rows, schema).withColumn(
            "created_at", F.to_timestamp("created_at"))

    past, new = make_rows(160, 1), make_rows(60, 2)
    return past, new, frame(past), frame(new)


def brute_top(past, new, k=3, only_older=False):
    def terms(text):
        words = [w for w in re.findall(r"\w\w+", text.lower()) if w not in L.STOP_WORDS]
        return words + [f"{a} {b}" for a, b in zip(words, words[1:])]

    counts = [Counter(terms(r[7])) for r in past]
    cf, df = Counter(), Counter()
    for c in counts:
        cf.update(c)
        df.update(c.keys())
    vocab = sorted(cf, key=lambda t: (-cf[t], t))[:500]
    idf = {t: math.log((1 + len(past)) / (1 + df[t])) + 1 for t in vocab}

    def unit(c):
        w = {t: n * idf[t] for t, n in c.items() if t in idf}
        norm = math.sqrt(sum(x * x for x in w.values())) or 1.0
        return {t: x / norm for t, x in w.items()}

    vectors = [unit(c) for c in counts]
    out = {}
    for m in new:
        if len(m[7]) < 10:
            continue
        # only older rows exist for a message, in the choice of the scope too
        own = [i for i, r in enumerate(past) if r[1] == m[1] and not (only_older and r[6] >= m[6])]
        scope = own
        for position in (2, 3, 4):
            if len(scope) == len(own) and m[position]:
                inside = [i for i in own if past[i][position] == m[position]]
                scope = inside or scope
        if not scope:
            continue
        days = {i: int(past[i][6][8:10]) + int(past[i][6][11:13]) / 24 for i in scope}
        newest = max(days.values())
        vector = unit(Counter(terms(m[7])))
        scored = []
        for i in scope:
            score = sum(w * vectors[i].get(t, 0.0) for t, w in vector.items())
            score = round(score + 0.15 * math.exp(-(newest - days[i]) / 60), 6)
            if score > 0.2:
                scored.append((score, past[i][6], past[i][0]))
        best = sorted(scored, reverse=True)[:k]
        if best:
            out[m[0]] = [b[2] for b in best]
    return out


@pytest.mark.parametrize("block_rows, only_older", [(4, False), (2048, False), (5, True)])
def test_top_evidence_is_exact(data, block_rows, only_older):
    past, new, past_df, new_df = data
    model = ev.TfIdf.fit(past_df)
    top = ev.top_evidence(new_df, past_df, model, block_rows=block_rows,
                          point_in_time=only_older)
    got = defaultdict(list)
    for row in sorted(top.collect(), key=lambda r: (r["message_id"], r["rank"])):
        got[row["message_id"]].append(row["evidence_id"])
    assert dict(got) == brute_top(past, new, only_older=only_older)


def test_blocks_below_the_bound_are_skipped(spark):
    rng = random.Random(5)
    topics = [[f"{a}{b}" for b in "lake tree road bread train paper cloud".split()] for a in "abcdefgh"]

    def frame(n, prefix):
        rows = [(f"{prefix}{i}", "u", None, None, None, "personal", f"2024-01-{1 + i % 28:02d} 08:00:00",
                 " ".join(rng.sample(topics[i % 8], 4))) for i in range(n)]
        schema = SCHEMAS["message_history"].replace("created_at timestamp", "created_at string")
        return rows, spark.createDataFrame(rows, schema).withColumn("created_at", F.to_timestamp("created_at"))

    past, past_df = frame(400, "p")
    new, new_df = frame(40, "n")
    visits = []
    top = ev.top_evidence(new_df, past_df, ev.TfIdf.fit(past_df), block_rows=10, visits=visits)
    got = defaultdict(list)
    for row in sorted(top.collect(), key=lambda r: (r["message_id"], r["rank"])):
        got[row["message_id"]].append(row["evidence_id"])
    assert dict(got) == brute_top(past, new)
    made = visits[0].visits.join(visits[0].blocks, "block").agg(F.sum("block_rows"), F.count_distinct("query_id")).first()
    rows = visits[0].blocks.agg(F.sum("block_rows")).first()[0]
    # all texts meet in one scope; most pairs of a message and a past row are never scored
    assert made[0] < 0.5 * made[1] * rows
    assert visits[0].visits.distinct().count() == visits[0].visits.count()


def test_counts_move_and_give_the_unit_vectors(spark, data):
    """What travels are small counts; weighed where they meet they are the vectors of the model."""
    from beckon.operators.pruned import dense

    past_df = data[2]
    model = ev.TfIdf.fit(past_df)
    moved = dict(ev.weighed(past_df, model).vectors.dtypes)
    assert moved["term_ids"] == "array<smallint>" and moved["counts"] == "array<int>" and "weights" not in moved
    both = model.vectors(model.counts(past_df).withColumnRenamed("term_ids", "ids").where("size(ids) > 0")).where(
        "size(term_ids) > 0")
    rows = both.selectExpr("ids AS term_ids", "counts", "weights").toArrow()
    assert rows.num_rows > 100
    made, want = dense(rows, len(model.terms), model.idf), dense(rows, len(model.terms))
    assert abs(made - want).max() < 1e-12


def test_topic_similarity_by_hand(spark, data):
    """The mean cosine with the evidence; a text without a known term is like no other."""
    past_df, new_df = data[2], data[3].limit(20).unionByName(
        data[3].limit(1).withColumns({"message_id": F.lit("odd"), "message_text": F.lit("zzz qqq xxx")}))
    model = ev.TfIdf.fit(past_df)

    def units(df):
        return {r["message_id"]: dict(zip(r["term_ids"], r["weights"])) for r in model.vectors(df).collect()}

    past, new = units(past_df), units(new_df)
    lists = {m: [f"x1_{i}", f"x1_{i + 7}", f"x1_{i}"] for i, m in enumerate(new)}
    evidence = spark.createDataFrame([(m, ";".join(ids)) for m, ids in lists.items()],
                                     "message_id string, evidence_message_ids string")
    got = {r["message_id"]: r["topic_similarity"] for r in ev.topic_similarity(new_df, evidence, past_df, model).collect()}
    want = {m: sum(sum(w * past[e].get(t, 0.0) for t, w in new[m].items()) for e in set(ids)) / 2
            for m, ids in lists.items()}
    assert got["odd"] == 0.0 and got == pytest.approx(want)


def test_latest_row_moves_once(spark):
    """The latest row per key, nulls before values, without a second copy of the row as its rank."""
    rows = [("a", 1, "x", None), ("a", 2, None, 5), ("a", 2, "y", None), ("b", None, "z", 1), ("b", None, "z", 2),
            (None, 3, "n", 1), (None, 4, "m", None)]
    df = spark.createDataFrame(rows, "k string, at int, name string, n int")
    latest = hist._latest(df.select("k", "name", "at", "n"), ["k"], "at")
    assert latest.columns == ["k", "name", "at", "n"]
    assert {tuple(r) for r in latest.collect()} == {("a", "y", 2, None), ("b", "z", None, 2), (None, "m", 4, None)}
    assert "max_by" not in latest._jdf.queryExecution().executedPlan().toString()


def test_small_scopes_meet_in_bins_of_half_a_block(spark):
    """Scopes of a few rows share bins; most messages are sent to one part of their bin."""
    rows = [(f"p{i}", f"u{i % 60}", None, None, None, "personal", f"2024-01-{1 + i % 28:02d} 08:00:00",
             " ".join(WORDS[(i * j) % 12] for j in range(1, 6)) + f" w{i}") for i in range(600)]
    schema = SCHEMAS["message_history"].replace("created_at timestamp", "created_at string")
    df = spark.createDataFrame(rows, schema).withColumn("created_at", F.to_timestamp("created_at"))
    visits = []
    ev.top_evidence(df, df, ev.TfIdf.fit(df), block_rows=100, visits=visits)
    bins = visits[0].bins
    sizes = [r["block_rows"] for r in bins.collect()]
    assert len(sizes) >= 2 * sum(sizes) // 100 - 2
    assert sum(n for n in sizes if n > 100) < sum(sizes) / 2


def test_words_of_dismissals_move_as_texts():
    import pyarrow as pa

    left = pa.table({"message_id": ["m", "o"], "words": ["a b c d", "a b x"], "place": pa.nulls(2, pa.int32()),
                     "at": pa.nulls(2, pa.int64())})
    right = pa.table({"text_key": ["k", "l"], "words": ["b c d e", "a b c"], "copies": [2, 3],
                      "place": pa.nulls(2, pa.int32()), "at": pa.nulls(2, pa.int64())})
    assert hist._count_overlaps(left, right).to_pydict() == {"message_id": ["m"], "similar_dismissals": [5]}


@pytest.mark.parametrize("block_rows", [3, 1024])
def test_similar_dismissals_is_exact(spark, data, block_rows):
    past, new, past_df, new_df = data
    reactions = past_df.select("user_id", "message_id", (F.crc32("message_id") % 2).cast("int")
                               .alias("notification_dismissed"))
    gone = {r["message_id"] for r in reactions.where("notification_dismissed = 1").collect()}
    got = {r["message_id"]: r["similar_dismissals"] for r in hist.similar_dismissals(
        new_df.unionAll(new_df.where("message_id IN ('x2_3', 'x2_4', 'x2_5')")), reactions, past_df, block_rows).collect()}
    want = {}
    for m in new:
        n = sum(len(set(m[7].split()) & set(r[7].split())) >= 3
                for r in past if r[0] in gone and r[1] == m[1])
        if n:  # a message that comes twice counts twice
            want[m[0]] = float(n) * (2 if m[0] in ("x2_3", "x2_4", "x2_5") else 1)
    assert got == want


def test_similar_dismissals_as_of(spark, data):
    past, new, past_df, new_df = data
    reactions = past_df.select("user_id", "message_id", (F.crc32("message_id") % 2).cast("int").alias("notification_dismissed"),
                               F.unix_micros("created_at").alias("at"))
    gone = {r["message_id"] for r in reactions.where("notification_dismissed = 1").collect()}
    got = {r["message_id"]: r["similar_dismissals"] for r in hist.similar_dismissals(
        new_df, reactions, past_df, 5, point_in_time=True).collect()}
    want = {}
    for m in new:
        n = sum(len(set(m[7].split()) & set(r[7].split())) >= 3
                for r in past if r[0] in gone and r[1] == m[1] and r[6] < m[6])
        if n:
            want[m[0]] = float(n)
    assert got == want


def test_salted_lookup_equals_plain_join(spark, data):
    _, _, past_df, _ = data
    stats = past_df.groupBy("user_id").agg(F.count(F.lit(1)).alias("n"))
    hot = hot_keys(past_df, ["user_id"], hot_rows=10)
    assert hot.where("user_id = 'u_0'").first()["_salts"] > 1
    plain = past_df.join(stats, "user_id", "left").select("message_id", "n")
    salted = lookup(past_df, stats, ["user_id"], "message_id", hot).select("message_id", "n")
    assert sorted(map(tuple, plain.collect())) == sorted(map(tuple, salted.collect()))
    assert hot_keys(past_df, ["user_id"]).count() == 0


def test_consistency_copies_the_best_row(spark, make_messages):
    messages = make_messages(*[{"message_text": t, "created_at": c} for t, c in [
        ("Same", "2024-02-01 10:00:00"), (" same ", "2024-02-01 11:00:00"),
        ("SAME", "2024-02-01 09:00:00"), ("other", "2024-02-01 09:00:00")]])
    decided = messages.withColumns({
        "action": F.col("message_id"), "message_type": F.lit("personal"), "reason": F.lit("r"),
        "confidence": F.when(F.col("message_id") == "m1", 0.5).otherwise(0.8),
        "evidence_message_ids": F.lit("none")})
    got = {r["message_id"]: r["action"] for r in enforce_consistency(decided).collect()}
    assert got == {"m0": "m2", "m1": "m2", "m2": "m2", "m3": "m3"}


def test_split_is_exact_per_class(spark):
    df = spark.range(1000).selectExpr("id", "if(id % 10 = 0, 'rare', 'common') AS label")
    split = stratified_split(df, "label", "id", digits=1)
    counts = {(r["label"], r["is_test"]): r["count"]
              for r in split.groupBy("label", "is_test").count().collect()}
    assert counts == {("rare", True): 20, ("rare", False): 80,
                      ("common", True): 180, ("common", False): 720}


def test_group_and_business_features(spark):
    members = spark.createDataFrame(
        [("g", "u", "admin", "2024-01-01", 4, 2, 9, 0, 1), ("h", "u", "member", "2024-01-01", 1,
                                                            0, 5, 0, 0)],
        SCHEMAS["group_members"].replace("joined_at date", "joined_at string"))
    rows = {r["group_id"]: r for r in hist.group_features(members).collect()}
    assert rows["g"]["group_engagement_rate"] == 1.0 and rows["g"]["is_group_admin"] == 1.0
    assert rows["h"]["group_engagement_rate"] == 0.0 and rows["h"]["group_is_muted"] == 0.0


@pytest.mark.parametrize("stop", [[], ["lake", "the"]])
def test_own_stop_words_hold_for_vectors(spark, stop):
    from beckon.operators.evidence import TfIdf

    texts = ["the lake to the hill", "to the lake", "a hill and the lake"]
    df = spark.createDataFrame([(str(i), t) for i, t in enumerate(texts)], "message_id string, message_text string")
    model = TfIdf.fit(df, stop_words=stop)
    for row in model.vectors(df).collect():
        words = [w for w in row.message_text.split() if len(w) > 1 and w not in stop]
        terms = set(words) | {f"{a} {b}" for a, b in zip(words, words[1:])}
        assert {model.terms[int(i)] for i in row.term_ids} == terms


def test_an_account_that_occurs_twice_gives_one_row(spark, make_messages):
    from beckon.operators.rules import with_business_risk

    accounts = spark.createDataFrame(
        [("b_1", 1, None, None, 10, 0), ("b_1", 1, None, None, 20, 30), ("b_2", 1, None, None, 5, 0)],
        "business_id string, verified int, official_domain string, domain_used_by_sender string, "
        "account_age_days int, user_reports_30d int")
    messages = make_messages({"business_id": "b_1"}, {"business_id": "b_2"}, {}, {"business_id": ""})
    got = {r.message_id: r.high_risk_business for r in with_business_risk(messages, accounts).collect()}
    assert got == {"m0": True, "m1": False, "m2": False, "m3": False}
