"""Registered queries against SQL, contracts and brute force on the smallest tables."""

import hashlib
import math
import os
import zlib
from collections import Counter, defaultdict

import pytest

import __spark_entry__ as entry
import corpus_pipeline
from beckon.llm.queries import ORACLES, QUERIES, vocabulary_path
from oracles import TABLES
from tests.llm.test_documents import WORD, brute_sets
from tools.check import rows_of

SMALL = entry.SMALL
pytestmark = pytest.mark.skipif(not os.path.isdir(SMALL), reason="tables not present")


@pytest.fixture(scope="module")
def con():
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for table in TABLES:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SMALL}/{table}.parquet'")
    return con


@pytest.fixture(scope="module")
def documents(con):
    return con.execute("SELECT doc_id, text, lang, source FROM documents ORDER BY doc_id").fetchall()


def test_all_are_registered():
    assert set(QUERIES) | {"pipeline"} <= set(entry.queries())
    assert set(ORACLES) <= set(entry.oracle_sql())
    assert {n.split("_")[0] for n in QUERIES} == {f"op{i}" for i in range(1, 14)}


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_sql(spark, con, name):
    df = QUERIES[name](spark, SMALL)
    cursor = con.execute(ORACLES[name])
    columns = [c[0] for c in cursor.description]
    assert sorted(columns) == sorted(df.columns)
    assert rows_of(df.columns, [tuple(r) for r in df.collect()]) == rows_of(columns, cursor.fetchall())


def test_shards(spark, documents):
    rows = QUERIES["op1_uniform_shards"](spark, SMALL).collect()
    texts = {d[0]: d[1] for d in documents}
    assert sorted(r.doc_id for r in rows) == sorted(texts)
    slots = defaultdict(list)
    for r in rows:
        data = (texts[r.doc_id] or "").encode()
        assert (r.size, r.text_crc32, r.law, r.grown_shard) == (len(data) + 1, zlib.crc32(data), "rows", None)
        slots[r.shard].append(r.slot)
    assert set(slots) == set(range(16))
    sizes = [len(s) for s in slots.values()]
    assert max(sizes) - min(sizes) <= 1
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_language_of_held_out_rows(spark, documents):
    rows = QUERIES["op8_language_id"](spark, SMALL).collect()
    lang = {d[0]: d[2] for d in documents}
    held = [r for r in rows if r.held_out]
    assert len(rows) == len(documents) and held
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in rows)
    assert sum(r.lang_pred == lang[r.doc_id] for r in held) >= 0.95 * len(held)


def test_toxicity_contract(spark, documents):
    rows = QUERIES["op3_toxicity"](spark, SMALL).collect()
    assert len(rows) == len(documents)
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in rows)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)


def toxic_found(spark, sf_dir):
    """Toxic documents found, all of them and false alarms, in the held-out fold and in the others."""
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect() if r.toxic is not None}
    found = {True: [0, 0, 0], False: [0, 0, 0]}
    for r in QUERIES["op3_toxicity"](spark, sf_dir).collect():
        if r.doc_id in labels:
            row = found[r.held_out]
            row[0] += r.predicted and labels[r.doc_id]
            row[1] += labels[r.doc_id]
            row[2] += r.predicted and not labels[r.doc_id]
    return found


@pytest.mark.parametrize("size, held, rest, alarms", [("sf0.001", (1, 1), 5, 1), ("sf0.01", (4, 6), 30, 3)])
def test_toxicity_learns_from_small_tables(spark, size, held, rest, alarms):
    folder = os.path.join(os.path.dirname(SMALL), size)
    if not os.path.isdir(folder):
        pytest.skip("table not present")
    found = toxic_found(spark, folder)
    assert found[True][0] >= held[0] and found[True][1] == held[1] and found[False][0] >= rest
    assert max(found[True][2], found[False][2]) <= alarms


def test_toxicity_tokens_match_brute_force(spark, con):
    from beckon.llm import toxicity

    rows = con.execute("SELECT doc_id, text, toxic FROM documents JOIN labels USING (doc_id)").fetchall()
    counts, total = defaultdict(lambda: [0, 0]), [0, 0]
    for text, toxic in {r[1:] for r in rows}:  # equal rows count once
        for token in toxicity.tokens_of(text or ""):
            counts[token][toxic] += 1
            total[toxic] += 1
    share, want = total[1] / sum(total), {}
    for token, (other, toxic) in counts.items():
        n = other + toxic
        ratio = sum(2 * x * math.log(x / (n * p)) for x, p in ((toxic, share), (other, 1 - share)) if x)
        if math.sqrt(max(0, ratio)) >= toxicity.LEAST_Z:
            prior = toxicity.FLOOR + toxicity.PRIOR * n / sum(total)
            odds = [math.log((x + prior) / (t + toxicity.PRIOR - x - prior)) for x, t in zip((other, toxic), total)]
            want[token] = odds[1] - odds[0] - toxicity.DRIFT
    model = toxicity.fit(spark.createDataFrame(rows, "doc_id long, text string, toxic int"))
    assert want and set(model.scores) == set(want)
    assert all(abs(model.scores[t] - want[t]) < 1e-9 for t in want)
    # every maximal segment: no longer one scores more, and no part of it does
    rng = [(3, 2.0), (4, -1.5), (6, 1.0), (7, 3.0), (30, 1.0), (31, 0.5)]
    values = [dict(rng).get(i, -toxicity.DRIFT) for i in range(40)]
    best = max((sum(values[a:b + 1]), a, b) for a in range(40) for b in range(a, 40))
    got = toxicity.segments(rng)
    assert max((round(x, 9), a, b) for a, b, x in got) == (round(best[0], 9), *best[1:])


def lines_gone(texts):
    """By (id, place): whether an earlier line is similar, by comparing each with all before."""
    seen, gone = [], set()
    index = defaultdict(set)
    for doc, text in sorted(texts.items()):
        for at, line in enumerate(text.split("\n")):
            s = frozenset(WORD.findall(line.lower()))
            if s:
                near = Counter(i for w in s for i in index[w])
                if any(100 * n >= 80 * (len(s) + len(seen[i]) - n) for i, n in near.items()):
                    gone.add((doc, at))
                for w in s:
                    index[w].add(len(seen))
                seen.append(s)
    return gone


def test_line_dedup(spark, documents):
    texts = {d[0]: d[1] for d in documents}
    gone = lines_gone(texts)
    for r in QUERIES["op5_line_dedup"](spark, SMALL).collect():
        mine = [at for at in range(texts[r.doc_id].count("\n") + 1) if (r.doc_id, at) in gone]
        assert r.removed_lines == ",".join(map(str, mine)) and r.n_removed == len(mine)


def first_of_group(texts):
    ids = sorted(texts)
    sets = brute_sets([texts[i] for i in ids])
    parent = list(range(len(ids)))

    def find(x):
        return x if parent[x] == x else find(parent[x])

    for a in range(len(ids)):
        for b in range(a):
            n = len(sets[a] & sets[b])
            if n and 100 * n >= 80 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {ids[find(x)] for x in range(len(ids))}


def mixed(rows):
    """Copies of each document, by the contract's shares and the digest of its id."""
    size = {d: len(WORD.findall(t)) for d, t, _ in rows}
    total = defaultdict(int)
    for d, _, s in rows:
        total[s] += size[d]
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(sorted(total))}
    open_, left, target = set(total), 1.5 * sum(total.values()), {}
    while open_:
        level = left / sum(weight[s] for s in open_)
        full = {s for s in open_ if 2.0 * total[s] <= weight[s] * level}
        if not full:
            break
        target.update((s, 2.0 * total[s]) for s in full)
        left -= sum(2.0 * total[s] for s in full)
        open_ -= full
    target.update((s, weight[s] * level) for s in open_)
    copies = {}
    for d, _, s in rows:
        rate = target[s] / total[s]
        draw = int(hashlib.md5(f"0:{d}".encode()).hexdigest()[:12], 16) / 2 ** 48
        copies[d] = math.floor(rate) + (draw < rate - math.floor(rate))
    return copies


def test_pipeline_matches_brute_force(spark, documents):
    from tokenizers import Tokenizer

    docs = {d: (t, s) for d, t, _, s in documents if t and any(c.isalpha() for c in t)}
    gone = lines_gone({d: t for d, (t, _) in docs.items()})
    texts = {}
    for d, (t, _) in docs.items():
        lines = t.split("\n")
        rest = [x for at, x in enumerate(lines) if (d, at) not in gone]
        if any(WORD.search(x) for x in rest) or not any(WORD.search(x) for x in lines):
            texts[d] = "\n".join(rest)
    kept = first_of_group(texts)
    copies = mixed([(d, texts[d], docs[d][1]) for d in kept])
    tokenizer = Tokenizer.from_file(vocabulary_path())
    expected = Counter()
    for d, n in copies.items():
        ids = tokenizer.encode(texts[d], add_special_tokens=False).ids + [1]
        for k in range(0, len(ids), 4096):
            own = b"".join(i.to_bytes(4, "little") for i in ids[k:k + 4096])
            expected[d, k // 4096, k, len(own) // 4, zlib.crc32(own)] += n
    rows = corpus_pipeline.run(spark, SMALL).collect()
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == +expected
    bins = defaultdict(list)
    for r in rows:
        bins[r.sequence_id].append((r.offset, r.length))
    for b in bins.values():
        b.sort()
        assert [a for a, _ in b] == [sum(n for _, n in b[:k]) for k in range(len(b))]
        assert sum(n for _, n in b) <= 4096
    assert len(bins) <= math.ceil(sum(r.length for r in rows) / 4096) + 1


def test_stages_take_odd_and_empty_documents(spark):
    from tests.llm.test_documents import odd_rows, table

    docs = table(spark, odd_rows())
    for rows in (docs, docs.limit(0)):
        for name, stage in corpus_pipeline.STAGES:
            before = rows.columns
            rows = corpus_pipeline.stored(stage(spark, rows, SMALL), f"test-{name}")
            assert name == corpus_pipeline.STAGES[-1][0] or rows.columns == before
        rows.count()


def test_unlabelled_documents_stay(spark):
    from tests.llm.test_documents import table

    rows = [(1, "plain text", None, "a"), (2, "12 #!", None, "a"), (3, None, None, "a"), (4, "é", None, None), (5, "", None, "a")]
    docs = table(spark, rows)
    kept = corpus_pipeline.known_language(spark, docs, SMALL)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == [1, 4]
    labelled = docs.withColumn("lang", corpus_pipeline.F.lit("en"))
    assert sorted(r.doc_id for r in corpus_pipeline.known_language(spark, labelled, SMALL).collect()) == [1, 4]
