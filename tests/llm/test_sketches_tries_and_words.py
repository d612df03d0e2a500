"""SetSketch near duplicates, the prefix trie and spelling variants against brute force."""

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from beckon.llm import prefix_trie, sketch_join, spelling
from beckon.llm.ngram_join import shingles
from beckon.llm.running import sums_from_here
from tests.llm.test_documents import enumerate_rows, near_copies, odd_rows, table


@pytest.fixture
def split(spark):
    """Small tables stay in many parts, as large ones are."""
    names = ("spark.sql.adaptive.coalescePartitions.enabled", "spark.sql.shuffle.partitions")
    before = [spark.conf.get(n) for n in names]
    for n, value in zip(names, ("false", "7")):
        spark.conf.set(n, value)
    yield
    for n, value in zip(names, before):
        spark.conf.set(n, value)


# SetSketch

def sets_of(n, m, shared, seed):
    rng = np.random.default_rng(seed)
    all_ = rng.integers(-2 ** 63, 2 ** 63 - 1, n + m - shared)
    return np.unique(all_[:n]), np.unique(all_[n - shared:])


@pytest.mark.parametrize("n, m, shared", [(9, 10, 9), (200, 220, 190), (1000, 1000, 889), (5000, 4000, 1500)])
def test_sketch_merges_and_estimates(n, m, shared):
    similarity, found, equal = shared / (n + m - shared), [], []
    for seed in range(20):
        a, b = sets_of(n, m, shared, seed)
        ra, rb = sketch_join.sketch(a), sketch_join.sketch(b)
        assert (sketch_join.merge(sketch_join.sketch(a[: n // 3]), sketch_join.sketch(a[n // 3:])) == ra).all()
        best, open_ = sketch_join.estimate(ra[None], rb[None], np.array([n]), np.array([m]))
        found.append(best[0])
        equal.append((ra == rb).mean())
        assert open_[0] or similarity < 0.75
    assert abs(np.mean(found) - similarity if m / n > 0.81 else 0) < 0.04
    assert abs(np.mean(equal) - similarity) < 0.05


def test_strata_are_a_permutation_and_exponential():
    tokens = np.arange(1, 2000, dtype=np.uint64)
    values, places = sketch_join._strata(tokens, 0, sketch_join.REGISTERS)
    assert all(len(set(p)) == sketch_join.REGISTERS for p in places.tolist())
    assert (np.diff(values, axis=1) >= 0).all()
    own = np.empty_like(values)
    np.put_along_axis(own, places, values, axis=1)
    assert abs(own.mean() * sketch_join.RATE - 1) < 0.02  # every register's law is the exponential one
    assert np.ptp(own.mean(axis=0)) * sketch_join.RATE < 0.2


def brute_components(texts):
    def words(t):
        w = (t or "").encode().lower().split()
        return frozenset(zip(w, w[1:])) if len(w) > 1 else frozenset(map(lambda x: (x,), w))

    sets, parent = [words(t) for t in texts], list(range(len(texts)))

    def find(x):
        return x if parent[x] == x else find(parent[x])

    for a in range(len(sets)):
        for b in range(a):
            s = len(sets[a] & sets[b])
            if s and 100 * s >= 80 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i), find(i) == i) for i in range(len(texts))}


def chain(rng, steps=40, words=60):
    """Each text resembles the one before, the last not the first."""
    own, out = [f"c{rng.randrange(10 ** 6)}" for _ in range(words)], []
    for _ in range(steps):
        out.append(" ".join(own))
        own = own[2:] + [f"c{rng.randrange(10 ** 6)}" for _ in range(2)]
    return out


@pytest.mark.parametrize("rounds, members", [(3, 256), (1, 3)])
def test_near_duplicates_match_brute_force(spark, monkeypatch, rounds, members):
    monkeypatch.setattr(sketch_join, "ROUNDS", rounds)
    monkeypatch.setattr(sketch_join, "MEMBERS", members)
    rng = random.Random(rounds)
    texts = near_copies(rng, families=10, members=12) + chain(rng) + ["ab cd ef gh ij", "ab cd ef gh ij kl", "x y", "x y z"]
    texts += [" ".join(rng.choice("pqrstuv") for _ in range(rng.randrange(4, 9))) for _ in range(60)]
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept)
           for r in sketch_join.near_duplicates(table(spark, enumerate_rows(texts))).collect()}
    assert got == brute_components(texts)


def test_near_duplicates_of_odd_rows(spark):
    docs = table(spark, odd_rows())
    clash = {c: F.lit("mine") for c in sketch_join.RESULTS} | {"key": F.lit("k"), "c": F.lit("c"), "n": F.lit(1)}
    rows = sketch_join.near_duplicates(docs.withColumns(clash)).collect()
    assert Counter(r.doc_id for r in rows) == Counter(r[0] for r in odd_rows())
    by = defaultdict(set)
    for r in rows:
        by[r.doc_id].add((r.n_shingles, r.component_id, r.kept))
    assert by[1] == {(0, 1, True)} and by[3] == {(0, 3, True)} and by[5] == {(13, 5, True)} and by[6] == {(13, 5, False)}
    assert by[None] == {(13, 5, False)} and all(r.key == "k" and r.c == "c" for r in rows)
    assert sketch_join.near_duplicates(docs.limit(0)).count() == 0
    assert sketch_join.near_duplicates(docs.where("doc_id = 4")).first().n_shingles == len(
        set(shingles(odd_rows()[4][1], 2)))


# Prefix trie

def brute_trie(rows):
    convs = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            convs[c].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [(r, x) for _, _, r, x in sorted(v)] for c, v in convs.items()}
    members, full, kids = defaultdict(list), {}, defaultdict(list)
    for c in own:
        h = zlib.crc32(str(c).encode()) % 9
        full[c] = tuple(own.get(c - c % 5, [])[:h] + own[c][h:])
        for d in range(len(full[c]) + 1):
            members[full[c][:d]].append(c)
    for k in members:
        if k:
            kids[k[:-1]].append(k)
    saved, leaves, out = {}, {}, []
    for k in sorted(members, key=len, reverse=True):
        own_bytes = len(k[-1][1].encode()) if k else 0
        saved[k] = (len(members[k]) - 1) * own_bytes + sum(saved[x] for x in kids[k])
        leaves[k] = sum(leaves[x] for x in kids[k]) or 1
        ends = ",".join(str(c) for c in sorted(members[k]) if full[c] == k)
        out.append((min(members[k]), len(k), min(members[k[:-1]]) if k else None, len(members[k]), len(kids[k]),
                    leaves[k], saved[k], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def conversations(spark, rows):
    return spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(3)


def trie_rows(df, **more):
    return sorted(map(tuple, prefix_trie.prefix_trie(df, **more).collect()), key=str)


def turns(seed):
    """Few distinct turns, absent bases, null and tied turns, a long conversation, many copies of one."""
    rng, rows = random.Random(seed), []
    for c in range(120):
        if c % 7 != 3:
            rows += [(c, None if rng.random() < 0.1 else t, rng.choice(["user", "bot", None]), rng.choice(["x", "yé", None, "zz"]))
                     for t in range(rng.choice([1, 2, 3, 9, 12]))]
    rows += [(400, t, "user", f"long {t % 3}") for t in range(500)]
    rows += [(c, t, "user", f"same {t}") for c in range(500, 560) for t in range(10)]
    return rows + rows[:4] + [(None, 1, "user", "nobody's")]


@pytest.mark.parametrize("bits", [64, 2])
def test_trie_matches_brute_force(spark, split, bits):
    rows = turns(bits)
    assert trie_rows(conversations(spark, rows), bits=bits) == brute_trie(rows)


def test_trie_verifies_fingerprints(spark, monkeypatch):
    """With bases that make fingerprints meet, nodes are told apart only by a second attempt."""
    calls = []
    right, placed = prefix_trie.BASES, prefix_trie._placed

    def count(df, attempt, bits):
        calls.append(attempt)
        monkeypatch.setattr(prefix_trie, "BASES", (1, 1) if attempt == 0 else right)
        return placed(df, attempt, bits)

    monkeypatch.setattr(prefix_trie, "_placed", count)
    rows = [(0, 0, "u", "a"), (0, 1, "u", "b"), (4, 0, "u", "b"), (4, 1, "u", "a"), (11, 0, "u", "b"), (11, 1, "u", "a")]
    rows = [(c * 5, *r) for c, *r in rows]
    assert trie_rows(conversations(spark, rows)) == brute_trie(rows)
    assert calls == [0, 1]


def test_trie_of_odd_tables(spark, monkeypatch):
    rows = [(5, 1, "u", "é" * 50_000), (6, 1, "u", "x"), (6, 1, "u", "x"), (7, None, None, None)]
    df = conversations(spark, rows)
    more = df.withColumns({c: F.lit("mine") for c in ("part", "place", "a", "b", "depth", "n_convs")})
    monkeypatch.setattr(prefix_trie, "ENDS", 1)
    assert trie_rows(more) == brute_trie(rows)
    assert trie_rows(df.limit(0)) == []


def test_sums_along_a_long_key(spark, split):
    rng = random.Random(1)
    rows = [(k, i, rng.randrange(9)) for k, n in ((1, 3000), (2, 1), (3, 40)) for i in range(n)]
    got = sums_from_here(spark.createDataFrame(rows, "k long, i long, x long"), "k", "i", ["x"], "test").collect()
    total = {}
    for k, i, x in sorted(rows, reverse=True):
        total[k, i] = total.get((k, i + 1), 0) + x
    assert {(r.k, r.i): r.x for r in got} == total


# Spelling variants

def brute_variants(words, times=10):
    letters = sorted({c for w in words for c in w})
    out = {}
    for w in words:
        near = ({w[:i] + w[i + 1:] for i in range(len(w))} | {w[:i] + c + w[i:] for i in range(len(w) + 1) for c in letters}
                | {w[:i] + c + w[i + 1:] for i in range(len(w)) for c in letters}) & set(words) - {w}
        best = min(near, key=lambda x: (-words[x], x), default=None)
        form = best if best is not None and words[best] >= times * words[w] else None
        out[w] = (form, words[w], len(near), words[form] if form else None)
    for w in words:
        root = w
        while out[root][0]:
            root = out[root][0]
        out[w] += (root,)
    return out


@pytest.mark.parametrize("block", [4096, 4])
def test_variants_match_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(spelling, "BLOCK", block)
    rng = random.Random(block)
    words = {"".join(rng.choice("abé") for _ in range(rng.randint(1, 9))): rng.choice([2, 3, 20, 25, 300, 4000])
             for _ in range(900)}
    rows = [(w, n) for w, n in words.items()]
    df = spark.createDataFrame(rows + [(None, 5), ("", 7)], "word string, n long").withColumn("many", F.lit("mine"))
    got = {r.word: (r.form, r.n, r.n_near, r.form_n, r.root) for r in spelling.variants(df.withColumn("size", F.lit(0))).collect()}
    assert got == brute_variants(words)


def test_index_tracks_errors_at_once():
    words = ["abc", "abd", "ab", "abcd", "xabc", "axbc", "cab", "abc"]
    near = spelling.PositionIndex(words).near("abc")
    chosen = [{words[k] for k in range(len(words)) if bits >> k & 1} for bits in near]
    assert chosen[:3] == [{"abd"}, {"abcd", "xabc", "axbc"}, {"ab"}]
    assert chosen[3] == {"abc", "abcd"} and {"abd", "ab"} <= chosen[4]


def test_words_are_counted_whole(spark, monkeypatch):
    monkeypatch.setattr(spelling, "COUNTED", 3)
    rows = [(1, "Größere größere GRÖßERE, straßenbahn"), (2, "straßenbahn Straßenbahn short"), (None, "straßenbahn ÷÷÷÷÷÷÷"),
            (3, None), (4, ""), (5, "verylongword " * 20_000)] + [(k, "damaged") for k in range(100, 200)]
    want = Counter()
    for i, text in rows:
        for run in spelling.re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if c.isascii() else c for c in run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            want[run if h % 31 else run[:h % len(run)] + run[h % len(run) + 1:]] += 1
    want = {w: n for w, n in want.items() if len(w) >= 7 and n >= 2}
    docs = table(spark, rows).withColumns({"word": F.lit("w"), "n": F.lit(1), "id": F.lit("i")})
    assert {r.word: r.n for r in spelling.count_words(docs, 7, 31, 2).collect()} == want
    assert spelling.variants(spelling.count_words(docs.limit(0))).count() == 0
