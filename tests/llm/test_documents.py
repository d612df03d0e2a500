"""Operators on documents against brute force, and on odd rows."""

import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from beckon.llm import (common, language, line_dedup, mixing, ngram_join, packing, quality, sharding,
                        substring, toxicity)
from beckon.llm.queries import vocabulary_path

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
WORD = re.compile("[^\x20\x09-\x0D]+")


def table(spark, rows, parts=3):
    rows = [(*r, *[None] * (5 - len(r))) for r in rows]
    return spark.createDataFrame(rows, SCHEMA).repartition(parts)


def odd_rows():
    """Null id, null and empty texts, white space, a very long text, repeated rows, ties."""
    rng = random.Random(5)
    long = "\n".join(" ".join(rng.choice(["alpha", "beta", "gamma", "delta", "eps", "zeta"])
                              + str(rng.randrange(900)) for _ in range(9)) for _ in range(9000))
    plain = "The quick brown fox jumps over the lazy dog near the river bank today"
    return [(None, plain, "en", None), (1, None, "en", "a"), (2, "", None, "a"), (3, " \t\n ", "en", "b"),
            (4, long, "en", "b"), (5, plain, "en", "a"), (5, plain, "en", "a"), (6, plain, "fr", None),
            (7, "é ß 12 #!", "de", "c"), (7, "other text of the same id", "de", "c")]


OPERATORS = {
    "shard": (lambda d: sharding.shard(d, 4), sharding.RESULTS),
    "toxicity": (lambda d: toxicity.score_texts(d, toxicity.Model({"fox": 5.0})), toxicity.RESULTS),
    "lines": (line_dedup.dedup_lines, line_dedup.RESULTS),
    "ngrams": (ngram_join.join_components, ngram_join.RESULTS),
    "bytes": (substring.remove_repeats, substring.RESULTS),
    "language": (lambda d: language.identify(d, language.Profiles({"en": [101, 102]})), language.RESULTS),
    "mix": (mixing.mix, mixing.RESULTS),
    "quality": (quality.quality_rules, quality.RESULTS),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_odd_rows_and_clashing_names(spark, name):
    operator, results = OPERATORS[name]
    docs = table(spark, odd_rows())
    got = operator(docs.withColumns({c: F.lit("mine") for c in results} | {"c": F.lit("c"), "row": F.lit(1)}))
    rows = got.collect()
    assert len(rows) == len(odd_rows())
    assert Counter(r.doc_id for r in rows) == Counter(r[0] for r in odd_rows())
    assert all(r[c] != "mine" for r in rows for c in results)
    assert len({c.lower() for c in got.columns}) == len(got.columns)
    twice = [r for r in rows if r.doc_id == 5]
    same = [c for c in got.columns if c not in ("shard", "slot")]
    assert [str(twice[0][c]) for c in same] == [str(twice[1][c]) for c in same]
    assert operator(docs.limit(0)).count() == 0


def brute_sets(texts):
    sets = []
    for t in texts:
        w = WORD.findall((t or "").translate({i: i + 32 for i in range(65, 91)}))
        sets.append(frozenset(tuple(w[k:k + 5]) for k in range(len(w) - 4)) if len(w) >= 5
                    else frozenset([tuple(w)] if w else []))
    return sets


def near_copies(rng, families=12, members=9, words=60):
    vocabulary = [f"w{i}" for i in range(400)]
    texts = []
    for _ in range(families):
        base = [rng.choice(vocabulary) for _ in range(rng.randrange(4, words))]
        for _ in range(members):
            own = list(base)
            for _ in range(rng.randrange(0, 3)):
                own[rng.randrange(len(own))] = rng.choice(vocabulary)
            texts.append(" ".join(own))
    return texts + ["short", "Short", "a b c", "a b c"]


@pytest.mark.parametrize("members", [256, 4])
def test_ngram_join_matches_brute_force(spark, monkeypatch, members):
    monkeypatch.setattr(ngram_join, "MEMBERS", members)
    monkeypatch.setattr(ngram_join, "SEEDS", 2)
    texts = near_copies(random.Random(members))
    sets = brute_sets(texts)
    parent = list(range(len(texts)))

    def find(x):
        return x if parent[x] == x else find(parent[x])

    for a in range(len(sets)):
        for b in range(a):
            s = len(sets[a] & sets[b])
            if s and 100 * s >= 80 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    got = {r.doc_id: r for r in ngram_join.join_components(table(spark, enumerate_rows(texts))).collect()}
    assert [(got[i].n_shingles, got[i].component_id) for i in got] == [
        (len(sets[i]), find(i)) for i in got]
    kept = sorted(r.doc_id for r in ngram_join.representatives(table(spark, enumerate_rows(texts))).collect())
    assert kept == sorted({find(i) for i in range(len(texts))})


@pytest.mark.parametrize("hot", [8, 32])
def test_sets_under_a_hot_shingle_are_not_paired_as_rows(spark, monkeypatch, hot):
    """Texts that share a passage of three quarters are no copies; those of one text with a word changed are."""
    passage = [f"p{i}" for i in range(84)]
    texts = [" ".join([*passage, *(f"own{i}x{j}" for j in range(18))]) for i in range(48)]
    # similar to one of them through the passage as well, found or not before sets ask
    texts += [" ".join(["new", *t.split()[1:]]) for t in texts[:6]]
    monkeypatch.setattr(ngram_join, "HOT", hot, raising=False)
    sets, links = brute_sets(texts), set()
    for a in range(len(sets)):
        for b in range(a):
            if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                links.add((b, a))
    assert links == {(i, 48 + i) for i in range(6)}
    rows, stored = {}, ngram_join.stored

    def counted(df, purpose):
        rows[purpose] = stored(df, purpose)
        return rows[purpose]

    monkeypatch.setattr(ngram_join, "stored", counted)
    # Sets that meet before are linked there; here all have to ask.
    monkeypatch.setattr(ngram_join, "_met", lambda sets: sets.sparkSession.createDataFrame([], "a long, b long"))
    got = {r.doc_id: r.component_id for r in ngram_join.join_components(table(spark, enumerate_rows(texts))).collect()}
    assert got == {i: i - 48 if i >= 48 else i for i in range(len(texts))}
    assert rows["ngram-pairs"].count() <= hot * len(texts) // 8  # of 1,431 pairs of texts


def enumerate_rows(texts):
    return list(enumerate(texts))


@pytest.mark.parametrize("members", [512, 5])
def test_line_dedup_matches_brute_force(spark, monkeypatch, members):
    monkeypatch.setattr(line_dedup, "MEMBERS", members)
    monkeypatch.setattr(line_dedup, "SEEDS", 2)
    rng = random.Random(members)
    lines = near_copies(rng, 25, 6, 14)
    rng.shuffle(lines)
    texts = ["\n".join(lines[i:i + 4]) + "\n \n" for i in range(0, len(lines), 4)]
    seen, expected = [], {}
    for i, text in enumerate(texts):
        gone = []
        for at, line in enumerate(text.split("\n")):
            s = set(WORD.findall(line.lower()))
            if s:
                if any(100 * len(s & o) >= 80 * len(s | o) for o in seen):
                    gone.append(at)
                seen.append(s)
        expected[i] = (sum(bool(x.strip()) for x in text.split("\n")), gone, "\n".join(
            x for at, x in enumerate(text.split("\n")) if at not in gone))
    got = line_dedup.dedup_lines(table(spark, enumerate_rows(texts))).collect()
    assert {r.doc_id: (r.n_lines, r.removed_lines, r.text) for r in got} == expected
    left = line_dedup.left_with_words(line_dedup.dedup_lines(table(spark, enumerate_rows(texts))))
    assert left.count() == sum(n > len(g) for n, g, _ in expected.values())


@pytest.mark.parametrize("hot", [(2048, 20_000), (8, 3)])
def test_lines_of_hot_words_meet_in_chunks(spark, monkeypatch, hot):
    """Lines that share all words but a number, some in families too small to be similar across."""
    monkeypatch.setattr(line_dedup, "CHUNK", hot[0])
    monkeypatch.setattr(line_dedup, "FEW", 64 if hot[0] == 2048 else 2)
    monkeypatch.setattr(line_dedup, "BLOCK", 2)
    monkeypatch.setattr(line_dedup, "HOT", hot[1])
    monkeypatch.setattr(line_dedup, "ENTRIES", 40 if hot[0] == 8 else 500_000)
    monkeypatch.setattr(line_dedup, "MEMBERS", 16)
    monkeypatch.setattr(line_dedup, "SEEDS", 2)
    rng = random.Random(7)
    words = [f"w{i}" for i in range(12)]
    lines = [" ".join([*words[:9], f"n{i}"]) for i in range(60)]
    lines += [" ".join(rng.sample(words, rng.randrange(4, 11))) for _ in range(150)]
    lines += [" ".join([*words[2:9], *(f"{c}{i}" for c in "abc")]) for i in range(40)]
    rng.shuffle(lines)
    texts = ["\n".join(lines[i:i + 5]) for i in range(0, len(lines), 5)]
    seen, expected = [], {}
    for i, text in enumerate(texts):
        expected[i] = []
        for at, line in enumerate(text.split("\n")):
            s = set(line.split())
            if any(100 * len(s & o) >= 80 * len(s | o) for o in seen):
                expected[i].append(at)
            seen.append(s)
    got = line_dedup.dedup_lines(table(spark, enumerate_rows(texts), 7)).collect()
    assert {r.doc_id: r.removed_lines for r in got} == expected


def test_steps_of_a_hot_word_are_bounded(monkeypatch):
    monkeypatch.setattr(line_dedup, "CHUNK", 64)
    entries = np.zeros(1000, line_dedup.ENTRY)
    entries["token"], entries["n"], entries["key"] = 5, 10, np.arange(1000) // 2 + 1
    entries["bits"] = np.uint64(1) << (entries["key"] % 60).astype(np.uint64)
    chunks, asking, settled = line_dedup.hot_chunks(entries)
    assert max(map(len, chunks)) == 64 and sum(map(len, chunks)) == 500
    assert set(settled.tolist()) == set(range(1, 501)) and not sum(map(len, asking))


def test_line_sets_of_more_lines_than_fit_beside_a_code():
    order = line_dedup.Words([])
    n = (1 << 20) + 3
    text, line, sizes, keys, words = line_dedup.line_sets(["a b\n" * n, "c d e\nb a"], order)
    one = line_dedup.line_sets(["a b\nc d e"], order)
    assert text.tolist() == [0] * n + [1, 1] and line.tolist() == [*range(n), 0, 1]
    assert sizes.tolist() == [2] * n + [3, 2] and len(words) == 2 * n + 5
    assert set(keys[:n].tolist()) == {int(one[3][0])} and keys[n:].tolist() == one[3][::-1].tolist()
    assert words[:2].tolist() == one[4][:2].tolist() and words[-5:].tolist() == [*one[4][2:], *one[4][:2]]


@pytest.mark.parametrize("phrases", [5000, 2])
def test_repeated_bytes_match_brute_force(spark, monkeypatch, phrases):
    import hashlib
    rng = random.Random(3)
    length = 48
    passages = ["".join(rng.choice("abcdé ") for _ in range(90)) for _ in range(4)]
    texts = ["x" * 300, "ab" * 150, "", "short"]
    for _ in range(60):
        own = "".join(rng.choice("abcdefgh ") for _ in range(rng.randrange(150)))
        at = rng.randrange(len(own) + 1)
        p = rng.choice(passages)
        a = rng.randrange(40)
        texts.append(own[:at] + p[a:a + rng.randrange(20, 90)] + own[at:])
    texts += [texts[8], texts[8]]
    monkeypatch.setattr(substring, "CHUNK", 1024)  # more than one group of texts
    monkeypatch.setattr(substring, "PHRASES", phrases)
    data = [t.encode() for t in texts]
    count = Counter(d[k:k + length] for d in data for k in range(len(d) - length + 1))
    got = {r.doc_id: r for r in substring.remove_repeats(table(spark, enumerate_rows(texts)), length).collect()}
    for i, d in enumerate(data):
        gone = bytearray(len(d))
        for k in range(len(d) - length + 1):
            if count[d[k:k + length]] > 1:
                gone[k:k + length] = b"\1" * length
        kept = bytes(x for x, g in zip(d, gone) if not g)
        runs = [len(m[0]) for m in re.finditer(b"\1+", bytes(gone))]
        r = got[i]
        assert (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) == (
            len(d), sum(gone), len(runs), hashlib.sha256(kept).hexdigest()), i
        assert [s.bytes for s in r.spans] == runs


def test_best_fit_plan_is_best_fit_decreasing():
    rng = random.Random(1)
    for _ in range(60):
        size = rng.randrange(8, 60)
        items = [rng.randrange(1, size + 1) for _ in range(rng.randrange(1, 120))]
        bins = []
        for x in sorted(items, reverse=True):
            fit = [b for b in bins if b >= x]
            if fit:
                bins[bins.index(min(fit))] -= x
            else:
                bins.append(size - x)
        filled = defaultdict(list)
        for length, rank, pieces, per, first, start in packing.best_fit_plan(Counter(items), size):
            for k in range(pieces):
                filled[first + k // per].append((start + k % per * length, length))
        assert Counter(n for b in filled.values() for _, n in b) == Counter(items)
        for b in filled.values():
            at = 0
            for start, n in sorted(b):
                assert start == at
                at += n
            assert at <= size
        assert sorted(size - sum(n for _, n in b) for b in filled.values()) == sorted(bins)


def test_packing_round_trip(spark):
    from tokenizers import Tokenizer
    path = vocabulary_path()
    odd = ["Don't STOP <|endoftext|>now.", "a.b,c. d..", "x\x1cy z", "́ é. ,", "ß. Ab, 12.", "<|End"]
    rows = odd_rows() + list(enumerate(odd, 100))
    docs = table(spark, rows)
    got = packing.pack(docs, path, 256, with_ids=True).collect()
    tokenizer = Tokenizer.from_file(path)
    ids = Counter()
    for row in rows:
        e = tokenizer.encode(row[1] or "", add_special_tokens=False).ids + [1]
        for k in range(0, len(e), 256):
            ids[row[0], k // 256, k, b"".join(i.to_bytes(4, "little") for i in e[k:k + 256])] += 1
    assert Counter((r.doc_id, r.piece, r.start, bytes(r.ids)) for r in got) == ids
    assert all(zlib.crc32(r.ids) == r.ids_crc32 and len(r.ids) == 4 * r.length for r in got)
    places = defaultdict(list)
    for r in got:
        places[r.sequence_id].append((r.offset, r.length))
    for p in places.values():
        p.sort()
        assert [a for a, _ in p] == [sum(n for _, n in p[:k]) for k in range(len(p))]
        assert sum(n for _, n in p) <= 256
    assert packing.pack(docs.limit(0), path).count() == 0


def test_packing_ranks_in_parts(spark, monkeypatch):
    monkeypatch.setattr(packing, "RANK_ROWS", 7)
    got = packing.pack(table(spark, [(i, "one two") for i in range(50)]), vocabulary_path(), 10).collect()
    assert len({(r.sequence_id, r.offset) for r in got}) == 50
    assert Counter(r.length for r in got) == {3: 50}
    assert len({r.sequence_id for r in got}) == 17


def test_mix_targets(spark):
    rng = random.Random(2)
    sizes = {"b": 5000, "a": 300, "é": 4000, "c": 20000, None: 700, "d": 0}
    rows = []
    for s, n in sizes.items():
        while n > 0:
            k = min(n, rng.randrange(1, 40))
            rows.append((len(rows), " ".join(["w"] * k), None, s))
            n -= k
    rows.append((len(rows), None, None, "d"))
    weights = dict(zip(["a", "b", "c", "d", "é", None], [3, 1, 2, 3, 1, 2]))
    left, target, open_ = 1.5 * sum(sizes.values()), {}, set(sizes)
    while True:
        level = left / sum(weights[s] for s in open_)
        full = {s for s in open_ if 2 * sizes[s] < level * weights[s]}
        if not full:
            break
        target |= {s: 2.0 * sizes[s] for s in full}
        open_ -= full
        left -= sum(2 * sizes[s] for s in full)
    target |= {s: level * weights[s] for s in open_}
    docs = table(spark, rows)
    got = mixing.mix(docs).collect()
    taken = Counter()
    for r in got:
        assert abs(r.target - target[r.source]) < 1e-6 and r.source_size == sizes[r.source]
        assert r.taken in (r.size * r.copies, 0) and r.taken <= 2 * r.size
        taken[r.source] += r.taken
    for s, t in target.items():
        assert abs(taken[s] - t) <= 0.15 * t + 40
    again = {r.doc_id: r.taken for r in mixing.mix(docs.repartition(5)).collect()}
    assert again == {r.doc_id: r.taken for r in got}
    assert mixing.emit(mixing.mix(docs)).count() == sum(r.copies for r in got)


def test_quality_counts(spark):
    rng = random.Random(4)
    texts = [" ".join(rng.choice("abc#") * rng.randrange(1, 3) for _ in range(rng.randrange(40))) for _ in range(80)]
    texts += ["one\ntwo\none\n \n\n", "é" * 5, "a b c d e f a b c d e", None, "  lead and trail  "]
    got = {r.doc_id: r for r in quality.quality_rules(table(spark, enumerate_rows(texts))).collect()}
    for i, t in enumerate(texts):
        w = WORD.findall(t or "")
        seen = Counter(tuple(w[k:k + 5]) for k in range(len(w) - 4))
        over = {k + j for k in range(len(w) - 4) if seen[tuple(w[k:k + 5])] > 1 for j in range(5)}
        lines = [x for x in (t or "").split("\n") if WORD.search(x)]
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (
            len(w), sum(map(len, w)), len(re.findall("[#*$%&|<>]", t or "")), len(lines) - len(set(lines)),
            len(over)), t
        assert r.base_failed == (len(w) < 10 or 100 * len(over) > 20 * len(w))


def test_common_lines_are_removed_per_host(spark):
    own = lambda i: " ".join(f"word{i}x{k}" for k in range(30))
    rows = [(i, f"Shared  FOOTER line here\n{own(i)}", None, "h") for i in range(60)]
    rows += [(100 + i, f"shared footer line here\n{own(100 + i)}", None, "other") for i in range(5)]
    rows.append((200, "shared footer line here\n" * 3 + "and nine more words that make it long enough", None, "h"))
    rows += [(300 + i, own("copy"), None, "h") for i in range(80)]  # copies are one document
    rows += [(400, "shared footer line here " + "\n" + "shared footer line here\nx y z", None, "h")]
    got = {r.doc_id: r for r in quality.quality_rules(table(spark, rows)).collect()}
    assert all(got[i].n_common_words == 4 and got[i].clean_text == own(i) and got[i].kept for i in range(60))
    assert all(got[100 + i].n_common_words == 0 for i in range(5))
    assert all(got[300 + i].kept and got[300 + i].n_common_words == 0 for i in range(80))
    assert got[400].n_common_words == 8 and not got[400].kept


def test_common_lines_match_brute_force(spark):
    """A hot host, a null one, depleted documents, lines repeated within and across documents."""
    rng = random.Random(12)
    pool = [f"Line  {k} of many words that hosts share" for k in range(12)]
    rows = []
    for i in range(400):
        own = [" ".join(f"w{rng.randrange(5000)}" for _ in range(6)) for _ in range(rng.randrange(0, 5))]
        lines = [rng.choice([str.upper, str.lower, str])(rng.choice(pool)) for _ in range(rng.randrange(0, 5))] + own
        rng.shuffle(lines)
        rows.append((i, "\n".join(lines), None, "hot" if i % 2 else rng.choice(["a", "b", None, "c"])))
    rows += [(1000 + i, *r[1:]) for i, r in enumerate(rows[:50])] + [(2000, None, None, "hot")]
    key = lambda x: " ".join(x.lower().split())
    held = defaultdict(set)
    for _, text, _, host in rows:
        for x in (text or "").split("\n"):
            held[host, key(x)].add(text)
    got = {r.doc_id: r for r in quality.quality_rules(table(spark, rows)).collect()}
    rejected = 0
    for i, text, _, host in rows:
        lines = (text or "").split("\n")
        gone = [x for x in lines if key(x) and len(held[host, key(x)]) >= 10]
        n, common = len((text or "").split()), sum(len(x.split()) for x in gone)
        assert got[i].n_common_words == common and got[i].kept == (not got[i].base_failed and n - common >= n * 0.5)
        assert got[i].clean_text == (None if text is None else "\n".join(x for x in lines if x not in gone))
        rejected += not got[i].base_failed and not got[i].kept
    assert rejected > 20 and sum(r.kept for r in got.values()) > 100


def test_language_profiles(spark):
    rng = random.Random(6)
    stems = {"en": ["the", "ing", "tion", "and", "er"], "de": ["der", "ung", "sch", "und", "ß"],
             "fr": ["les", "que", "eau", "est", "é"]}
    rows = [(i, " ".join("".join(rng.choice(stems[x]) for _ in range(2)) for _ in range(40)), x)
            for i, x in enumerate(rng.choice(list(stems)) for _ in range(150))]
    profiles = language.fit(table(spark, rows[:100]))
    got = {r.doc_id: r for r in language.identify(
        table(spark, rows[100:] + [(900, "12 #", "en"), (901, None, "en")]), profiles).collect()}
    assert all(got[i].lang_pred == x and 0 < got[i].score <= 1 for i, _, x in rows[100:])
    assert got[900].lang_pred == got[901].lang_pred == "und" and got[901].score == 0
    assert language.fit(table(spark, rows[:1]).limit(0)).langs == []


def test_rare_languages_are_learned(spark):
    rows = [(i, f"the common words of line {i}", "en") for i in range(400)] + [(900, "årets første øl", "da")] + [
        (901 + i, f"zażółć gęślą jaźń {'ż' * i}", "pl") for i in range(5)]
    profiles = language.fit(table(spark, rows).select("text", "lang"), rows=3)
    assert profiles.langs == ["da", "en", "pl"]
    assert profiles.predict("gęślą jaźń")[0] == "pl"
    few = [r.n for r in common.bounded_sample_each(table(spark, rows), 3, F.struct("text", "lang"), "lang").groupBy(
        "lang").agg(F.count("*").alias("n")).orderBy("lang").collect()]
    assert few == [1, 3, 3]


def test_ngram_counts_in_chunks(monkeypatch):
    text = "Ein Über-maß, an 3 Äpfeln! " * 40
    codes, counts = language.ngram_counts(text)
    monkeypatch.setattr(language, "CHUNK", 17)
    assert [x.tolist() for x in language.ngram_counts(text)] == [codes.tolist(), counts.tolist()]
    squeezed = " " + " ".join(re.findall("[^\\W\\d_]+", text.lower())) + " "
    expected = Counter(squeezed[i:i + n] for n in (1, 2, 3) for i in range(len(squeezed) - n + 1))
    del expected[" "]
    assert sorted(counts.tolist()) == sorted(expected.values())


def test_segments_are_all_maximal_ones():
    def brute(scores):
        """Best segment by sum, shortest and first; then the same on both sides."""
        if not scores or max(s for s, _ in scores) <= 0:
            return []
        best = max(((sum(s for s, _ in scores[a:b]), a - b, -a, a, b)
                    for a in range(len(scores)) for b in range(a + 1, len(scores) + 1)))
        total, _, _, a, b = best
        return brute(scores[:a]) + [(scores[a][1], scores[b - 1][1], total)] + brute(scores[b:])

    rng = random.Random(7)
    for _ in range(80):
        scores = [rng.choice([-2.0, -0.25, -0.25, -0.25, 1.1, 0.7, 2.3]) for _ in range(rng.randrange(1, 25))]
        hits = [(i, s) for i, s in enumerate(scores) if s != -0.25]
        got = [(a, b, round(s, 6)) for a, b, s in toxicity.segments(hits, 0.25)]
        assert got == [(a, b, round(s, 6)) for a, b, s in brute([(s, i) for i, s in enumerate(scores)])], scores


def test_toxicity_on_held_out_rows(spark):
    rng = random.Random(8)
    plain = [f"w{i}" for i in range(500)]

    def text(toxic):
        words = [rng.choice(plain) for _ in range(rng.randrange(20, 200))]
        for _ in range(4 if toxic else 0):
            words.insert(rng.randrange(len(words)), rng.choice(["scum", "idiot", "moronic", "moronish", "morona"]))
        return " ".join(words)

    rows = [(text(i % 6 == 0), int(i % 6 == 0)) for i in range(900)]
    labelled = spark.createDataFrame(rows[:600] + [("w1", None), (None, 0)], "text string, toxic int")
    model = toxicity.fit(labelled)
    docs = spark.createDataFrame([(i, *r) for i, r in enumerate(rows[600:])], "doc_id long, text string, toxic int")
    got = toxicity.score_texts(docs, model).collect()
    assert sum(r.predicted == r.toxic for r in got) >= 0.98 * len(got)
    assert all((r.score >= 0.5) == (r.predicted == 1) and 0 <= r.score <= 1 for r in got)
    assert any(r.passages for r in got)
    assert toxicity.fit(labelled.where("toxic = 0")).scores == {}


def test_phrases_of_a_batch_are_hashed_in_bounded_memory():
    import tracemalloc

    rng = np.random.default_rng(4)
    texts = [rng.integers(97, 123, 2000, dtype=np.uint8).tobytes() for _ in range(2000)]
    texts.append(rng.integers(97, 123, 1_500_000, dtype=np.uint8).tobytes())
    peaks = []
    for run in (lambda: substring.phrases(texts),
                lambda: substring._window_hashes([t[:300] for t in texts] * 10, 200)):
        substring._POWERS.clear()
        tracemalloc.start()
        found = run()
        peaks.append(tracemalloc.get_traced_memory()[1])
        tracemalloc.stop()
    assert peaks[0] < 80 << 20  # 200 MB with chunks of 1 MiB
    assert len(found) == 101 * 10 * len(texts) and peaks[1] < 100 << 20


def test_window_hashes_do_not_depend_on_chunks(monkeypatch):
    rng = np.random.default_rng(5)
    parts = [rng.integers(97, 99, n, dtype=np.uint8).tobytes() for n in (8, 30, 8, 9, 41, 8, 8)]
    hash_of = lambda x: int(substring.Hashed(np.frombuffer(x, np.uint8)).part(np.array([0]), 8).view(np.int64)[0])
    expected = [hash_of(p[i:i + 8]) for p in parts for i in range(len(p) - 7)]
    for chunk in (1, 20, 64, 1 << 18):
        monkeypatch.setattr(substring, "CHUNK", chunk)
        assert substring._window_hashes(parts, 8).tolist() == expected


@pytest.mark.parametrize("limit, moves", [("-1", 2), ("10m", 0)])
def test_texts_with_wanted_lines_move_once_at_most(spark, limit, moves):
    docs = spark.createDataFrame([(1, 5, "a"), (1, 5, "a"), (None, 5, "b"), (0, 5, "c"), (2, 6, "d")],
                                 "doc_id long, c long, text string")
    wanted = spark.createDataFrame([(0, 1, 5, [7]), (1, 0, 5, [8]), (0, 0, 5, [9, 10]), (0, 3, 5, [11])],
                                   "none int, doc long, c long, wanted array<long>").hint(
                                       "merge" if limit == "-1" else "broadcast")
    held = line_dedup._held(docs, wanted)
    plan = held._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == moves  # a side each, none after the join
    assert sorted(map(tuple, held.collect()), key=lambda r: r[3]) == [
        (1, 5, [7], "a"), (1, 5, [7], "a"), (None, 5, [8], "b"), (0, 5, [9, 10], "c")]


def test_lines_of_repeated_rows_go_once(spark):
    lines = ["one two three four five six", "one two three four five seven", "a b c d e f g h i j", "a b c d e f g h i k"]
    rows = [(1, lines[0]), (2, lines[1]), (None, lines[2]), (3, lines[3])]
    once, often = (line_dedup.dedup_lines(table(spark, rows * n, parts)).select(
        "doc_id", "text", "n_lines", "removed_lines").collect() for n, parts in ((1, 2), (5, 7)))
    assert len(often) == 20
    assert {(r.doc_id, r.text, tuple(r.removed_lines)) for r in often} == {
        (r.doc_id, r.text, tuple(r.removed_lines)) for r in once}


def test_entries_travel_in_byte_planes_that_compress():
    import lzma

    rng = np.random.default_rng(6)
    entries = np.zeros(4000, line_dedup.ENTRY)
    entries["token"], entries["bits"] = rng.integers(0, 1 << 32, 4000), rng.integers(0, 1 << 63, 4000)
    entries["key"] = np.sort(rng.integers(-(1 << 63), 1 << 63, 4000))
    entries["n"], entries["pos"] = rng.integers(4, 1 << 20, 4000), rng.integers(0, 9, 4000)
    entries["pos"][::7] |= line_dedup.SETTLED
    packed = line_dedup._to_bytes(entries)
    assert (line_dedup._from_bytes(packed) == entries).all() and len(line_dedup._from_bytes(b"")) == 0
    assert line_dedup._to_bytes(entries[:0]) == b""
    upper = packed[15 * 4000:16 * 4000]  # the last plane of the keys, which ascend
    assert len(lzma.compress(upper)) < 1000
