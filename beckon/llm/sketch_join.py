"""Near duplicates by SetSketch registers: banded, judged by likelihood, then verified.

A shingle draws one exponential value for each register, stratum by stratum: the j-th
value lies in the j-th of the intervals that the exponential law splits into equal
shares, and goes to the j-th register of the shingle's own order of registers.  A register
keeps the smallest value of all shingles on an exponential scale, ``floor(1 - log_b(v))``,
limited to 16 bits.  Registers of parts of a set merge by maximum, and two sets agree in a register
about as often as they are similar.

Sets with equal registers in a band meet.  How many registers of two sets are larger,
smaller and equal has a likelihood for each similarity, given their sizes; pairs for which
the asked similarity is far less likely than the best are dropped, and the others are
confirmed on their full sets.  Links serve components, so what already hangs together
is not compared again: first each band's members are held against a leader; then, where a band still
holds several components, the members of smaller ones are held against all others.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from beckon.llm.common import parts_for, stored, without
from beckon.llm.components import connected_components
from beckon.llm.ngram_join import set_key, shingles, similar

#: Words of a shingle, similarity in hundredths, as the query asks.
WORDS, PERCENT = 2, 80
#: Registers of a sketch (a power of two), scale, rate of the exponential law, registers of a band.
REGISTERS, BASE, RATE, BAND = 128, 1.001, 20.0, 4
#: The asked similarity is ruled out if it is ``exp(-DOUBT)`` times as likely as the best one.
DOUBT = 12.0
#: Sets of fewer shingles have no partner but their equals: 3 of 4 is less than 80 %.
LEAST = 4
#: Rounds of leaders, each with other ones, members met in one call, entries of bands met in one call.
ROUNDS, MEMBERS, ENTRIES = 1, 256, 100_000
#: Shingles sketched at once.
PIECE = 1 << 18
RESULTS = ("n_shingles", "component_id", "kept")

_MIX = (np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), np.uint64(0x9E3779B97F4A7C15))


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _MIX[0]
    x = (x ^ (x >> np.uint64(27))) * _MIX[1]
    return x ^ (x >> np.uint64(31))


def _strata(tokens: np.ndarray, first: int, end: int) -> tuple[np.ndarray, np.ndarray]:
    """Values of strata ``first`` to ``end`` of each shingle, and the registers they go to."""
    j = np.arange(first, end, dtype=np.uint64)
    drawn = _mixed(tokens[:, None] + (j + np.uint64(1)) * _MIX[2])
    share = (drawn >> np.uint64(11)).astype(np.float64) * 2.0 ** -53
    values = -np.log1p(-(np.arange(first, end) + share) / REGISTERS) / RATE
    # An own order of the registers: steps that can be undone, modulo a power of two.
    last, half = np.uint64(REGISTERS - 1), np.uint64(REGISTERS.bit_length() // 2)
    own = _mixed(tokens + _MIX[0])[:, None]
    order = (j * (own | np.uint64(1)) + (own >> np.uint64(16))) & last
    order ^= order >> half
    order = (order * ((own >> np.uint64(32)) | np.uint64(1)) + (own >> np.uint64(48))) & last
    return values, (order ^ (order >> half)).astype(np.int64)


def sketch(tokens: np.ndarray) -> np.ndarray:
    """Registers of a set of 64-bit shingle hashes; of large sets piece by piece."""
    if len(tokens) > PIECE:
        return np.maximum.reduce([sketch(tokens[k:k + PIECE]) for k in range(0, len(tokens), PIECE)])
    least = np.full(REGISTERS, np.inf)
    tokens = tokens.view(np.uint64)
    wide = math.ceil(REGISTERS * (math.log(REGISTERS) + 3) / max(1, len(tokens)))
    first = 0
    while len(tokens) and first < REGISTERS:
        end = min(REGISTERS, first + wide)
        values, places = _strata(tokens, first, end)
        np.minimum.at(least, places.ravel(), values.ravel())
        if end < REGISTERS and least.max() <= -math.log1p(-end / REGISTERS) / RATE:
            break  # later strata only hold larger values
        first = end
    with np.errstate(divide="ignore"):
        return np.clip(np.floor(1 - np.log(least) / math.log(BASE)), 0, 65535).astype(np.uint16)


def merge(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Registers of the union of two sets."""
    return np.maximum(a, b)


def bands(registers: np.ndarray) -> np.ndarray:
    """One number a band: the band's registers side by side."""
    return np.ascontiguousarray(registers).view(np.int64)


def _log_likelihood(similarity, larger, smaller, equal, u, v):
    """Of counts of larger, smaller and equal registers, sizes being shares u and v of their sum."""
    def chance(x):
        x = np.clip(x, 1e-300, 1.0)
        return np.maximum(-np.log1p(-x * (BASE - 1) / BASE) / math.log(BASE), 1e-300)

    p, q = chance(u - v * similarity), chance(v - u * similarity)
    return larger * np.log(p) + smaller * np.log(q) + equal * np.log(np.maximum(1 - p - q, 1e-300))


def estimate(a: np.ndarray, b: np.ndarray, n: np.ndarray, m: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Most likely similarity of pairs of sketches, and whether ``PERCENT`` can't be ruled out.

    ``a`` and ``b`` hold a sketch a row, ``n`` and ``m`` the sets' sizes.
    """
    larger, smaller = (a > b).sum(axis=1), (a < b).sum(axis=1)
    u, v = n / (n + m), m / (n + m)
    most = np.minimum(n, m) / np.maximum(n, m)
    asked = PERCENT / 100
    near = np.flatnonzero(100 * np.minimum(n, m) >= PERCENT * np.maximum(n, m))
    best, open_ = np.zeros(len(n)), np.zeros(len(n), bool)
    if len(near):
        counts = [x[near, None] for x in (larger, smaller, a.shape[1] - larger - smaller, u, v)]
        grid = np.linspace(0, 1, 101)[None, :] * most[near, None]
        on_grid = _log_likelihood(grid, *counts)
        top = on_grid.argmax(axis=1)
        best[near] = grid[np.arange(len(near)), top]
        at = _log_likelihood(np.full((len(near), 1), asked), *counts)[:, 0]
        open_[near] = (best[near] >= asked) | (at >= on_grid.max(axis=1) - DOUBT)
    return best, open_


def _stack(blobs: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(blobs), np.uint16).reshape(-1, REGISTERS)


def _sketched(docs: DataFrame) -> DataFrame:
    """``doc_id, c, n, key, registers``: a set's size, key and, from ``LEAST`` shingles on, sketch."""
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingles(t.as_py(), WORDS) for t in batch["text"]]
            drawn = [sketch(s).tobytes() if len(s) >= LEAST else None for s in sets]
            yield pa.RecordBatch.from_arrays(
                [batch["doc_id"], batch["c"], pa.array(list(map(len, sets)), pa.int64()),
                 pa.array(list(map(set_key, sets)), pa.int64()), pa.array(drawn, pa.binary())],
                ["doc_id", "c", "n", "key", "registers"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "c", "text").mapInArrow(
        work, f"doc_id {kind}, c long, n long, key long, registers binary")


def band_codes(registers: np.ndarray) -> np.ndarray:
    """Codes of all bands; the number of the band is mixed in, so that bands do not meet each other."""
    values = bands(registers).view(np.uint64)
    return _mixed(_mixed(values) + np.arange(values.shape[1], dtype=np.uint64) * _MIX[2]).view(np.int64)


def _banded(sets: DataFrame) -> DataFrame:
    """``band, key``: the bands of each set."""
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            coded = band_codes(_stack(batch["registers"].to_pylist()))
            yield pa.RecordBatch.from_arrays(
                [pa.array(coded.ravel()), pa.array(np.repeat(batch["key"].to_numpy(), coded.shape[1]))], ["band", "key"])

    return sets.select("key", "registers").mapInArrow(work, "band long, key long")


def _open_pairs(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Pairs ``a, b`` that are not ruled out, with their ``likely`` similarity."""
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                best, open_ = estimate(*[_stack(batch[c].to_pylist()) for c in ("ra", "rb")],
                                       *[batch[c].to_numpy() for c in ("na", "nb")])
                yield pa.RecordBatch.from_arrays([batch["a"], batch["b"], pa.array(best)], ["a", "b", "likely"]).filter(
                    pa.array(open_))

    left, right = [sets.select(F.col("key").alias(x), F.col("n").alias(f"n{x}"), F.col("registers").alias(f"r{x}"))
                   for x in "ab"]
    return pairs.join(left, "a").join(right, "b").select("a", "b", "na", "nb", "ra", "rb").mapInArrow(
        work, "a long, b long, likely double")


def _confirmed(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs ``a, b`` that are similar; a call holds one ``a`` against some of its ``b``."""
    size = stored(pairs.groupBy("a").agg(F.ceil(F.count("*") / MEMBERS).cast("int").alias("chunks")), "sketch-turns")
    asked = (pairs.join(size, "a").withColumn("chunk", F.pmod(F.xxhash64("b"), F.col("chunks")).cast("int"))
             .join(texts.withColumnRenamed("key", "b"), "b").select("a", "chunk", "b", "text"))
    leaders = (size.withColumn("chunk", F.explode(F.expr("sequence(0, chunks - 1)")))
               .join(texts.withColumnRenamed("key", "a"), "a").select(*[F.col(c).alias(c) for c in ("a", "chunk", "text")]))

    def compare(members: pa.Table, leader: pa.Table) -> pa.Table:
        own = shingles(leader["text"][0].as_py(), WORDS)
        near = [similar(own, shingles(t.as_py(), WORDS), PERCENT) for t in members["text"]]
        return members.select(["a", "b"]).filter(pa.array(near, pa.bool_()))

    keys = ("a", "chunk")
    return asked.groupBy(*keys).cogroup(leaders.groupBy(*keys)).applyInArrow(compare, "a long, b long")


def _labelled(entries: DataFrame, links: DataFrame | None) -> DataFrame:
    """Entries of the bands that hold several components, with their component ``comp``."""
    if links is None:
        return entries.withColumn("comp", F.col("key"))
    of = connected_components(links)
    rows = entries.join(of, F.col("key") == F.col("node"), "left").select(
        "band", "key", F.coalesce("component", "key").alias("comp"))
    several = rows.groupBy("band").agg(F.min("comp").alias("x"), F.max("comp").alias("y")).where("x < y").select("band")
    return rows.join(several, "band", "left_semi")


def _with_leaders(rows: DataFrame, turn: int) -> DataFrame:
    """Pairs ``a, b`` of each band's leader of this turn with the members of other components."""
    first = F.min(F.struct(F.xxhash64(F.lit(turn), "key").alias("order"), "key", "comp"))
    leaders = rows.groupBy(F.col("band").alias("of")).agg(first.alias("first")).select(
        "of", F.col("first.key").alias("a"), F.col("first.comp").alias("other"))
    return rows.join(leaders, (F.col("band") == F.col("of")) & (F.col("comp") != F.col("other"))).select(
        "a", F.col("key").alias("b")).distinct()


def _still_open(rows: DataFrame, sets: DataFrame) -> DataFrame:
    """``key, grp``: sets with components that one of their bands also holds and that are not ruled out.

    Members outside a band's largest component are held against all members of larger
    components; both sides are cut into bounded chunks.  Two sets that share several bands
    are looked at in the first of them only.
    """
    sizes = rows.select("key", "comp").distinct().groupBy(F.col("comp").alias("c")).agg(F.count("*").alias("size"))
    sized = rows.join(sizes, F.col("comp") == F.col("c")).drop("c")
    tops = sized.groupBy(F.col("band").alias("of")).agg(
        F.max(F.struct("size", "comp")).alias("top"), F.ceil(F.count("*") / MEMBERS).cast("int").alias("chunks"))
    met = stored(sized.join(tops, F.col("band") == F.col("of")).select(
        "band", "key", "comp", "size", "chunks", (F.col("comp") != F.col("top.comp")).alias("asks")), "sketch-met")
    met = met.join(sets.select(F.col("key").alias("k"), "n", "registers"), F.col("key") == F.col("k")).drop("k")
    chunk = F.pmod(F.xxhash64("key"), F.col("chunks")).cast("int")
    every = F.explode(F.expr("sequence(0, chunks - 1)"))
    asked = met.where("asks").withColumn("turn", chunk).withColumn("chunk", every).withColumn("asked", F.lit(True))
    others = met.withColumn("chunk", chunk).withColumn("turn", every).withColumn("asked", F.lit(False))
    total = met.count()
    both = asked.unionByName(others).withColumn("bucket", F.pmod(
        F.xxhash64("band", "turn", "chunk"), F.lit(parts_for(total, ENTRIES // 32))).cast("int"))

    def meet(table: pa.Table) -> pa.Table:
        out: list[tuple[np.ndarray, np.ndarray]] = []
        code = np.stack([table[c].to_numpy().astype(np.int64) for c in ("band", "turn", "chunk")])
        turn = np.lexsort(code)
        cuts = np.flatnonzero((np.diff(code[:, turn], axis=1) != 0).any(axis=0)) + 1
        key, comp, size, n = (table[c].to_numpy() for c in ("key", "comp", "size", "n"))
        asks = np.array(table["asked"].to_pylist(), bool)
        registers = _stack(table["registers"].to_pylist())
        codes = band_codes(registers)
        for own in np.split(turn, cuts):
            left, right = own[asks[own]], own[~asks[own]]
            for x in left:
                y = right[(size[right] > size[x]) | ((size[right] == size[x]) & (comp[right] > comp[x]))]
                first = codes[x][(codes[y] == codes[x]).argmax(axis=1)]
                y = y[first == code[0][x]]
                if len(y):
                    y = y[estimate(np.broadcast_to(registers[x], (len(y), REGISTERS)), registers[y],
                                   np.full(len(y), n[x]), n[y])[1]]
                    grps = np.unique(comp[y])
                    out.append((np.full(len(grps), key[x]), grps))
        parts = [np.concatenate([o[i] for o in out]) if out else np.empty(0, np.int64) for i in (0, 1)]
        return pa.table([pa.array(p) for p in parts], ["key", "grp"])

    columns = ("bucket", "band", "turn", "chunk", "asked", "key", "comp", "size", "n", "registers")
    return both.select(*columns).groupBy("bucket").applyInArrow(meet, "key long, grp long").distinct()


def _opened(pairs: DataFrame, members: DataFrame, texts: DataFrame) -> DataFrame:
    """Links ``a, b`` of asking sets with a similar member of the component, for pairs ``key, grp``."""
    asking = pairs.groupBy("grp").agg(F.ceil(F.count("*") / (4 * MEMBERS)).cast("int").alias("turns"))
    size = members.groupBy(F.col("grp").alias("g")).agg(F.ceil(F.count("*") / MEMBERS).cast("int").alias("chunks"))
    shape = stored(asking.join(size, F.col("grp") == F.col("g")).drop("g"), "sketch-shape")
    every = {c: F.explode(F.expr(f"sequence(0, {c}s - 1)")) for c in ("turn", "chunk")}
    own = {c: F.pmod(F.xxhash64("key"), F.col(f"{c}s")).cast("int") for c in ("turn", "chunk")}
    keys = ("grp", "turn", "chunk")
    left = pairs.join(shape, "grp").join(texts, "key").withColumn("turn", own["turn"]).withColumn("chunk", every["chunk"])
    right = members.join(shape, "grp").join(texts, "key").withColumn("chunk", own["chunk"]).withColumn("turn", every["turn"])

    def compare(asked: pa.Table, group: pa.Table) -> pa.Table:
        others = [(k, shingles(t, WORDS)) for k, t in zip(group["key"].to_pylist(), group["text"].to_pylist())]
        found = []
        for key, text in zip(asked["key"].to_pylist(), asked["text"].to_pylist()):
            tokens = shingles(text, WORDS)
            other = next((k for k, t in others if similar(tokens, t, PERCENT)), None)
            if other is not None:
                found.append((key, other))
        return pa.table([pa.array([f[i] for f in found], pa.int64()) for i in (0, 1)], ["a", "b"])

    columns = ("key", "text", *keys)
    return left.select(*columns).groupBy(*keys).cogroup(
        right.select(*[F.col(c).alias(c) for c in columns]).groupBy(*keys)).applyInArrow(compare, "a long, b long")


def _links(docs: DataFrame, surveyed: DataFrame) -> DataFrame:
    """Links ``a, b`` between set keys, enough to connect what similar pairs connect."""
    sets = stored(surveyed.where(F.col("registers").isNotNull()).groupBy("key").agg(
        F.max("n").alias("n"), F.min("c").alias("of"), F.first("registers").alias("registers")), "sketch-sets")
    entries = _banded(sets)
    several = entries.groupBy("band").agg(F.count("*").alias("many")).where("many > 1").select("band")
    entries = stored(entries.join(several, "band"), "sketch-bands")
    alive = entries.select("key").distinct()
    sets = stored(sets.join(alive, "key", "left_semi"), "sketch-alive")
    # The sets that met grow with the corpus: always a merge join.
    texts = stored(docs.select("c", "text").join(sets.select("key", "of").hint("merge"), F.col("c") == F.col("of"))
                   .dropDuplicates(["key"]).select("key", "text"), "sketch-texts")
    links = None
    for turn in range(ROUNDS):
        rows = stored(_labelled(entries, links), "sketch-labelled")
        if rows.isEmpty():
            break
        pairs = _open_pairs(_with_leaders(rows, turn), sets)
        # Of a set's leaders the most similar one: it is likely to bring the set to its component.
        best = pairs.groupBy("b").agg(F.max_by("a", "likely").alias("a")).select("a", "b")
        found = stored(_confirmed(stored(best, "sketch-pairs"), texts), "sketch-links")
        if turn and found.isEmpty():
            break
        links = found if links is None else stored(links.union(found), "sketch-links")
    else:
        rows = stored(_labelled(entries, links), "sketch-labelled")
    if links is None:  # no two sets met
        return texts.select(F.col("key").alias("a"), F.col("key").alias("b"))
    pairs = stored(_still_open(rows, sets), "sketch-asked")
    members = rows.select("key", F.col("comp").alias("grp")).distinct()
    members = stored(members.join(pairs.select("grp").distinct(), "grp", "left_semi"), "sketch-members")
    return stored(links.union(_opened(pairs, members, texts)), "sketch-links")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """All documents with ``n_shingles``, ``component_id`` and ``kept``.

    Two documents link if their sets of ``WORDS``-word shingles are ``PERCENT`` similar
    (a shorter text is one shingle); a component is what links reach, and its id the
    smallest ``doc_id`` in it (nulls last), which is the document that is kept.  Texts
    without words link with nothing and are kept.  Repeated rows are documents like others;
    input columns named like a result are replaced; an empty table gives no rows.

    Every link is confirmed on full sets of 64-bit shingle hashes.  A pair of just the
    asked similarity is missed by the bands with a chance of 5e-8, by the likelihood of
    about 1e-6.  Runs jobs at once; intermediate tables go to the shared folder.
    """
    coded = docs.select("doc_id", F.xxhash64("text").alias("c"), "text")
    surveyed = stored(_sketched(coded), "sketch-survey")
    of = connected_components(_links(coded, surveyed))
    rows = surveyed.select("doc_id", "c", "n", "key")
    keyed = stored(rows.join(of, F.col("key") == F.col("node"), "left").select(
        "doc_id", "c", "n", F.coalesce("component", "key").alias("component")), "sketch-keyed")
    least = keyed.where("n > 0").groupBy(F.col("component").alias("of")).agg(F.min("doc_id").alias("least"))
    found = keyed.join(least, (F.col("component") == F.col("of")) & (F.col("n") > 0), "left").select(
        F.col("c").alias("__of"), F.col("n").alias("n_shingles"), F.col("least").alias("component_id")).distinct()
    joined = (without(docs, RESULTS).withColumn("__c", F.xxhash64("text")).join(found, F.col("__c") == F.col("__of"))
              .drop("__c", "__of"))
    component = F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id"))
    return joined.withColumn("component_id", component).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))
