"""Prefix trie of rebuilt conversations, from fingerprints that are combined, not recomputed.

A rebuilt conversation is the head of a base conversation and its own turns after the
same place.  The turns' hashes ``x0, x1, ...`` have the fingerprint ``sum(x_i * r**i)``;
with the number of turns these form a monoid: fingerprints of neighbouring runs combine
to that of both.  Each stored turn keeps the fingerprint of its conversation up to it,
pieced together from the parts of the table that hold the conversation; the prefixes of a
rebuilt conversation follow from those of the base and its own by two products, and no
rebuilt text is ever written.

Prefixes of equal depth and fingerprint are one node.  Equality is verified: each stored
turn is compared with the turn that its hash refers to, and all prefixes of a node must end in
the same referred turn and extend the same node.  If any differs, all is done again with
other hashes.

A node belongs to its smallest conversation.  Down a conversation's path the owner grows
until it is the conversation itself and then stays, so each conversation owns one chain
of nodes, and chains hang on chains.  Sums over subtrees are sums over the chain from the
node on and over the chains that hang there.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from beckon.llm.common import stored
from beckon.llm.running import sums_from_here

#: Modulus of the fingerprints and the bases of its two lanes.
PRIME = 2 ** 61 - 1
BASES = (0x1B873593CC9E2D51 % PRIME, 0x0E6546B64A2F9C1D % PRIME)
#: Turns of a base's head and conversations that share a base, as the queries ask.
MOST_HEAD, SHARING = 8, 5
#: Ends of a node that are written as one piece of the list.
ENDS = 10_000

_TURNS = ("conv_id long, part int, place long, role string, text string, ka long, kb long, bytes long, "
          "a0 long, b0 long, a long, b long")


def _placed(conversations: DataFrame, attempt: int, bits: int) -> DataFrame:
    """Turns with their place in the part of the table that they are in, and fingerprints so far."""
    rows = conversations.where("conv_id IS NOT NULL").select(
        F.col("conv_id").cast("long").alias("conv_id"), "turn", F.coalesce("role", F.lit("")).alias("role"),
        F.coalesce("text", F.lit("")).alias("text"))
    keep = F.lit((1 << bits) - 1 if bits < 63 else -1)
    rows = rows.select(
        "*", F.xxhash64(F.lit(attempt), "role", "text").bitwiseAND(keep).alias("ka"),
        F.xxhash64(F.lit(-attempt - 1), "text", "role").bitwiseAND(keep).alias("kb"),
        F.octet_length("text").cast("long").alias("bytes"))
    order = [F.col("conv_id"), F.col("turn").asc_nulls_first(), F.col("role"), F.col("text"), F.col("row")]
    # The last key only spreads repeated rows.
    ranged = rows.withColumn("row", F.monotonically_increasing_id()).repartitionByRange(*order)
    ordered = ranged.sortWithinPartitions(*order).select("conv_id", "role", "text", "ka", "kb", "bytes")

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, conv, place, sums, powers = TaskContext.get().partitionId(), None, 0, [0, 0], [1, 1]
        for batch in batches:
            places, before, after = [], ([], []), ([], [])
            for c, *keys in zip(*[batch[x].to_pylist() for x in ("conv_id", "ka", "kb")]):
                if c != conv:
                    conv, place, sums, powers = c, 0, [0, 0], [1, 1]
                place += 1
                places.append(place)
                for lane in (0, 1):
                    before[lane].append(sums[lane])
                    sums[lane] = (sums[lane] + keys[lane] * powers[lane]) % PRIME
                    powers[lane] = powers[lane] * BASES[lane] % PRIME
                    after[lane].append(sums[lane])
            n = batch.num_rows
            yield pa.RecordBatch.from_arrays(
                [batch["conv_id"], pa.array([part] * n, pa.int32()), pa.array(places, pa.int64()),
                 *[batch[x] for x in ("role", "text", "ka", "kb", "bytes")],
                 *[pa.array(x, pa.int64()) for x in (*before, *after)]],
                [f.split()[0] for f in _TURNS.split(", ")])

    return ordered.mapInArrow(walk, _TURNS)


def _times(x: Column, y: Column) -> Column:
    """Product modulo the prime."""
    wide = x.cast("decimal(19,0)") * y.cast("decimal(19,0)")
    return (wide % F.lit(PRIME).cast("decimal(19,0)")).cast("long")


def _carried(turns: DataFrame) -> DataFrame:
    """Turns with their place and fingerprints in the whole conversation.

    Only conversations that lie in several parts are pieced together, from a row a part.
    """
    pieces = turns.groupBy("conv_id", "part").agg(
        F.max("place").alias("n"), F.max_by("a", "place").alias("a"), F.max_by("b", "place").alias("b"))
    spread = pieces.groupBy("conv_id").agg(F.min("part").alias("x"), F.max("part").alias("y")).where("x < y")
    pieces = pieces.join(spread.select("conv_id"), "conv_id", "left_semi")

    def piece(table: pa.Table) -> pa.Table:
        rows = sorted(zip(*[table[c].to_pylist() for c in ("part", "conv_id", "n", "a", "b")]))
        out, n, sums = [], 0, [0, 0]
        for part, conv, many, *own in rows:
            powers = [pow(r, n, PRIME) for r in BASES]
            out.append((conv, part, n, *sums, *powers))
            n, sums = n + many, [(s + p * x) % PRIME for s, p, x in zip(sums, powers, own)]
        names = ["of", "at", "before", "ca", "cb", "pa", "pb"]
        return pa.table([pa.array([r[i] for r in out], pa.int32() if c == "at" else pa.int64())
                         for i, c in enumerate(names)], names)

    carry = pieces.groupBy("conv_id").applyInArrow(
        piece, "of long, at int, before long, ca long, cb long, pa long, pb long")
    joined = turns.drop("role", "text").join(carry, (F.col("conv_id") == F.col("of")) & (F.col("part") == F.col("at")), "left")
    prime = F.lit(PRIME)

    def moved(x: str, lane: str) -> Column:
        return F.when(F.col("of").isNull(), F.col(x)).otherwise(
            (F.col(f"c{lane}") + _times(F.col(f"p{lane}"), F.col(x))) % prime).alias(x)

    return joined.select("conv_id", (F.col("place") + F.coalesce("before", F.lit(0))).alias("place"), "ka", "kb",
                         "bytes", moved("a0", "a"), moved("b0", "b"), moved("a", "a"), moved("b", "b"))


def _clash(turns: DataFrame) -> bool:
    """Whether two turns of equal hash differ; each is compared with the first of its hash."""
    refs = turns.groupBy("ka", "kb").agg(
        F.count("*").alias("many"), F.min(F.struct("conv_id", "part", "place")).alias("ref")).where("many > 1")
    refs = refs.select(F.col("ref.conv_id").alias("rc"), F.col("ref.part").alias("rp"), F.col("ref.place").alias("rn"),
                       F.col("ka").alias("ra"), F.col("kb").alias("rb"))
    first = turns.join(refs, (F.col("conv_id") == F.col("rc")) & (F.col("part") == F.col("rp"))
                       & (F.col("place") == F.col("rn"))).select(
        "ra", "rb", F.col("role").alias("other_role"), F.col("text").alias("other_text"))
    both = turns.join(first, (F.col("ka") == F.col("ra")) & (F.col("kb") == F.col("rb")))
    return not both.where("role <> other_role OR text <> other_text").isEmpty()


def head_turns(conv_id: Column) -> Column:
    """How many turns of the base a conversation begins with."""
    return F.pmod(F.crc32(conv_id.cast("string").cast("binary")), F.lit(MOST_HEAD + 1)).cast("int")


def _prefixes(turns: DataFrame) -> DataFrame:
    """A row per rebuilt conversation and depth, with fingerprints of prefix and parent."""
    head = F.when(F.col("place") <= MOST_HEAD, F.struct("place", "a", "b", "ka", "kb", "bytes"))
    convs = stored(turns.groupBy("conv_id").agg(
        F.max("place").alias("n"), F.sort_array(F.collect_list(head)).alias("head")), "trie-heads")
    base = convs.select(F.col("conv_id").alias("base"), F.col("n").alias("base_n"), F.col("head").alias("base_head"))
    own = convs.select("conv_id", "n", "head", head_turns(F.col("conv_id")).alias("h")).join(
        base, F.expr(f"conv_id - conv_id % {SHARING}") == F.col("base"), "left")
    own = own.withColumn("hb", F.least("h", F.coalesce("base_n", F.lit(0))).cast("int")).withColumn(
        "rest", F.greatest(F.col("n") - F.col("h"), F.lit(0)))

    def at(array: str, place: str, field: str) -> Column:
        return F.expr(f"coalesce(try_element_at({array}, nullif({place}, 0)).{field}, 0L)")

    shifts = [F.array(*[F.lit(pow(r, -k, PRIME)) for k in range(MOST_HEAD + 1)]) for r in BASES]
    own = own.select(
        "conv_id", "h", "hb", (F.col("hb") + F.col("rest")).alias("len"), "base_head",
        *[at("base_head", "hb", x).alias(f"base_{x}") for x in "ab"], *[at("head", "h", x).alias(f"own_{x}") for x in "ab"],
        *[F.element_at(s, F.expr("h - hb + 1")).alias(f"shift_{x}") for s, x in zip(shifts, "ab")])
    own = stored(own, "trie-rebuilt")
    inner = own.select("conv_id", "base_head", "len", F.explode(F.expr("sequence(0, hb)")).alias("depth")).select(
        "conv_id", F.col("depth").cast("long").alias("depth"), (F.col("depth") == F.col("len")).alias("ends"),
        *[at("base_head", "depth", x).alias(x) for x in "ab"],
        *[at("base_head", "greatest(depth - 1, 0)", x).alias(f"{x}0") for x in "ab"],
        *[at("base_head", "depth", x).alias(x) for x in ("ka", "kb", "bytes")])
    later = turns.join(own.drop("base_head"), "conv_id").where("place > h")
    prime = F.lit(PRIME)

    def rebuilt(column: str, lane: str) -> Column:
        beyond = F.pmod(F.col(column) - F.col(f"own_{lane}"), prime)
        return ((F.col(f"base_{lane}") + _times(F.col(f"shift_{lane}"), beyond)) % prime).alias(column)

    depth = F.col("hb") + F.col("place") - F.col("h")
    outer = later.select("conv_id", depth.alias("depth"), (depth == F.col("len")).alias("ends"),
                         rebuilt("a", "a"), rebuilt("b", "b"), rebuilt("a0", "a"), rebuilt("b0", "b"), "ka", "kb", "bytes")
    return inner.unionByName(outer)


def _nodes(conversations: DataFrame, bits: int) -> tuple[DataFrame, DataFrame]:
    """Verified nodes, and the prefixes that are whole conversations."""
    attempt = 0
    while True:
        turns = stored(_placed(conversations, attempt, bits), "trie-turns")
        if not _clash(turns):
            prefixes = stored(_prefixes(stored(_carried(turns), "trie-places")), "trie-prefixes")
            same = ("a0", "b0", "ka", "kb")
            nodes = stored(prefixes.groupBy("depth", "a", "b").agg(
                F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"), F.max("bytes").alias("bytes"),
                *[F.min(c).alias(c) for c in same], *[F.max(c).alias(f"other_{c}") for c in same]), "trie-nodes")
            if nodes.where(" OR ".join(f"{c} <> other_{c}" for c in same)).isEmpty():
                return nodes.drop(*[f"other_{c}" for c in same]), prefixes.where("ends")
        attempt, bits = attempt + 1, 64


def _digests(nodes: DataFrame, ends: DataFrame) -> DataFrame:
    """``owner, at, ends_sha256`` for nodes at which conversations end.

    A node's conversations are sorted over as many parts as they take and written as
    pieces of the list; one task then reads a node's pieces one after another, since the
    digest of a list can only be taken in its order.
    """
    named = nodes.select(F.col("conv_id").alias("owner"), F.col("depth").alias("at"), F.col("a").alias("na"), F.col("b").alias("nb"))
    members = ends.join(named, (F.col("depth") == F.col("at")) & (F.col("a") == F.col("na")) & (F.col("b") == F.col("nb"))
                        ).select("owner", "at", "conv_id")
    order = ("owner", "at", "conv_id")

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, ids = None, []
        for batch in batches:
            out = []
            for owner, at, conv in zip(*[batch[c].to_pylist() for c in order]):
                if ids and (node != (owner, at) or len(ids) == ENDS):
                    out.append((*node, ids[0], ",".join(map(str, ids))))
                    ids = []
                node = owner, at
                ids.append(conv)
            yield _rows(out)
        if ids:
            yield _rows([(*node, ids[0], ",".join(map(str, ids)))])

    def _rows(out: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], pa.string() if i == 3 else pa.int64())
                                           for i in range(4)], ["owner", "at", "first", "ids"])

    lists = members.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(
        pieces, "owner long, at long, first long, ids string")

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, state = None, None
        for batch in batches:
            out = []
            for owner, at, ids in zip(*[batch[c].to_pylist() for c in ("owner", "at", "ids")]):
                if node == (owner, at):
                    state.update(b"," + ids.encode())
                    continue
                if node:
                    out.append((*node, state.hexdigest()))
                node, state = (owner, at), hashlib.sha256(ids.encode())
            yield _hashes(out)
        if node:
            yield _hashes([(*node, state.hexdigest())])

    def _hashes(out: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], pa.string() if i == 2 else pa.int64())
                                           for i in range(3)], ["owner", "at", "ends_sha256"])

    return lists.repartition("owner", "at").sortWithinPartitions("owner", "at", "first").mapInArrow(
        digest, "owner long, at long, ends_sha256 string")


def prefix_trie(conversations: DataFrame, bits: int = 64) -> DataFrame:
    """A row per node of the trie of rebuilt conversations of ``conv_id, turn, role, text``.

    Conversation c is the first ``head_turns(c)`` turns of conversation ``c - c % SHARING``
    (fewer, if it has fewer) and its own turns after as many.  Turns are in order of
    ``turn`` (null first), of equal ones by role and text; a repeated row is one more
    turn.  Null roles and texts are empty, rows without ``conv_id`` go, other columns are
    ignored, and an empty table gives no rows.

    ``conv_id`` (smallest member), ``depth``, ``parent_conv_id`` (that of the parent; root:
    null), ``n_convs``, ``n_children``, ``n_leaves`` and ``saved_tokens`` (over the
    subtree, the node's ``n_convs - 1`` times the bytes of its last text),
    ``ends_sha256`` (of the decimal ids of conversations that end here, ascending, joined
    by commas).  ``bits`` is how much of a turn's hash the first attempt uses.  Runs jobs
    at once; intermediate tables go to the shared folder.
    """
    nodes, ends = _nodes(conversations, bits)
    chains = nodes.groupBy("conv_id").agg(F.min("depth").alias("top"), F.max("depth").alias("end"),
                                          F.sum(F.expr("(n_convs - 1) * bytes")).alias("saved"))
    owners = nodes.select(F.col("depth").alias("pd"), F.col("a").alias("pa"), F.col("b").alias("pb"),
                          F.col("conv_id").alias("parent"))
    # Chains hang on the parent of their first node.
    tops = chains.join(nodes.select("conv_id", "depth", "a0", "b0"), "conv_id").where("depth = top").drop("depth")
    hung = tops.join(owners, (F.col("top") - 1 == F.col("pd")) & (F.col("a0") == F.col("pa"))
                     & (F.col("b0") == F.col("pb")), "left")
    chains = stored(hung.select("conv_id", "top", "end", "saved", "parent"), "trie-chains")
    children = chains.where("parent IS NOT NULL").groupBy(
        F.col("parent").alias("on"), (F.col("top") - 1).alias("at")).agg(F.count("*").alias("hung"))
    children = stored(children, "trie-children")
    ended = chains.join(children, (F.col("conv_id") == F.col("on")) & (F.col("end") == F.col("at")), "left")
    # Sums over all chains below, by steps that double.
    below = stored(ended.select("conv_id", F.col("parent").alias("up"), "saved",
                                F.when(F.col("on").isNull(), 1).otherwise(0).cast("long").alias("leaves")), "trie-below")
    while not below.where("up IS NOT NULL").isEmpty():
        sums = below.where("up IS NOT NULL").groupBy(F.col("up").alias("to")).agg(
            F.sum("saved").alias("more_saved"), F.sum("leaves").alias("more_leaves"))
        higher = below.select(F.col("conv_id").alias("via"), F.col("up").alias("higher"))
        below = stored(
            below.join(sums, F.col("conv_id") == F.col("to"), "left").join(higher, F.col("up") == F.col("via"), "left")
            .select("conv_id", F.col("higher").alias("up"), *[
                (F.col(c) + F.coalesce(f"more_{c}", F.lit(0))).alias(c) for c in ("saved", "leaves")]), "trie-below")
    hanging = (chains.where("parent IS NOT NULL").select("conv_id", "parent", (F.col("top") - 1).alias("at"))
               .join(below.select("conv_id", "saved", "leaves"), "conv_id").groupBy(F.col("parent").alias("on"), "at")
               .agg(F.count("*").alias("hung"), F.sum("saved").alias("hung_saved"), F.sum("leaves").alias("hung_leaves")))
    spans = chains.select(F.col("conv_id").alias("of"), "top", "end", "parent")
    rows = (nodes.join(spans, F.col("conv_id") == F.col("of"))
            .join(hanging, (F.col("conv_id") == F.col("on")) & (F.col("depth") == F.col("at")), "left"))
    hung, inside = F.coalesce("hung", F.lit(0)), F.col("depth") < F.col("end")
    rows = rows.select(
        "conv_id", "depth", F.when(F.col("depth") == F.col("top"), F.col("parent")).otherwise(F.col("conv_id")).alias(
            "parent_conv_id"), "n_convs", (hung + inside.cast("long")).alias("n_children"),
        (F.coalesce("hung_leaves", F.lit(0)) + F.when(inside | (hung > 0), 0).otherwise(1)).cast("long").alias("n_leaves"),
        (F.coalesce("hung_saved", F.lit(0)) + (F.col("n_convs") - 1) * F.col("bytes")).alias("saved_tokens"))
    summed = sums_from_here(rows, "conv_id", "depth", ["n_leaves", "saved_tokens"], "trie-values")
    digests = _digests(nodes, ends)
    none = hashlib.sha256(b"").hexdigest()
    return summed.join(digests, (F.col("conv_id") == F.col("owner")) & (F.col("depth") == F.col("at")), "left").select(
        *summed.columns, F.coalesce("ends_sha256", F.lit(none)).alias("ends_sha256"))
