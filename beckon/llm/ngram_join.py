"""N-gram Jaccard self-join by a token-group matrix, and its components.

Texts with equal shingle sets are one set.  Sets that share too few of their rarest
shingles with any other cannot have a partner and are left out.  The others are
partitioned into groups of similar sets; the matrix holds each group's union of
shingles; a set opens only groups whose union overlaps its rarer shingles, so many as
a similar set cannot do without, and is compared with their members.  Under shingles that
very many groups hold, sets are compared directly, a chunk with a chunk.

Shingles stand in one order: those that few texts hold first, by their hash, then the
most frequent by count.  If two sets of n and m shingles are as similar as asked, they
share ``ceil(share * max(n, m))`` at least, so of the first ``prefix_size(n)`` and
``prefix_size(m)`` they share ``least_shared(n)`` at least.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from beckon.llm import sharing
from beckon.llm.common import parts_for, stored, without
from beckon.llm.components import connected_components

#: Words of a shingle, similarity in hundredths.
WORDS, PERCENT = 5, 80
#: Most frequent shingles that are put last in the order; a bounded list.
FREQUENT = 50_000
#: Share of a set beyond the plain prefix that is looked at too.
MORE = 0.05
#: The same for the few sets that may have a partner, whose groups are opened.
MORE_OPEN = 0.2
#: A shingle of more groups is hot: sets that ask under it are compared chunk by chunk, ``HELD`` with as many,
#: by products of matrices of ``COLUMNS`` shingles.
HOT, HELD, COLUMNS = 32, 512, 4096
#: Texts hashed at once; entries of a bucket of shingles; members of a group compared in one call.
TEXTS, ENTRIES, MEMBERS, SEEDS, ASKING = 500, 500_000, 256, 32, 2000
RESULTS = ("n_shingles", "component_id")

_FACTORS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9,
                     0xD6E8FEB86659FD93, 0xA0761D6478BD642F], np.uint64)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * _FACTORS[0]
    return x ^ (x >> np.uint64(29))


def shingles(text: str | None, words: int = WORDS) -> np.ndarray:
    """Sorted distinct 64-bit hashes of a text's shingles.

    A-Z is lower-cased and words end at ASCII white space.  A shorter text is one
    shingle; a text without words has none.
    """
    parts = text.encode().lower().split() if text else []
    if not parts:
        return np.empty(0, np.int64)
    hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, parts), np.uint64, len(parts))
    n = min(words, len(parts))
    total = np.full(len(parts) - n + 1, n, np.uint64)
    for k in range(n):
        total = _mixed(total + hashes[k:len(parts) - n + 1 + k] * _FACTORS[k % 5])
    return np.unique(total.view(np.int64))


def set_key(tokens: np.ndarray) -> int:
    """64-bit key of a set of shingles."""
    return int(np.frombuffer(xxhash.xxh3_64_digest(tokens.tobytes()), ">i8")[0]) if len(tokens) else 0


def prefix_size(n: int, more: float = MORE, percent: int = PERCENT) -> int:
    return min(n, n - -(-percent * n // 100) + 1 + int(more * n))


def least_shared(n: Column, more: float) -> Column:
    """A partner has ``PERCENT`` of n shingles at least, so its prefix is this much longer at least."""
    return 1 + F.floor(F.lit(more) * F.floor(F.lit(PERCENT) * n / 100))


class Order:
    """The global order of shingles: rare ones by hash, then the frequent by count."""

    def __init__(self, frequent: list[int]):
        tokens = np.array(frequent, np.int64)  # most frequent last
        self.ranks = np.argsort(tokens)  # place in the list, for each of the sorted tokens
        self.tokens = tokens[self.ranks]

    def prefix(self, tokens: np.ndarray, more: float = MORE) -> np.ndarray:
        size = prefix_size(len(tokens), more)
        if not len(self.tokens) or not len(tokens):
            return tokens[:size]
        at = np.searchsorted(self.tokens, tokens)
        at[at == len(self.tokens)] = 0
        often = self.tokens[at] == tokens
        rare = tokens[~often]
        if len(rare) >= size:
            return rare[:size]
        last = tokens[often][np.argsort(self.ranks[at[often]], kind="stable")]
        return np.concatenate((rare, last))[:size]


def similar(a: np.ndarray, b: np.ndarray, percent: int = PERCENT) -> bool:
    n, m = len(a), len(b)
    if not n or not m or 100 * min(n, m) < percent * max(n, m):
        return False
    both = np.concatenate((a, b))
    both.sort()
    shared = int((both[1:] == both[:-1]).sum())
    return 100 * shared >= percent * (n + m - shared)


def _survey(docs: DataFrame) -> DataFrame:
    """Rows of ``doc_id, c, n, key`` (kind 0), and frequent shingles ``token, many`` (kind 1)."""

    def survey(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 4 * TEXTS):
                part = batch.slice(at, 4 * TEXTS)
                sets = [shingles(t) for t in part["text"].to_pylist()]
                keys = [set_key(s) for s in sets]
                own = list({k: s for k, s in zip(keys, sets)}.values())
                tokens, many = np.unique(np.concatenate(own), return_counts=True)
                often = many >= 4
                tokens, many = tokens[often], many[often]
                n, extra = part.num_rows, len(tokens)
                none, rest = pa.nulls(extra, pa.int64()), pa.nulls(n, pa.int64())
                yield pa.RecordBatch.from_arrays([
                    pa.array([0] * n + [1] * extra, pa.int32()),
                    pa.concat_arrays([part["doc_id"], pa.nulls(extra, part["doc_id"].type)]),
                    pa.concat_arrays([part["c"], none]),
                    pa.concat_arrays([pa.array(list(map(len, sets)), pa.int64()), none]),
                    pa.concat_arrays([pa.array(keys, pa.int64()), none]),
                    pa.concat_arrays([rest, pa.array(tokens)]), pa.concat_arrays([rest, pa.array(many)])],
                    ["kind", "doc_id", "c", "n", "key", "token", "many"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "c", "text").mapInArrow(
        survey, f"kind int, doc_id {kind}, c long, n long, key long, token long, many long")


def _partnered(docs: DataFrame, order: Order, buckets: int) -> DataFrame:
    """``key, shared``: how much of a set's prefix other sets have in theirs."""

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, TEXTS):
                sets = {}
                for text in batch["text"].slice(at, TEXTS).to_pylist():
                    tokens = shingles(text)
                    if len(tokens):
                        sets[set_key(tokens)] = tokens
                if not sets:
                    continue
                keys = np.array(list(sets), np.int64)
                prefixes = [order.prefix(t) for t in sets.values()]
                own = np.repeat(np.arange(len(keys)), [len(p) for p in prefixes])
                yield sharing.pack(keys, np.concatenate(prefixes), own, buckets)

    return (docs.select("text").mapInArrow(deal, sharing.PACKED).groupBy("bucket")
            .applyInArrow(lambda t: sharing.meet(t, buckets), sharing.PACKED).groupBy("bucket")
            .applyInArrow(sharing.total, "key long, shared long"))


def _met(sets: DataFrame) -> DataFrame:
    """Links ``a, b`` between sets that meet: those with the same least shingle under a hash.

    A set joins every family of those that meet in which it is similar to a member.
    Where very many meet they are cut into chunks, and each chunk begins with the same
    seeds, so that one large family holds together.
    """
    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            tokens = [shingles(x.as_py()) for x in batch["text"]]
            heads = [[int(t[0]), int(_mixed(t.view(np.uint64)).min().view(np.int64))] for t in tokens]
            yield pa.RecordBatch.from_arrays([batch["key"], batch["text"], pa.array(heads, pa.list_(pa.int64()))],
                                             ["key", "text", "heads"])

    headed = sets.select("key", "text").mapInArrow(first, "key long, text string, heads array<long>").select(
        "key", "text", F.posexplode("heads").alias("turn", "head"))
    headed = headed.select("key", "text", F.xxhash64("turn", "head").alias("head"))
    headed = stored(headed, "ngram-heads")
    many = headed.groupBy(F.col("head").alias("of")).count().where(F.col("count") > 1).select(
        "of", F.ceil(F.col("count") / MEMBERS).cast("int").alias("chunks"))
    together = headed.join(many, F.col("head") == F.col("of")).drop("of")
    plain = together.withColumn("chunk", F.pmod("key", "chunks").cast("int")).withColumn("seed", F.lit(0))
    seeds = (together.where("chunks > 1").withColumn("__n", F.expr(
        "row_number() OVER (PARTITION BY head ORDER BY key)")).where(F.col("__n") <= SEEDS).drop("__n")
        .withColumn("chunk", F.explode(F.expr("sequence(0, chunks - 1)"))).withColumn("seed", F.lit(1)))

    def gather(table: pa.Table) -> pa.Table:
        rows = sorted(zip(table["seed"].to_pylist(), table["key"].to_pylist(), table["text"].to_pylist()),
                      key=lambda r: (-r[0], r[1]))
        families: list[list[tuple[int, np.ndarray]]] = []
        links, done = [], set()
        for _, key, text in rows:
            if key in done:  # a seed comes twice in its own chunk
                continue
            done.add(key)
            tokens = shingles(text)
            # Leaders first, then the other members: one link to a family is enough.
            mine = [f for f in families if any(similar(tokens, other) for _, other in f)]
            joined = [(key, tokens)]
            for f in mine:
                links.append((key, f[0][0]))
                joined = f + joined if len(f) > len(joined) else joined + f
            families = [f for f in families if not any(f is x for x in mine)] + [joined]
        return pa.table([pa.array([x[i] for x in links], pa.int64()) for i in range(2)], ["a", "b"])

    return plain.unionByName(seeds).select("head", "chunk", "seed", "key", "text").groupBy(
        "head", "chunk").applyInArrow(gather, "a long, b long").distinct()


def _open(pairs: DataFrame, members: DataFrame, sets: DataFrame) -> DataFrame:
    """``key, grp, other``: a member that the set is similar to, or null, for pairs ``key, grp``.

    A call compares up to ``ASKING`` sets with a chunk of the group's members.
    """
    asking = pairs.groupBy("grp").agg(F.ceil(F.count("*") / ASKING).cast("int").alias("turns"))
    size = members.groupBy("grp").agg(F.ceil(F.count("*") / MEMBERS).cast("int").alias("chunks"))
    shape = stored(asking.join(size, "grp"), "ngram-shape")
    texts = sets.select("key", "text")
    left = (pairs.join(shape, "grp").join(texts, "key")
            .withColumn("turn", F.pmod(F.xxhash64("key"), F.col("turns")).cast("int"))
            .withColumn("chunk", F.explode(F.expr("sequence(0, chunks - 1)"))))
    right = (members.join(shape, "grp").join(texts, "key")
             .withColumn("chunk", F.pmod(F.xxhash64("key"), F.col("chunks")).cast("int"))
             .withColumn("turn", F.explode(F.expr("sequence(0, turns - 1)"))))

    def compare(asked: pa.Table, group: pa.Table) -> pa.Table:
        others = [(k, shingles(t)) for k, t in zip(group["key"].to_pylist(), group["text"].to_pylist())]
        rows = []
        for key, text, grp in zip(asked["key"].to_pylist(), asked["text"].to_pylist(), asked["grp"].to_pylist()):
            own = shingles(text)
            rows.append((key, grp, next((k for k, t in others if similar(own, t)), None)))
        return pa.table([pa.array([r[i] for r in rows], pa.int64()) for i in range(3)], ["key", "grp", "other"])

    keys = ("grp", "turn", "chunk")
    # Aliases on one side: both come from the same tables.
    right = right.select(*[F.col(c).alias(c) for c in ("key", "text", *keys)])
    return left.select("key", "text", *keys).groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(
        compare, "key long, grp long, other long")


def shared_counts(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """How many shingles each set of ``left`` shares with each of ``right``."""
    counts = np.zeros((len(left), len(right)), np.float32)
    both = np.intersect1d(np.concatenate(left), np.concatenate(right))
    for at in range(0, len(both), COLUMNS):
        part, sides = both[at:at + COLUMNS], []
        for sets in (left, right):
            tokens, own = np.concatenate(sets), np.repeat(np.arange(len(sets)), list(map(len, sets)))
            place = np.minimum(np.searchsorted(part, tokens), len(part) - 1)
            held = part[place] == tokens
            matrix = np.zeros((len(sets), len(part)), np.float32)
            matrix[own[held], place[held]] = 1
            sides.append(matrix)
        counts += sides[0] @ sides[1].T
    return counts


def _under_hot(rows: DataFrame, sets: DataFrame) -> DataFrame:
    """Links ``a, b`` of sets that ask under a hot shingle with similar sets of larger groups that hold it too.

    ``rows`` has ``token, key, grp, size, asks``.  Similar sets share a shingle under which the one asks
    in both prefixes, so a group's other members are not needed.  Whole sets are compared, a chunk
    with a chunk, and pairs are never rows.
    """
    chunks = lambda df, name: df.groupBy("token").agg(
        F.ceil(F.count("*") / HELD).cast("int").alias(name))
    shape = stored(chunks(rows.where("asks"), "turns").join(chunks(rows, "chunks"), "token"), "ngram-hot")
    held = rows.join(shape, "token").join(sets.select("key", "text"), "key")
    place = lambda of: F.pmod(F.xxhash64("key"), F.col(of)).cast("int")
    every = lambda of: F.explode(F.expr(f"sequence(0, {of} - 1)"))
    left = held.where("asks").withColumns({"turn": place("turns"), "chunk": every("chunks"), "side": F.lit(0)})
    right = held.withColumns({"turn": every("turns"), "chunk": place("chunks"), "side": F.lit(1)})

    def compare(group: pa.Table) -> pa.Table:
        side, key, grp, size = (group[c].to_numpy() for c in ("side", "key", "grp", "size"))
        tokens = [shingles(t) for t in group["text"].to_pylist()]
        left, right = (np.flatnonzero(side == s) for s in (0, 1))
        found = np.empty((2, 0), np.int64)
        if len(left) and len(right):
            shared = shared_counts([tokens[i] for i in left], [tokens[i] for i in right])
            n = np.array(list(map(len, tokens)), np.int64)
            near = 100 * shared >= PERCENT * (n[left][:, None] + n[right] - shared)
            asks = (size[left][:, None] < size[right]) | ((size[left][:, None] == size[right]) & (grp[left][:, None] < grp[right]))
            one, two = np.nonzero(near & asks)
            one, two = left[one], right[two]
            # One link to a group is enough.
            first = np.unique(np.stack((one, grp[two])), axis=1, return_index=True)[1]
            found = np.stack((key[one[first]], key[two[first]]))
        return pa.table([pa.array(x) for x in found], ["a", "b"])

    names = ("token", "turn", "chunk", "side", "key", "grp", "size", "text")
    return left.select(*names).union(right.select(*names)).groupBy("token", "turn", "chunk").applyInArrow(
        compare, "a long, b long").distinct()


def _links(docs: DataFrame, surveyed: DataFrame, order: Order, buckets: int) -> DataFrame:
    """Links ``a, b`` between set keys, enough to connect what similar pairs connect."""
    shared = _partnered(docs, order, buckets)
    sizes = surveyed.where("kind = 0 AND n > 0").groupBy("key").agg(
        F.max("n").alias("n"), F.min("c").alias("of"))
    alive = stored(sizes.join(shared, "key").where(F.col("shared") >= least_shared(F.col("n"), MORE))
                   .select("key", "n", "of"), "ngram-alive")
    # The sets that may have a partner grow with the corpus: always a merge join.
    texts = stored(docs.select("c", "text").join(alive.hint("merge"), F.col("c") == F.col("of"))
                   .dropDuplicates(["key"]).select("key", "n", "text"), "ngram-texts")
    met = stored(_met(texts), "ngram-met")
    groups = connected_components(met)
    grp = texts.select("key").join(groups, F.col("key") == F.col("node"), "left").select(
        "key", F.coalesce("component", "key").alias("grp"))
    size = grp.groupBy("grp").agg(F.count("*").alias("size"))
    grp = stored(grp.join(size, "grp"), "ngram-groups")

    def expand(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, TEXTS):
                part = batch.slice(at, TEXTS)
                prefixes = [order.prefix(shingles(x.as_py()), MORE_OPEN) for x in part["text"]]
                many = [len(p) for p in prefixes]
                columns = [np.repeat(part[c].to_numpy(), many) for c in ("key", "n", "grp", "size")]
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(prefixes)), *map(pa.array, columns)],
                                                 ["token", "key", "n", "grp", "size"])

    rows = texts.join(grp, "key").select("key", "n", "grp", "size", "text").mapInArrow(
        expand, "token long, key long, n long, grp long, size long")
    # Of ``have`` shingles that other groups hold too, a set shares ``least_shared`` with each similar
    # set, so one of them at least without the last ``least_shared - 1``: those in most groups do not ask.
    many = rows.select("token", "grp").distinct().groupBy("token").agg(F.count("*").alias("many")).where("many > 1")
    ranked = rows.join(many, "token").withColumns({
        "have": F.expr("count(*) OVER (PARTITION BY key)"),
        "place": F.expr("row_number() OVER (PARTITION BY key ORDER BY many, token)")})
    rows = stored(ranked.select("token", "key", "grp", "size", "many", (
        F.col("place") <= F.col("have") - least_shared(F.col("n"), MORE_OPEN) + 1).alias("asks")), "ngram-tokens")
    hot, cold = rows.where(f"many > {HOT}"), rows.where(f"many <= {HOT}")
    # The matrix: a group's union of tokens.  Similarity is mutual, so it is enough that the
    # sets of the smaller of two groups ask the larger one.
    matrix = cold.select("token", F.col("grp").alias("to"), F.col("size").alias("of")).distinct()
    pairs = (cold.where("asks").join(matrix, "token").where("size < of OR (size = of AND grp < to)")
             .select("key", F.col("to").alias("grp")).distinct())
    pairs = stored(pairs, "ngram-pairs")
    # A group's members are connected, so one link is enough: few members are tried first.
    members = grp.select("key", "grp")
    few = members.withColumn("__n", F.expr("row_number() OVER (PARTITION BY grp ORDER BY key)")).where(
        F.col("__n") <= SEEDS).select("key", "grp")
    opened = stored(_open(pairs, few, texts), "ngram-opened")
    left = opened.groupBy("key", "grp").agg(F.max("other").alias("other")).where("other IS NULL")
    large = members.join(size.where(F.col("size") > SEEDS).select("grp"), "grp", "left_semi")
    rest = _open(stored(left.select("key", "grp"), "ngram-left"), large, texts)
    return (met.union(_under_hot(hot, texts)).union(opened.where("other IS NOT NULL").select("key", "other"))
            .union(rest.where("other IS NOT NULL").select("key", "other")))


def join_components(docs: DataFrame) -> DataFrame:
    """All documents with ``n_shingles`` and ``component_id``.

    Two documents link if their shingle sets are ``PERCENT`` similar; a component is
    what links reach, and its id the smallest ``doc_id`` in it (nulls last).  Texts
    without words have no shingles and are a component of their own row's id.
    Repeated rows are documents like others.  Input columns named like a result are
    replaced.  Similarity is exact up to collisions of 64-bit hashes of shingles, sets
    and texts.  Runs jobs at once; intermediate tables go to the shared folder.
    """
    found = _components(docs).select(F.col("c").alias("__of"), *RESULTS[:1], F.col("least").alias("component_id"))
    found = found.distinct()  # a row a text
    return (without(docs, RESULTS).withColumn("__c", F.xxhash64("text"))
            .join(found, F.col("__c") == F.col("__of")).withColumn("component_id", F.when(
                F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id")))
            .drop("__c", "__of"))


def representatives(docs: DataFrame) -> DataFrame:
    """One document of each component: that of the smallest id (nulls last), of equal ids one text.

    Texts without words stay; of rows equal in id and text one stays.
    """
    found = _components(docs)
    last = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "c")
    first = found.where("n_shingles > 0").groupBy("component").agg(F.min(last).alias("first")).select("first.*")
    empty = found.where("n_shingles = 0").select(F.col("doc_id").isNull().alias("none"), "doc_id", "c")
    keep = first.union(empty).distinct().toDF("__none", "__id", "__of")
    own = docs.withColumn("__c", F.xxhash64("text"))
    return (own.join(keep, F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("__c") == F.col("__of")), "left_semi")
            .dropDuplicates(["doc_id", "__c"]).drop("__c"))


def _components(docs: DataFrame) -> DataFrame:
    """``doc_id, c, n_shingles, component, least``: a row a document, ``c`` the hash of its text."""
    coded = docs.select("doc_id", F.xxhash64("text").alias("c"), "text")
    surveyed = stored(_survey(coded), "ngram-survey")
    top = surveyed.where("kind = 1").groupBy("token").agg(F.sum("many").alias("many")).orderBy(
        F.desc("many"), "token").limit(FREQUENT).collect()
    order = Order([r.token for r in reversed(top)])
    total = surveyed.where("kind = 0").agg(F.sum("n")).first()[0] or 0
    links = stored(_links(coded, surveyed, order, parts_for(math.ceil(total / 4), ENTRIES)), "ngram-links")
    of = connected_components(links)
    rows = surveyed.where("kind = 0").select("doc_id", "c", "n", "key")
    keyed = stored(rows.join(of, F.col("key") == F.col("node"), "left").select(
        "doc_id", "c", F.col("n").alias("n_shingles"), F.coalesce("component", "key").alias("component")),
        "ngram-keyed")
    least = keyed.where("n_shingles > 0").groupBy(F.col("component").alias("of")).agg(
        F.min("doc_id").alias("least"))
    return keyed.join(least, (F.col("component") == F.col("of")) & (F.col("n_shingles") > 0), "left").drop("of")
