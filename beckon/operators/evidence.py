"""Similar past messages as evidence: TF-IDF, scope choice, exact top-k.

The vocabulary is at most 500 terms, so it is the one thing that is brought to
the driver and sent to all tasks; a message becomes a sparse vector without a
shuffle.  Candidates are limited to the scope a message chose (same sender,
group, business or user).  Equal vectors inside a scope are merged before any
comparison: equal messages ask once, and of equal history rows only the k most
recent can ever be in a top-k, so the others are left out without changing
the result.  What remains is cut into blocks of similar rows, and blocks that
cannot hold one of the best rows are skipped (``pruned.py``).
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import pyarrow as pa
from pyspark.ml.feature import CountVectorizerModel, ElementwiseProduct, Normalizer
from pyspark.ml.linalg import Vectors
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from beckon import lexicons as L
from beckon.functions.match import UNICODE, case, filled, quoted, quoted_list
from beckon.operators.asof import as_of, micros
from beckon.operators.pruned import RECENCY_DAYS, RECENCY_WEIGHT, Visits, boost_of_days, dense, doubles, pruned_top_k
from beckon.session import staged, where_computed

VOCABULARY_SIZE = 500
TOP_K = 3
MIN_SCORE = 0.2
MIN_TEXT = 10
SCORE_DIGITS = 6


# --- terms and weights -----------------------------------------------------

def content_words(text: str, stop_words: list[str] | None = None) -> str:
    """Lower-case words of two or more characters that are no stop words, as SQL text."""
    stop = L.STOP_WORDS if stop_words is None else stop_words
    words = f"regexp_extract_all(lower({filled(text)}), {quoted(UNICODE + r'\w\w+')}, 0)"
    return f"filter({words}, w -> w NOT IN {quoted_list(stop)})" if stop else words


def with_terms(df: DataFrame, text_col: str = "message_text", out_col: str = "terms",
               stop_words: list[str] | None = None) -> DataFrame:
    """Add the array of unigrams and bigrams of a text."""
    bigrams = ("if(size(_words) > 1, zip_with(slice(_words, 1, size(_words) - 1), "
               "slice(_words, 2, size(_words) - 1), (a, b) -> concat(a, ' ', b)), "
               "cast(array() AS array<string>))")
    return (df.withColumn("_words", F.expr(content_words(text_col, stop_words)))
            .withColumn(out_col, F.expr(f"concat(_words, {bigrams})")).drop("_words"))


def vocabulary(history: DataFrame, size: int = VOCABULARY_SIZE,
               stop_words: list[str] | None = None) -> DataFrame:
    """The most frequent terms: ``term, cf, df``; ties in term order.

    One scan and one shuffle of partially summed counts: each text contributes
    its terms for ``cf`` and its different terms for ``df``.
    """
    listed = with_terms(history.select("message_text"), stop_words=stop_words)
    return _counted_terms(listed).where(F.col("term").isNotNull()).orderBy(
        F.desc("cf"), "term").limit(size)


def _counted_terms(listed: DataFrame) -> DataFrame:
    """``term, cf, df``; the NULL term counts the texts themselves.

    Each text gives its terms, its different terms and one NULL term.
    """
    parts = listed.select(F.expr(
        "explode(array(struct(0 AS part, terms AS terms), "
        "struct(1 AS part, array_distinct(terms) AS terms), "
        "struct(2 AS part, array(cast(NULL AS string)) AS terms)))").alias("p"))
    rows = parts.select("p.part", F.explode("p.terms").alias("term"))
    return rows.groupBy("term").agg(F.count_if(F.col("part") == 0).alias("cf"),
                                    F.count_if(F.col("part") > 0).alias("df"))


class TfIdf:
    """A fitted vocabulary with smooth inverse document frequencies."""

    def __init__(self, terms: list[str], idf: list[float],
                 stop_words: list[str] | None = None) -> None:
        self.terms = terms
        self.idf = idf
        self.stop_words = stop_words
        self._stages: list | None = None

    @staticmethod
    def fit(history: DataFrame, size: int = VOCABULARY_SIZE,
            stop_words: list[str] | None = None) -> "TfIdf":
        """One action, which returns the (at most ``size``) terms and the row count."""
        listed = with_terms(history.select("message_text"), stop_words=stop_words)
        rows = _counted_terms(listed).orderBy(
            F.col("term").isNotNull(), F.desc("cf"), "term").limit(size + 1).collect()
        n = rows[0]["df"] if rows else 0
        rows = sorted(rows[1:], key=lambda r: r["term"])
        return TfIdf([r["term"] for r in rows],
                     [math.log((1 + n) / (1 + r["df"])) + 1 for r in rows], stop_words)

    def stages(self) -> list:
        """Count, weigh, normalise: row-local transformers around the vocabulary."""
        if self._stages is None:
            self._stages = [
                CountVectorizerModel.from_vocabulary(self.terms, "_terms", "_tf"),
                ElementwiseProduct(scalingVec=Vectors.dense(self.idf), inputCol="_tf",
                                   outputCol="_tfidf"),
                Normalizer(p=2.0, inputCol="_tfidf", outputCol="_unit")]
        return self._stages

    def counts(self, df: DataFrame, text_col: str = "message_text") -> DataFrame:
        """Add ``term_ids`` and ``counts``: the known terms of the text and how often it has them.

        With the frequencies of the model these give the unit vector, in a fraction of its bytes;
        so counts travel, and weights are made where vectors meet.  Counts that are there are kept.
        """
        if {"term_ids", "counts"} <= set(df.columns):
            return df
        out = with_terms(df, text_col, "_terms", self.stop_words)
        number = "smallint" if len(self.terms) <= 2 ** 15 else "int"
        if not self.terms:
            return out.drop("_terms").withColumns({
                "term_ids": F.expr(f"cast(array() AS array<{number}>)"),
                "counts": F.expr("cast(array() AS array<int>)")})
        return (self.stages()[0].transform(out).withColumn("_v", F.unwrap_udt("_tf"))
                .withColumns({"term_ids": F.col("_v.indices").cast(f"array<{number}>"),
                              "counts": F.col("_v.values").cast("array<int>")})
                .drop("_terms", "_tf", "_v"))

    def vectors(self, df: DataFrame, text_col: str = "message_text") -> DataFrame:
        """Add ``term_ids`` and ``weights``: the unit vector of the text, row by row.

        Words are stopped by the list that the vocabulary was fitted with.
        """
        out = with_terms(df, text_col, "_terms", self.stop_words)
        if not self.terms:
            return out.drop("_terms").withColumns({
                "term_ids": F.expr("cast(array() AS array<int>)"),
                "weights": F.expr("cast(array() AS array<double>)")})
        for stage in self.stages():
            out = stage.transform(out)
        return (out.withColumn("_v", F.unwrap_udt("_unit"))
                .withColumns({"term_ids": F.col("_v.indices"), "weights": F.col("_v.values")})
                .drop("_terms", "_tf", "_tfidf", "_unit", "_v"))


def term_weights(df: DataFrame, model: TfIdf, spark: SparkSession,
                 id_col: str = "message_id") -> DataFrame:
    """The vectors as rows ``id, term, weight``."""
    names = F.broadcast(spark.createDataFrame(
        list(enumerate(model.terms)), "term_id int, term string"))
    rows = model.vectors(df.select(id_col, "message_text")).select(
        id_col, F.explode(F.arrays_zip("term_ids", "weights")).alias("z"))
    return rows.select(id_col, F.col("z.term_ids").alias("term_id"),
                       F.col("z.weights").alias("weight")).join(names, "term_id").select(
                           id_col, "term", "weight")


# --- scope -----------------------------------------------------------------

SCOPES = {"sender": "sender_user_id", "group": "group_id", "business": "business_id"}


def _scopes_of_row() -> Column:
    """Every scope a row belongs to, as structs; missing ids belong to none."""
    named = ", ".join(
        f"if({filled(c)} != '', struct('{kind}' AS kind, {c} AS id), NULL)"
        for kind, c in SCOPES.items())
    return F.expr(f"explode(array_compact(array(struct('user' AS kind, '' AS id), {named})))")


def scope_sizes(history: DataFrame) -> DataFrame:
    """Rows and time range of every scope of every user, by partial aggregation."""
    member = history.select("user_id", "created_at", _scopes_of_row().alias("s"))
    return member.groupBy("user_id", F.col("s.kind").alias("kind"), F.col("s.id").alias("id")).agg(
        F.count(F.lit(1)).alias("scope_rows"),
        F.max("created_at").alias("newest"), F.min("created_at").alias("oldest"))


def scoped_messages(messages: DataFrame, sizes: DataFrame) -> DataFrame:
    """``message_id`` with the chosen scope ``user_id, kind, id, scope_rows``.

    ``sizes`` is a stored table from ``scope_sizes``.  Sender first, then group,
    then business.  A narrower scope is also tried when the scope chosen so far
    is the user's whole history.
    """
    asked = messages.select("message_id", "user_id", _scopes_of_row().alias("s")).select(
        "message_id", "user_id", "s.*")
    # sizes of the (at most four) scopes of a message, side by side
    return _chosen(asked.join(sizes.select("user_id", "kind", "id", "scope_rows"),
                              ["user_id", "kind", "id"]))


def scopes_as_of(messages: DataFrame, history: DataFrame) -> DataFrame:
    """The same from the history older than each message, with the time ``newest`` of its
    last row in microseconds.

    The rows and the newest time of a scope are running values over its rows' times,
    looked up as of the message.  Runs jobs at once.
    """
    times = micros(F.col("created_at")).alias("at")
    asked = messages.select("message_id", "user_id", times, _scopes_of_row().alias("s")).select(
        "message_id", "user_id", "at", "s.*")
    facts = history.select("user_id", times, _scopes_of_row().alias("s")).select(
        "user_id", "at", "s.*", F.lit(1).alias("scope_rows"), F.col("at").alias("newest"))
    return _chosen(as_of(asked, facts, ["user_id", "kind", "id"], ["scope_rows"], ["newest"]).where("scope_rows > 0"),
                   ["newest"])


def _chosen(sized: DataFrame, more: list[str] = ()) -> DataFrame:
    """The scope each message chooses, from a row per message and scope that has rows."""
    fields = ", ".join(["scope_rows", "id", *more])
    wide = sized.groupBy("message_id", "user_id").agg(*[
        F.expr(f"max(if(kind = '{kind}', struct({fields}), NULL))").alias(kind) for kind in ["user", *SCOPES]])
    chosen = "'user'"
    for position, kind in enumerate(SCOPES):
        size = case([(f"{chosen} = '{k}'", f"{k}.scope_rows") for k in ["user", *SCOPES]])
        whole = "true" if position == 0 else f"{size} = user.scope_rows"
        wide = wide.withColumn(f"_after_{kind}", F.expr(
            f"if({kind} IS NOT NULL AND {whole}, '{kind}', {chosen})"))
        chosen = f"_after_{kind}"
    picked = case([(f"{chosen} = '{k}'", k) for k in ["user", *SCOPES]])
    return wide.withColumn("_scope", F.expr(picked)).select(
        "message_id", "user_id", F.col(chosen).alias("kind"), F.col("_scope.id").alias("id"),
        F.col("_scope.scope_rows").alias("scope_rows"), *[F.col(f"_scope.{c}").alias(c) for c in more])


# --- retrieval -------------------------------------------------------------

def _scope_key() -> Column:
    return F.to_json(F.struct("user_id", "kind", "id"))


def recency_boost(created: Column, newest: Column, oldest: Column) -> Column:
    """Up to 0.15 for the newest row of a scope, fading with its age in days.

    Rows without a time count as the oldest; a scope without times gives none.
    """
    micros = lambda c: F.unix_micros(c.cast("timestamp"))
    days = (micros(newest) - micros(F.coalesce(created, oldest))) / F.lit(86_400_000_000.0)
    return F.coalesce(F.exp(-days / F.lit(RECENCY_DAYS)) * F.lit(RECENCY_WEIGHT), F.lit(0.0))


@dataclass(frozen=True)
class Weighed:
    """Stored scope sizes and vectors of a history."""

    sizes: DataFrame
    vectors: DataFrame


def _counts_of(df: DataFrame) -> list[str]:
    """The columns of ``TfIdf.counts``, where a table has them."""
    return [c for c in ("term_ids", "counts") if c in df.columns]


def counted(df: DataFrame, model: TfIdf) -> DataFrame:
    """What searches and cosines read of messages, with their counts of terms, stored.

    Of the text only as many characters stay as tell whether it is long enough.
    """
    short = F.substring("message_text", 1, MIN_TEXT).alias("message_text")
    counts = model.counts(df.select("message_id", "user_id", "created_at", "message_text", *SCOPES.values()))
    return staged(counts.withColumn("message_text", short), "counted")


def _weigh(history: DataFrame, model: TfIdf) -> DataFrame:
    return where_computed(model.counts(history.select(
        "message_id", "user_id", "created_at", "message_text", *SCOPES.values(), *_counts_of(history))),
        "size(term_ids) > 0").select("message_id", "user_id", "created_at", "term_ids",
                                     "counts", *SCOPES.values())


def weighed(history: DataFrame, model: TfIdf) -> Weighed:
    """A history prepared for many searches, such as those of a stream's batches."""
    return Weighed(staged(scope_sizes(history), "scope-sizes"),
                   staged(_weigh(history, model), "history-vectors"))


def top_evidence(messages: DataFrame, history: DataFrame | Weighed, model: TfIdf, k: int = TOP_K,
                 block_rows: int = 512, point_in_time: bool = False,
                 visits: list[Visits] | None = None) -> DataFrame:
    """The best ``k`` history rows per message with a score above 0.2.

    Returns ``message_id, rank, evidence_id, score``.  Score: cosine plus
    recency boost, rounded to six digits; ties go to the later row.
    ``point_in_time`` admits only history older than the message, in the choice of
    the scope and in its newest row too (``history`` is a table then); nothing
    is merged by vector, as each message sees other rows.  What was visited is
    added to the list ``visits``, if there is one.
    """
    scope = ["user_id", "kind", "id"]
    usable = messages.where(f"length({filled('message_text')}) >= {MIN_TEXT}")
    prepared = isinstance(history, Weighed)
    if point_in_time and prepared:
        raise ValueError("a prepared history has no scopes as of a time")
    sizes = history.sizes if prepared else staged(scope_sizes(history), "scope-sizes")
    chosen = scopes_as_of(usable, history) if point_in_time else scoped_messages(usable, sizes).withColumn(
        "newest", F.lit(None).cast("long"))
    scoped = staged(chosen, "message-scopes")
    # the scopes in use, with their time range
    used = staged(scoped.select(*scope).distinct().join(sizes, scope), "scopes-in-use")
    # a row without a known term scores its recency boost at most, below 0.2
    asked = (where_computed(model.counts(scoped.join(
        usable.select("message_id", "created_at", "message_text", *_counts_of(usable)), "message_id")),
        "size(term_ids) > 0").select("message_id", *scope, "term_ids", "counts",
                     micros(F.col("created_at")).alias("asked_at"), F.col("newest").alias("asked_newest")))
    asked = asked.withColumn("scope_key", _scope_key()).drop(*scope)
    vectors = history.vectors if prepared else _weigh(history, model)
    candidates = (vectors
        .select("message_id", "user_id", "created_at", "term_ids", "counts",
                _scopes_of_row().alias("s"))
        .select("message_id", "user_id", "created_at", "term_ids", "counts", "s.*")
        .join(used, scope)
        .withColumn("boost", recency_boost(
            F.col("created_at"), F.col("newest"), F.col("oldest")))
        .withColumn("scope_key", _scope_key())
        .select("scope_key", F.col("message_id").alias("evidence_id"),
                F.unix_micros(F.col("created_at").cast("timestamp")).alias("at"),
                "boost", "term_ids", "counts"))
    if point_in_time:
        queries = asked.withColumn("query_id", F.col("message_id"))
        owners = None
    else:
        # stored with their vectors, which both the queries and their owners come from
        asked = staged(asked.withColumn("query_id", F.concat_ws("|", "scope_key", _vector_key())), "asked-vectors")
        owners = asked.select("message_id", "query_id")
        queries = asked.groupBy("scope_key", "query_id").agg(
            *[F.first(c).alias(c) for c in ["term_ids", "counts"]],
            *[F.lit(None).cast("long").alias(c) for c in ("asked_at", "asked_newest")])
        candidates = _most_recent_copies(candidates, k)
    # blocks are cut by what is left after equal queries and copies are merged
    queries = staged(queries.select("query_id", "scope_key", "term_ids", "counts", "asked_at", "asked_newest"),
                     "evidence-queries")
    found = pruned_top_k(queries, candidates, k, max(len(model.terms), 1), block_rows,
                         _block_top_k(k, max(len(model.terms), 1), model.idf, point_in_time), MIN_SCORE,
                         model.idf, point_in_time)
    if visits is not None:
        visits.append(found)
    order = Window.partitionBy("query_id").orderBy(
        F.desc("score"), F.desc_nulls_last("at"), F.desc("evidence_id"))
    # k rows per visit remain: the window sorts k x visited blocks rows per query
    ranked = found.found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    if owners is None:
        return ranked.select(F.col("query_id").alias("message_id"), "rank", "evidence_id",
                             "score")
    return owners.join(ranked, "query_id").select("message_id", "rank", "evidence_id", "score")


def _vector_key() -> Column:
    """128 bits that stand for the vector."""
    return F.concat_ws(":", F.xxhash64("term_ids", "counts"),
                       F.xxhash64(F.lit(1), "counts", "term_ids"))


def _most_recent_copies(candidates: DataFrame, k: int) -> DataFrame:
    """Of history rows with one vector in one scope, the ``k`` most recent.

    Copies have the same cosine with every message, so order among them is by
    recency alone and the k-th is the last that can be in a top-k.  Spark
    keeps k rows per group and task before the shuffle (window group limit),
    so a group of copies of any size arrives thinned.
    """
    newest_first = Window.partitionBy("scope_key", "_vector").orderBy(
        F.desc_nulls_last("at"), F.desc("evidence_id"))
    return (candidates.withColumn("_vector", _vector_key())
            .withColumn("_n", F.row_number().over(newest_first))
            .where(F.col("_n") <= k).drop("_vector", "_n"))


def _block_top_k(k: int, size: int, idf: list[float], point_in_time: bool):
    """A function that finds the top-k right rows of each left row of two blocks."""
    import numpy as np

    schema = pa.schema([("query_id", pa.string()), ("score", pa.float64()),
                        ("at", pa.int64()), ("evidence_id", pa.string())])

    def top_k(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return schema.empty_table()
        # right rows in tie order, so that the column number decides ties
        right = right.sort_by([("at", "descending"), ("evidence_id", "descending")])
        if point_in_time:  # rows without a time are older than nothing
            right = right.filter(right["at"].is_valid())
            if not right.num_rows:
                return schema.empty_table()
        boost = right["boost"].to_numpy()
        history = dense(right, size, idf).T
        seen_at = right["at"].to_numpy()
        scopes = pa.chunked_array([*left["scope_key"].chunks, *right["scope_key"].chunks]).combine_chunks()
        scopes = scopes.dictionary_encode().indices.to_numpy()
        own_scope, scope = scopes[:left.num_rows], scopes[left.num_rows:]
        chunk = max(1, 4_000_000 // right.num_rows)
        parts = []
        for start in range(0, left.num_rows, chunk):
            piece = left.slice(start, chunk)
            cosines = dense(piece, size, idf) @ history
            if point_in_time:
                asked, newest = (piece[c].to_numpy()[:, None] for c in ("asked_at", "asked_newest"))
                days = (newest - seen_at[None, :]) / 86_400_000_000.0
                older = seen_at[None, :] < asked
                boost = np.where(older, boost_of_days(np.where(older, days, 0.0)), -2.0)
            scores = np.round(cosines + boost, SCORE_DIGITS)
            inside = own_scope[start:start + chunk, None] == scope[None, :]
            row, col = np.nonzero((scores > MIN_SCORE) & inside)
            value = scores[row, col]
            order = np.lexsort((col, -value, row))
            row, col, value = row[order], col[order], value[order]
            keep = np.arange(len(row)) - np.searchsorted(row, row) < k
            row, col, value = row[keep], col[keep], value[keep]
            parts.append(pa.table([
                piece["query_id"].take(pa.array(row)).cast(pa.string()), pa.array(value),
                right["at"].take(pa.array(col)),
                right["evidence_id"].take(pa.array(col)).cast(pa.string())], schema=schema))
        return pa.concat_tables(parts)

    return top_k


def evidence_lists(messages: DataFrame, top: DataFrame) -> DataFrame:
    """``message_id, evidence_message_ids``: ids joined by ';' or 'none'."""
    joined = top.groupBy("message_id").agg(F.concat_ws(";", F.transform(
        F.array_sort(F.collect_list(F.struct("rank", "evidence_id"))),
        lambda s: s["evidence_id"])).alias("_ids"))
    return messages.select("message_id").join(joined, "message_id", "left").select(
        "message_id", F.coalesce("_ids", F.lit("none")).alias("evidence_message_ids"))


# --- topic similarity ------------------------------------------------------

def parse_evidence(ids: str) -> Column:
    """Ids of a ';' list; none, None and the empty text give an empty list."""
    return F.expr(f"if({filled(ids)} IN ('', 'none', 'None'), cast(array() AS array<string>), "
                  f"transform(split({ids}, ';'), x -> trim(x)))")


def topic_similarity(messages: DataFrame, evidence: DataFrame, history: DataFrame,
                     model: TfIdf) -> DataFrame:
    """Mean cosine of each message with its evidence: ``message_id, topic_similarity``.

    ``evidence`` has ``message_id, evidence_message_ids``.  The list is joined
    as rows, so a popular history row is never collected in one place.
    """
    pairs = evidence.select(
        "message_id", F.explode(F.array_distinct(
            parse_evidence("evidence_message_ids"))).alias("evidence_id"))
    idf = doubles(model.idf)

    def measured(df: DataFrame, key: str, prefix: str) -> DataFrame:
        weight = f"z.counts * {idf}[z.term_ids]"
        length = F.expr(f"sqrt(aggregate(arrays_zip(term_ids, counts), 0.0D, (acc, z) -> acc + {weight} * {weight}))")
        return model.counts(df.select(F.col("message_id").alias(key), "message_text", *_counts_of(df))).select(
            key, F.col("term_ids").alias(f"{prefix}_ids"), F.col("counts").alias(f"{prefix}_counts"),
            length.alias(f"{prefix}_length"))

    both = (pairs.join(measured(history, "evidence_id", "past"), "evidence_id")
            .join(measured(messages, "message_id", "own"), "message_id")
            .withColumn("_past", F.map_from_arrays("past_ids", "past_counts")))
    # counts of terms in both, weighed; a text without a known term is like no other
    cosine = F.expr("if(own_length * past_length = 0, 0.0D, aggregate(arrays_zip(own_ids, own_counts), 0.0D, (acc, z) -> "
                    f"acc + z.own_counts * {idf}[z.own_ids] * {idf}[z.own_ids] "
                    "* coalesce(try_element_at(_past, z.own_ids), 0)) / nullif(own_length * past_length, 0.0D))")
    return both.groupBy("message_id").agg(F.avg(cosine).alias("topic_similarity"))
