"""Quality rules: per-text counts and cross-document line frequency per host.

Only DataFrame and SQL functions.  Lines are normalised and hashed; per host
(``source``) the distinct documents (texts) that hold a line are counted; lines that
reach the limit are removed, and documents that are depleted by it are rejected.  The
limit is a number of documents, the same for hosts of any size.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from beckon.llm.common import WORD, stored, without

BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
RESULTS = (*BASE, "n_common_words", "clean_text", "kept")
SPACE = "[\\x20\\x09-\\x0D]"
WINDOW = 5


def base_counts(docs: DataFrame) -> DataFrame:
    """Documents with the base counts; row-local.

    A word is repeated if a five-word window that holds it occurs twice or more in
    the text.  Windows are compared by a 64-bit hash: texts without a repeated one
    stop at the distinct count; in others the windows are sorted by (hash, place),
    those equal to a neighbour are repeated, and each covers its words up to the
    next repeated window.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    at = lambda i, k: F.element_at("__words", (i + k).cast("int"))
    df = (
        without(docs, BASE)
        .withColumn("__words", F.array_remove(F.split(text, f"{SPACE}+"), ""))
        .withColumn("__lines", F.filter(F.split(text, "\n"), lambda x: F.regexp_like(x, F.lit(WORD))))
        .withColumn("n_words", F.size("__words").cast("long"))
        .withColumn("__windows", F.when(F.col("n_words") >= WINDOW, F.transform(
            F.sequence(F.lit(1), F.col("n_words").cast("int") - (WINDOW - 1)),
            lambda i: F.xxhash64(*[at(i, k) for k in range(WINDOW)]))))
        .withColumn("__sorted", F.expr(
            "CASE WHEN size(array_distinct(__windows)) < size(__windows) THEN"
            " sort_array(transform(__windows, (h, i) -> struct(h, i))) END"))
        .withColumn("__repeated", F.expr(
            "sort_array(transform(filter(__sorted, (x, k) -> coalesce(x.h = get(__sorted, k - 1).h, false)"
            " OR coalesce(x.h = get(__sorted, k + 1).h, false)), x -> x.i))"))
        .withColumn("n_repeat_words", F.expr(
            f"coalesce(aggregate(transform(__repeated, (p, k) ->"
            f" least({WINDOW}, coalesce(get(__repeated, k + 1) - p, {WINDOW}))), 0L, (s, x) -> s + x), 0L)"))
        .withColumn("word_chars", (F.length(text) - F.regexp_count(text, F.lit(SPACE))).cast("long"))
        .withColumn("n_symbols", F.regexp_count(text, F.lit("[#*$%&|<>]")).cast("long"))
        .withColumn("n_dup_lines", (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("long")))
    return df.withColumn("base_failed", (F.col("n_words") < 10) | (
        100 * F.col("n_repeat_words") > 20 * F.col("n_words"))).drop(
        "__words", "__lines", "__windows", "__sorted", "__repeated")


def line_key(line: Column) -> Column:
    """Hash of a normalised line: ASCII lower case, white space squeezed and trimmed."""
    low = F.translate(line, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.xxhash64(F.trim(F.regexp_replace(low, f"{SPACE}+", " ")))


def keyed_lines(text: Column) -> Column:
    """``line_key`` and number of words of each line with a word; the text is normalised as a whole."""
    low = F.translate(F.regexp_replace(text, "[\\x20\\x09\\x0B-\\x0D]+", " "),
                      "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    lines = F.filter(F.transform(F.split(low, "\n"), lambda x: F.trim(x)), lambda x: x != "")
    return F.transform(lines, lambda x: F.struct(F.xxhash64(x).alias("line"), (
        F.length(x) - F.length(F.replace(x, F.lit(" "), F.lit(""))) + 1).alias("words")))


def common_words(docs: DataFrame, limit: int = 10) -> DataFrame:
    """``host, doc, n_common_words, lines`` of texts with lines that reach the limit of their host.

    A line reaches it if ``limit`` distinct texts (``doc``, by hash) of the host hold it; a
    null source is a host.  First lines are counted by rows, which needs no text and keeps
    few; only those are counted by distinct texts.  Hosts and lines that many rows share
    are summed where they are, and met again by (host, line).
    """
    rows = docs.where("text IS NOT NULL").select(
        F.col("source").alias("host"), F.xxhash64("text").alias("doc"), F.monotonically_increasing_id().alias("row"),
        keyed_lines(F.col("text")).alias("k"))
    rows = rows.select("host", "doc", "row", F.explode("k").alias("k")).select("host", "doc", "row", "k.line", "k.words")
    many = stored(rows.groupBy("host", "line").count().where(F.col("count") >= limit).select(
        F.col("host").alias("of"), F.col("line").alias("many")), "many-lines")
    # A line's words in a text, repeats counted; copies of a text say the same.
    held = (rows.join(many, F.col("host").eqNullSafe(F.col("of")) & (F.col("line") == F.col("many")))
            .groupBy("host", "doc", "row", "line").agg(F.sum("words").alias("words"))
            .groupBy("host", "doc", "line").agg(F.max("words").alias("words")))
    held = stored(held, "held-lines")
    common = held.groupBy(F.col("host").alias("of"), F.col("line").alias("many")).count().where(F.col("count") >= limit)
    return (held.join(common.drop("count"), F.col("host").eqNullSafe(F.col("of")) & (F.col("line") == F.col("many")))
            .groupBy("host", "doc").agg(F.sum("words").alias("n_common_words"), F.collect_list("line").alias("lines")))


def quality_rules(docs: DataFrame, limit: int = 10, min_left: float = 0.5) -> DataFrame:
    """All documents with the base counts and the method's verdict.

    ``n_common_words`` are the words in lines that ``limit`` distinct texts of the host
    hold, ``clean_text`` is the text without those lines (null stays null), and ``kept``
    holds where the base rules pass and at least ``min_left`` of the words are left.  A
    null or empty text has no words and fails.  Repeated rows are judged alike.  Input
    columns named like a result are replaced.  Writes the tables of common lines at once.
    """
    found = common_words(docs, limit).toDF("__host", "__of", "n_common_words", "__keys")
    df = base_counts(without(docs, RESULTS)).withColumn("__doc", F.xxhash64("text")).join(
        found, F.col("source").eqNullSafe(F.col("__host")) & (F.col("__doc") == F.col("__of")), "left")
    kept_lines = F.filter(F.split("text", "\n"), lambda x: ~(
        F.array_contains("__keys", line_key(x)) & F.regexp_like(x, F.lit(WORD))))
    return (
        df.withColumn("n_common_words", F.coalesce("n_common_words", F.lit(0)).cast("long"))
        .withColumn("clean_text", F.when(F.col("__keys").isNotNull() & F.col("text").isNotNull(), F.array_join(kept_lines, "\n"))
                    .otherwise(F.col("text")))
        .withColumn("kept", ~F.col("base_failed") & (
            F.col("n_words") - F.col("n_common_words") >= F.col("n_words") * F.lit(min_left)))
        .drop("__keys", "__host", "__of", "__doc"))
