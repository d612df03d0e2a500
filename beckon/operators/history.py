"""History features: reaction aggregates and relation lookups per message."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from beckon import lexicons as L
from beckon.functions.match import UNICODE, filled, quoted
from beckon.operators.blocks import LEFT_ROWS, RIGHT_ROWS, block_pairs, with_group_sizes
from beckon.operators.joins import hot_keys, lookup
from beckon.session import staged, where_computed

BUSINESS_SENDER = "business"
COMMON_WORDS = 3
WORDS_AT_ONCE = 2048


@dataclass(frozen=True)
class HistoryTables:
    """The tables that the history features read."""

    history: DataFrame
    reactions: DataFrame
    daily: DataFrame
    business_history: DataFrame
    group_members: DataFrame


def _zero(name: str, kind: str = "double") -> Column:
    return F.coalesce(F.col(name), F.lit(0)).cast(kind).alias(name)


def sender_key(col: Column) -> Column:
    """Messages without a sender share the bucket ``business``."""
    return F.when(F.coalesce(col, F.lit("")) == "", F.lit(BUSINESS_SENDER)).otherwise(col)


# --- aggregates ------------------------------------------------------------

def reactions_with_sender(reactions: DataFrame, history: DataFrame) -> DataFrame:
    """Reactions with the sender of the message; unknown messages keep NULL."""
    senders = history.select("message_id", "sender_user_id")
    return reactions.join(senders, "message_id", "left")


def sender_stats(reactions: DataFrame, history: DataFrame) -> DataFrame:
    """Counts of each reaction per recipient and sender."""
    def ones(column: str, name: str) -> Column:
        return F.count_if(F.col(column) == 1).alias(name)

    return (reactions_with_sender(reactions, history)
            .groupBy("user_id", sender_key(F.col("sender_user_id")).alias("sender_key"))
            .agg(F.count(F.lit(1)).alias("message_count"),
                 ones("message_opened", "opened"), ones("message_replied", "replied"),
                 ones("notification_dismissed", "dismissed"),
                 ones("message_reported", "reported"),
                 ones("muted_after_message", "muted")))


def sender_features(stats: DataFrame, keys: tuple[str, ...] = ("user_id", "sender_key")) -> DataFrame:
    """Rates and trust score of each (recipient, sender), or of other ``keys`` of the counts."""
    n = F.greatest(F.col("message_count"), F.lit(1))
    return stats.select(
        *keys,
        F.col("message_count").cast("double").alias("sender_message_count"),
        (F.col("replied") / n).alias("sender_reply_rate"),
        (F.col("opened") / n).alias("sender_open_rate"),
        (F.col("dismissed") / n).alias("sender_dismiss_rate"),
        F.col("reported").cast("double").alias("sender_report_count"),
    ).withColumn("sender_trust_score", (
        F.col("sender_reply_rate") * 2.0 + F.col("sender_open_rate") * 1.0
        - F.col("sender_dismiss_rate") * 3.0 - F.col("sender_report_count") * 10.0))


def user_stats(reactions: DataFrame, daily: DataFrame) -> DataFrame:
    """Totals, rates and daily load of each user of either table."""
    reacted = reactions.groupBy("user_id").agg(
        F.sum("message_opened").alias("total_opens"),
        F.sum("message_replied").alias("total_replies"),
        F.sum("notification_dismissed").alias("total_dismissed"),
        F.sum("message_reported").alias("total_reported"),
        F.count(F.lit(1)).alias("total_messages"))
    loaded = daily.groupBy("user_id").agg(
        F.avg("notifications_sent").alias("avg_daily_notifications"),
        F.avg("notifications_dismissed").alias("avg_daily_dismissals"))
    n = F.greatest(F.coalesce("total_messages", F.lit(0)), F.lit(1))
    return reacted.join(loaded, "user_id", "full").select(
        "user_id", *[_zero(c, "long") for c in [
            "total_opens", "total_replies", "total_dismissed", "total_reported",
            "total_messages"]],
        (F.coalesce("total_replies", F.lit(0)) / n).alias("reply_rate"),
        (F.coalesce("total_opens", F.lit(0)) / n).alias("open_rate"),
        _zero("avg_daily_notifications"), _zero("avg_daily_dismissals"))


def user_features(stats: DataFrame) -> DataFrame:
    """The four engagement features per user."""
    return stats.select(
        "user_id",
        F.col("total_opens").cast("double").alias("user_total_opens"),
        F.col("total_replies").cast("double").alias("user_total_replies"),
        F.col("reply_rate").alias("user_reply_rate"),
        F.col("avg_daily_notifications").alias("user_notification_load"))


def _latest(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The latest row per key, by partial aggregation."""
    rest = [c for c in df.columns if c not in keys]
    # the row in the order of its columns: it moves once, not as a value and its rank
    row = F.max(F.struct(F.col(order), *[F.col(c) for c in rest if c != order])).alias("_row")
    return df.groupBy(*keys).agg(row).select(*keys, *[F.col(f"_row.{c}") for c in rest])


def business_features(business_history: DataFrame) -> DataFrame:
    """Relation of each user to each business."""
    rows = business_history.select(
        "user_id", "business_id", "last_activity_at", "why_user_knows_account",
        "allows_promotions", "promotions_opted_out_at", "activity_count_180d")
    return _latest(rows, ["user_id", "business_id"], "last_activity_at").select(
        "user_id", "business_id",
        F.coalesce(F.col("why_user_knows_account").isin(L.RECENT_ORDER_RELATIONS), F.lit(False))
        .cast("double").alias("has_recent_order"),
        F.coalesce(F.col("allows_promotions") == 1, F.lit(False))
        .cast("double").alias("has_opted_in"),
        F.col("promotions_opted_out_at").isNotNull().cast("double").alias("has_opted_out"),
        F.coalesce("activity_count_180d", F.lit(0)).cast("double")
        .alias("business_interaction_count"))


def group_features(group_members: DataFrame) -> DataFrame:
    """Role and engagement of each user in each group."""
    rows = group_members.select(
        "user_id", "group_id", "joined_at", "role", "messages_sent_30d",
        "messages_read_30d", "replies_sent_30d", "group_muted_by_user")
    read = F.coalesce("messages_read_30d", F.lit(0))
    engagement = F.when(read > 0, F.least(
        F.coalesce("replies_sent_30d", F.lit(0)) / read, F.lit(1.0))).otherwise(F.lit(0.0))
    return _latest(rows, ["user_id", "group_id"], "joined_at").select(
        "user_id", "group_id",
        F.coalesce(F.col("role") == "admin", F.lit(False)).cast("double")
        .alias("is_group_admin"),
        F.coalesce("messages_sent_30d", F.lit(0)).cast("double").alias("group_message_count"),
        engagement.alias("group_engagement_rate"),
        F.coalesce(F.col("group_muted_by_user") == 1, F.lit(False)).cast("double")
        .alias("group_is_muted"))


def category_features(reactions: DataFrame, history: DataFrame) -> DataFrame:
    """Dismissals per history message of each (user, conversation type)."""
    sent = history.groupBy("user_id", "conversation_type").agg(
        F.count(F.lit(1)).alias("_messages"))
    owned = history.select("message_id", "user_id", "conversation_type")
    dismissed = (reactions.where(F.col("notification_dismissed") == 1)
                 .select("message_id", "user_id")
                 .join(owned, ["message_id", "user_id"])
                 .groupBy("user_id", "conversation_type")
                 .agg(F.count(F.lit(1)).alias("_dismissed")))
    rate = F.coalesce("_dismissed", F.lit(0)) / F.greatest("_messages", F.lit(1))
    return sent.join(dismissed, ["user_id", "conversation_type"], "left").select(
        "user_id", "conversation_type", rate.alias("category_dismiss_rate"))


# --- similar dismissals ----------------------------------------------------

def word_set(text: str) -> Column:
    """Different lower-case words of a text."""
    return F.expr(f"array_distinct(regexp_extract_all(lower({filled(text)}), "
                  f"{quoted(UNICODE + r'\w+')}, 0))")


def dismissed_texts(reactions: DataFrame, history: DataFrame, timed: bool = False) -> DataFrame:
    """Word sets of the texts each user dismissed, copies merged into a weight.

    Words move as one text with blanks between them, a fraction of the bytes of an array.
    With ``timed`` the reactions carry ``at``, and only copies of one moment are merged.
    """
    times = ["at"] if timed else []
    dismissed = reactions.where(F.col("notification_dismissed") == 1).select(
        "message_id", "user_id", *times)
    words = where_computed(history.select("message_id", F.array_sort(word_set("message_text")).alias("words")),
                           f"size(words) >= {COMMON_WORDS}").withColumn("words", F.array_join("words", " "))
    merged = (dismissed.join(words, "message_id")
              .withColumn("text_key", F.sha2(F.concat_ws(" ", *times, "words"), 256))
              .groupBy("user_id", "text_key", *times)
              .agg(F.first("words").alias("words"), F.count(F.lit(1)).alias("copies"))
              .withColumn("words", F.split("words", " ")))
    return merged if timed else merged.withColumn("at", F.lit(None).cast("long"))


def similar_dismissals(messages: DataFrame, reactions: DataFrame, history: DataFrame,
                       block_rows: int = 1024, point_in_time: bool = False) -> DataFrame:
    """Per message, how many texts its user dismissed share three or more words.

    Messages and dismissed texts of one user meet block by block; a task sees
    two blocks of bounded size and returns one row per message, never pairs.  Where a
    user has so many that blocks would be sent more often than words, they meet under
    the rarer words they share instead.
    With ``point_in_time`` only texts dismissed before the message count; the reactions
    then carry the time ``at`` in microseconds.  Runs jobs at once to count the merged texts.
    """
    # blocks are cut by what is left after copies are merged
    dismissed = staged(dismissed_texts(reactions, history, point_in_time), "dismissed-texts")
    asked_at = F.unix_micros(F.col("created_at").cast("timestamp")) if point_in_time else F.lit(None).cast("long")
    asked = staged(where_computed(messages.select("message_id", "user_id", asked_at.alias("at"), word_set("message_text")
                                                  .alias("words")), f"size(words) >= {COMMON_WORDS}").withColumn(
        "_row", F.monotonically_increasing_id()), "asked-words")

    def counted(df: DataFrame, rows: str, entries: str) -> DataFrame:
        indexed = F.size("words") - (COMMON_WORDS - 1)
        return df.groupBy("user_id").agg(F.count(F.lit(1)).alias(rows), F.sum(indexed).alias(entries))

    sizes = staged(counted(asked, LEFT_ROWS, "_left_entries").join(
        counted(dismissed, RIGHT_ROWS, "_right_entries"), "user_id"), "dismissal-sizes")
    # a user's rows are sent once per block of the other side, or once per word in the index
    blocked = (F.ceil(F.col(RIGHT_ROWS) / block_rows) * F.col(LEFT_ROWS)
               + F.ceil(F.col(LEFT_ROWS) / block_rows) * F.col(RIGHT_ROWS))
    heavy = blocked > F.col("_left_entries") + F.col("_right_entries")
    plain, hot = sizes.where(~heavy), sizes.where(heavy).select("user_id")
    pairs = [(asked.withColumn("place", F.lit(None).cast("int")), dismissed.withColumn("place", F.lit(None).cast("int")),
              plain, "user_id")]
    if not hot.isEmpty():
        pairs.append(_by_rare_words(asked.join(hot, "user_id"), dismissed.join(hot, "user_id")))
    found = [block_pairs(
        with_group_sizes(_joined(left), met, [key]), with_group_sizes(_joined(right), met, [key]),
        key=key, left_id="message_id", right_id="text_key", block_rows=block_rows, function=_count_overlaps,
        schema=T.StructType([T.StructField("message_id", T.StringType()),
                             T.StructField("similar_dismissals", T.LongType())])) for left, right, met, key in pairs]
    return reduce(DataFrame.unionAll, found).groupBy("message_id").agg(
        F.sum("similar_dismissals").cast("double").alias("similar_dismissals"))


def _joined(df: DataFrame) -> DataFrame:
    """Words as one text; they hold no blanks."""
    return df.withColumn("words", F.array_join("words", " "))


def _by_rare_words(asked: DataFrame, dismissed: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, str]:
    """Messages and dismissed texts listed under each of their words but the two most frequent ones.

    Words are ordered by the number of the user's dismissed texts that hold them, rarest first.
    Texts that share three words share one that is followed by two more in both, so they meet
    under the rarest word they share; there alone the pair counts.  A text is sent once per
    listed word, however many texts the user has.  Words that no dismissed text holds are left out.
    """
    counts = staged(dismissed.select("user_id", F.explode("words").alias("w")).groupBy("user_id", "w").agg(
        F.count(F.lit(1)).alias("n")), "dismissed-words")

    def listed(df: DataFrame, row: str, more: list[str], purpose: str) -> DataFrame:
        words = df.select("user_id", row, F.explode("words").alias("w")).join(counts, ["user_id", "w"])
        ordered = words.groupBy("user_id", row).agg(F.array_sort(F.collect_list(F.struct("n", "w"))).alias("_w"))
        sets = ordered.withColumn("words", F.col("_w.w")).where(f"size(words) >= {COMMON_WORDS}").join(
            df.select("user_id", row, *more), ["user_id", row])
        rank = F.posexplode(F.expr(f"slice(words, 1, size(words) - {COMMON_WORDS - 1})"))
        return staged(sets.select(row, *more, "words", "user_id", rank.alias("place", "_word")).withColumn(
            "list_key", F.to_json(F.struct("user_id", "_word"))).drop("user_id", "_word"), purpose)

    left = listed(asked, "_row", ["message_id", "at"], "asked-lists")
    right = listed(dismissed, "text_key", ["at", "copies"], "dismissed-lists")
    met = staged(left.groupBy("list_key").agg(F.count(F.lit(1)).alias(LEFT_ROWS)).join(
        right.groupBy("list_key").agg(F.count(F.lit(1)).alias(RIGHT_ROWS)), "list_key"), "list-sizes")
    return left, right, met, "list_key"


def _count_overlaps(left, right):
    """Rows of ``left`` with the weight of right rows sharing enough words.

    Where the rows have a ``place``, the two sides met under the word there; words are
    in one order then, and a pair that shares an earlier word counts under that one.
    """
    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc

    from beckon.operators.blocks import list_column

    l_words, l_ends = list_column(pc.split_pattern(left["words"], " "))
    r_words, r_ends = list_column(pc.split_pattern(right["words"], " "))
    listed = left["place"].null_count == 0
    # number the words of both sides alike; only words on both sides can be shared
    coded = pa.chunked_array([l_words.cast(pa.string()), r_words.cast(pa.string())]
                             ).combine_chunks().dictionary_encode()
    codes = coded.indices.to_numpy(zero_copy_only=False)
    size = len(coded.dictionary)
    l_codes, r_codes = codes[:len(l_words)], codes[len(l_words):]
    both = np.zeros(size, bool)
    both[np.intersect1d(l_codes, r_codes)] = True
    number = np.cumsum(both) - 1
    sides = []
    for table, ends, own in ((left, l_ends, l_codes), (right, r_ends, r_codes)):
        kept = both[own]
        rows = np.repeat(np.arange(len(table)), np.diff(ends))
        before = np.zeros(len(own), bool)
        if listed:
            before = np.arange(len(own)) - ends[rows] < table["place"].to_numpy()[rows]
        sides.append((rows[kept], number[own[kept]], before[kept], len(table)))

    def common(only_before: bool):
        """Shared words by products of 0/1 matrices, a part of the words at a time."""
        shared = np.zeros((len(left), len(right)), np.float32)
        for start in range(0, int(both.sum()), WORDS_AT_ONCE):
            made = []
            for rows, own, before, n in sides:
                here = (own >= start) & (own < start + WORDS_AT_ONCE) & (before | (not only_before))
                matrix = np.zeros((n, WORDS_AT_ONCE), np.float32)
                matrix[rows[here], own[here] - start] = 1
                made.append(matrix)
            shared += made[0] @ made[1].T
        return shared

    shared = common(False)
    earlier = common(True) if listed else None
    alike = shared >= COMMON_WORDS
    if listed:
        alike &= earlier == 0
    if right["at"].null_count < len(right):  # only what was dismissed before; no time, nothing before
        asked = left["at"].fill_null(np.iinfo(np.int64).min).to_numpy()
        alike &= right["at"].to_numpy()[None, :] < asked[:, None]
    totals = alike @ right["copies"].to_numpy()
    keep = totals > 0
    return pa.table({"message_id": left["message_id"].filter(pa.array(keep)),
                     "similar_dismissals": pa.array(totals[keep])})


# --- all features of a message ---------------------------------------------

FEATURE_BLOCKS = {
    "sender": L.HISTORY_FEATURES[0:6],
    "topic": L.HISTORY_FEATURES[6:7],
    "user": L.HISTORY_FEATURES[7:11],
    "dismissals": L.HISTORY_FEATURES[11:12],
    "category": L.HISTORY_FEATURES[12:13],
    "business": L.HISTORY_FEATURES[13:17],
    "group": L.HISTORY_FEATURES[17:21],
}


BLOCK_KEYS = {
    "sender": ["user_id", "sender_key"], "user": ["user_id"],
    "category": ["user_id", "conversation_type"], "business": ["user_id", "business_id"],
    "group": ["user_id", "group_id"],
}


def keyed_features(tables: HistoryTables, blocks: list[str]) -> dict[str, DataFrame]:
    """The keyed feature tables of the blocks, as plans."""
    made = {
        "sender": lambda: sender_features(sender_stats(tables.reactions, tables.history)),
        "user": lambda: user_features(user_stats(tables.reactions, tables.daily)),
        "category": lambda: category_features(tables.reactions, tables.history),
        "business": lambda: business_features(tables.business_history),
        "group": lambda: group_features(tables.group_members),
    }
    return {name: make() for name, make in made.items() if name in blocks}


def stored_features(tables: HistoryTables, blocks: list[str]) -> dict[str, DataFrame]:
    """The same, stored at once: a stream reads them per trigger instead of the history."""
    return {name: staged(df, f"features-{name}")
            for name, df in keyed_features(tables, blocks).items()}


def join_features(df: DataFrame, features: dict[str, DataFrame],
                  hot: DataFrame | None = None) -> DataFrame:
    """Left join keyed feature tables onto rows that carry the keys.

    Works on a stream as well, since every right side is static.
    """
    out = df
    for name, right in features.items():
        if name == "sender":
            out = out.withColumn("sender_key", sender_key(F.col("sender_user_id")))
        out = lookup(out, right, BLOCK_KEYS[name], salt_by="message_id", hot=hot,
                     hot_on=["user_id"])
        if name == "sender":
            out = out.drop("sender_key")
    return out


def feature_columns(blocks: list[str]) -> list[Column]:
    """The columns of the blocks in model order, 0 where nothing was found."""
    return [_zero(name) for block in FEATURE_BLOCKS if block in blocks
            for name in FEATURE_BLOCKS[block]]


def history_features(messages: DataFrame, tables: HistoryTables,
                     blocks: list[str] | None = None,
                     topic: DataFrame | None = None,
                     split_hot_users: bool = True) -> DataFrame:
    """``message_id`` plus the history features of the chosen blocks.

    Only key columns travel through the joins, never the text.  Users with a
    very large share of the messages are found once and salted in every
    lookup, because each key starts with the user.  ``topic`` holds
    ``message_id, topic_similarity``; without it that feature is 0.
    """
    chosen = list(FEATURE_BLOCKS) if blocks is None else blocks
    keys = messages.select("message_id", "user_id", "sender_user_id", "group_id",
                           "business_id", "conversation_type")
    hot = hot_keys(keys, ["user_id"]) if split_hot_users else None
    out = join_features(keys, keyed_features(tables, chosen), hot)
    if "dismissals" in chosen:
        out = out.join(similar_dismissals(messages, tables.reactions, tables.history),
                       "message_id", "left")
    if "topic" in chosen:
        if topic is None:
            out = out.withColumn("topic_similarity", F.lit(0.0))
        else:
            out = out.join(topic, "message_id", "left")
    return out.select("message_id", *feature_columns(chosen))
