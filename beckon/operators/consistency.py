"""Identical messages get identical decisions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from beckon.functions.match import filled, stripped
from beckon.operators.joins import hot_keys, lookup
from beckon.session import staged

DECISION = ["action", "message_type", "confidence", "reason", "evidence_message_ids"]


def identity_key() -> Column:
    """Digest of user, sender, conversation, media, forwards and normalised text.

    A digest keeps whole texts out of the shuffle.
    """
    parts = ", ".join(f"coalesce(string({c}), 'nan')" for c in [
        "user_id", "sender_user_id", "conversation_type", "media_type", "forwarded_count"])
    text = stripped(f"lower({filled('message_text')})")
    return F.expr(f"sha2(concat_ws('|', {parts}, {text}), 256)")


def best_decisions(keyed: DataFrame) -> DataFrame:
    """Per ``_key`` the number of rows, the best decision and what orders it.

    The most confident row is best, of equal ones the earliest (``created_at``, then
    ``message_id``).  Results over parts of the rows merge by ``merged_best``.
    """
    order = F.struct((-F.col("confidence")).alias("less"), "created_at", "message_id")
    return keyed.groupBy("_key").agg(F.count(F.lit(1)).alias("_rows"),
                                     F.min_by(F.struct(*DECISION), order).alias("_best"), F.min(order).alias("_order"))


def merged_best(parts: DataFrame) -> DataFrame:
    """The same from the rows of ``best_decisions`` over several parts."""
    return parts.groupBy("_key").agg(F.sum("_rows").alias("_rows"), F.min_by("_best", "_order").alias("_best"),
                                     F.min("_order").alias("_order"))


def with_best(keyed: DataFrame, best: DataFrame) -> DataFrame:
    """Stored rows with the best decision of their ``_key``; very frequent keys are salted."""
    several = best.where(F.col("_rows") > 1).select("_key", "_best")
    joined = lookup(keyed, several, ["_key"], "message_id", hot_keys(keyed, ["_key"]))
    return joined.withColumns({
        c: F.expr(f"if(_best IS NULL, {c}, _best.{c})") for c in DECISION}).drop("_key", "_best")


def enforce_consistency(decided: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """Within equal messages copy the decision of the most confident row.

    Runs jobs at once: decisions and keys are stored.

    Ties go to the earliest row (``created_at``, then ``message_id``).  The
    decisions are written once, without texts, as they are read twice.  The
    best row is found by partial aggregation, not by sorting the group, and is
    joined back only for keys with several rows; very frequent keys are salted,
    so a group of copies of any size is spread over tasks.  The
    result holds ``message_id``, ``created_at``, the decision and the columns ``keep``.
    An identity key may come along as ``_key``.
    """
    narrow = ["message_id", "created_at", *DECISION, *keep, "_key"]
    keyed = decided if "_key" in decided.columns else decided.withColumn("_key", identity_key())
    keyed = staged(keyed.select(*narrow), "decisions")
    return with_best(keyed, best_decisions(keyed))
