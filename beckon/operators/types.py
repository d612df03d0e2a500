"""Message type from text, conversation, image analysis and chosen action."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from beckon import lexicons as L
from beckon.functions.match import (
    PhraseSet, bounded, case, either, filled, matches, stripped,
)

SEEN = PhraseSet(
    "_type_seen", L.TYPE_SCAM, L.TYPE_SCAM_ALWAYS, L.TYPE_INJECTION, L.TYPE_MENTION_CASUAL,
    L.TYPE_CALM, L.TYPE_UNKNOWN_SENDER, L.TYPE_PAYMENT, L.TYPE_PAYMENT_ADVISORY,
    L.TYPE_GREETING, L.TYPE_PROMOTION_SAFETY, L.TYPE_PROMOTION_WORDS, L.TYPE_PROMOTION_PERCENT,
    L.TYPE_EVENT, L.TYPE_EVENT_NOT_BUSINESS, L.TYPE_URGENT_CASUAL, L.TYPE_URGENT,
    L.TYPE_BUSINESS_UPDATE, L.TYPE_SPAM, ["?", "@u_"])


def with_message_type(df: DataFrame, action_col: str, out_col: str = "message_type",
                      seen: PhraseSet = SEEN) -> DataFrame:
    """Add the inferred type for the action in a column."""
    return with_message_types(df, {out_col: action_col}, seen)


def with_message_types(df: DataFrame, actions: dict[str, str], seen: PhraseSet = SEEN) -> DataFrame:
    """Add one type column per entry of ``actions`` (column name: action as SQL text).

    Needs the text features ``at_mention_with_question`` and
    ``has_specific_time``.  Image columns are optional.  The text is scanned
    once for all entries; where ``df`` has the column of ``seen``, a set that holds all
    phrases of ``SEEN``, only the text of a picture is searched.
    """
    def image(name: str) -> str:
        return filled(name) if name in df.columns else "''"

    own, ocr = filled("message_text"), image("image_extracted_text")
    pictured = f"{stripped(own)} = '' AND lower({stripped(ocr)}) NOT IN ('', 'none')"
    text = f"if({pictured}, {ocr}, {own})"
    found = seen.found("_type_low")
    if seen.column in df.columns:
        found = f"if({pictured}, {found}, {seen.column})"
    staged = df.withColumn("_type_text", F.expr(text)).withColumns({
        "_type_low": F.expr("lower(_type_text)"),
        "_type_blank": F.expr(f"{stripped('_type_text')} = ''"),
    }).withColumn("_type_seen", F.expr(found))
    here = seen.at("_type_seen")
    return staged.withColumns({
        name: F.expr(_kind(action, image("image_category"), here)) for name, action in actions.items()
    }).drop("_type_text", "_type_low", "_type_blank", "_type_seen")


def _kind(action: str, category: str, seen: PhraseSet) -> str:
    """The ordered steps of the inference as a CASE."""
    low = "_type_low"
    conversation = f"lower({filled('conversation_type')})"
    # a percent sign is no word character: the entry needs one right after it
    percent = matches(low, r"\b" + either(L.TYPE_PROMOTION_PERCENT) + r"\b",
                      needs=seen.any_of(L.TYPE_PROMOTION_PERCENT))
    promoted = matches(low, bounded(L.TYPE_PROMOTION_WORDS),
                       needs=seen.any_of(L.TYPE_PROMOTION_WORDS))
    return case([
        ("_type_blank", case([(f"{action} = 'mute'", "'spam'"),
                              (f"{action} = 'notify'", "'urgent'")], "'unknown'")),
        (f"{category} = 'urgent' AND {action} = 'notify'", "'urgent'"),
        (f"{category} = 'promotional' AND {action} IN ('mute', 'digest')", "'promotion'"),
        (f"({seen.any_of(L.TYPE_SCAM)} AND {seen.hits(L.TYPE_SCAM)} >= 2) "
         f"OR {seen.any_of(L.TYPE_SCAM_ALWAYS)}", "'scam'"),
        (seen.any_of(L.TYPE_INJECTION), "'scam'"),
        (f"at_mention_with_question AND NOT {seen.any_of(L.TYPE_MENTION_CASUAL)}", "'urgent'"),
        (seen.any_of(L.TYPE_CALM), "'personal'"),
        (seen.any_of(L.TYPE_UNKNOWN_SENDER), "'unknown'"),
        (f"{seen.any_of(L.TYPE_PAYMENT)} AND NOT {seen.any_of(L.TYPE_PAYMENT_ADVISORY)} "
         f"AND NOT {seen.any_of(['?', '@u_'])}", "'payment'"),
        (seen.any_of(L.TYPE_GREETING), "'greeting'"),
        (f"NOT {seen.any_of(L.TYPE_PROMOTION_SAFETY)} "
         f"AND ({promoted} OR {percent})", "'promotion'"),
        (f"{seen.any_of(L.TYPE_EVENT)} OR ({conversation} != 'business' "
         f"AND {seen.any_of(L.TYPE_EVENT_NOT_BUSINESS)})", "'event'"),
        (f"{action} = 'notify' AND NOT {seen.any_of(L.TYPE_URGENT_CASUAL)} "
         f"AND (has_specific_time OR {seen.any_of(L.TYPE_URGENT)})", "'urgent'"),
        ("coalesce(forwarded_count, 0) > 0", "'forward'"),
        (f"{conversation} = 'business' AND {seen.any_of(L.TYPE_BUSINESS_UPDATE)}",
         "'business_update'"),
        (f"{action} = 'mute' AND {seen.any_of(L.TYPE_SPAM)}", "'spam'"),
        (f"{conversation} = 'personal'", "'personal'"),
        (f"{action} = 'digest' AND {conversation} = 'group'", "'personal'"),
        (f"{action} = 'notify'", "'personal'"),
    ], "'business_update'")


def with_rule_type_kept(df: DataFrame, type_col: str = "message_type") -> DataFrame:
    """A scam found by a rule stays a scam whatever the text suggests."""
    return df.withColumn(type_col, F.expr(
        f"if(rule_type <=> 'scam', 'scam', {type_col})"))
