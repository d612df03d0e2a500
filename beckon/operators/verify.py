"""Checks after a decision: reason against type, safety, output domains."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from beckon import lexicons as L
from beckon.functions.match import any_of, case, filled, quoted, quoted_list

# templates that themselves speak of scam, spam, forwards, promotions, payments
TEMPLATE_SIGNAL = {
    "scam": ["guard", "mute_scam_words", "mute_scam"],
    "spam": ["mute_spam"],
    "forward": ["mute_chain", "mute_forwarded", "digest_forward"],
    "promotion": ["mute_promotion_dismissed", "mute_promotion", "digest_promotion"],
    "payment": ["notify_payment"],
}
# --- fixed values: types that a signal leaves alone ------------------------
KEPT_TYPES = {
    "scam": ["scam", "spam"],
    "spam": ["spam", "promotion", "scam"],
    "forward": ["scam", "spam", "forward", "greeting", "promotion", "payment"],
    "promotion": ["promotion", "spam", "scam"],
    "payment": ["payment", "scam", "spam", "promotion", "urgent", "event", "business_update"],
}
# --- fixed values: review limit, text of the fallback ----------------------
REVIEW_BELOW = 0.60
FALLBACK_REASON = "Fallback: Output validation failed after 3 retries."


def with_verification(df: DataFrame, signal: str = "reason") -> DataFrame:
    """Correct type and action; add ``corrections`` and ``trace``.

    ``signal='reason'`` searches the reason text, quoted words of the message
    included.  ``signal='template'`` looks at the template only, so that the
    words of a message cannot flip its own type.
    """
    if signal == "reason":
        words = {"scam": L.VERIFY_SCAM, "spam": L.VERIFY_SPAM, "forward": L.VERIFY_FORWARD,
                 "promotion": L.VERIFY_PROMOTION, "payment": [L.VERIFY_PAYMENT]}
        found = {kind: any_of("_reason_low", phrases) for kind, phrases in words.items()}
    elif signal == "template":
        found = {kind: f"reason_template IN {quoted_list(names)}"
                 for kind, names in TEMPLATE_SIGNAL.items()}
    else:
        raise ValueError("signal must be 'reason' or 'template'")

    # only the first signal found may change the type
    fix = case([(test, f"if(message_type NOT IN {quoted_list(KEPT_TYPES[kind])}, "
                       f"{quoted(kind)}, NULL)") for kind, test in found.items()])
    unsafe = "coalesce(_type_fix, message_type) IN ('scam', 'spam') AND action != 'mute'"
    # fixed values: layout of corrections and of the trace line
    corrections = (
        "array_compact(array("
        "concat('type:', message_type, '->', _type_fix, '(reason_match)'), "
        f"if({unsafe}, concat('action:', action, '->mute(scam_type_safety)'), NULL)))")
    trace = (
        "concat(message_id, ' | action=', action, ' | type=', message_type, "
        "' | conf=', format_string('%.3f', bround(confidence, 3)), "
        "' | evidence=', if(evidence_message_ids != 'none', 'yes', 'no'), "
        "if(size(corrections) > 0, concat(' | fixes=', concat_ws(',', corrections)), ''))")
    return (df.withColumn("_reason_low", F.expr(f"lower({filled('reason')})"))
            .withColumn("_type_fix", F.expr(fix))
            .withColumn("corrections", F.expr(corrections))
            .withColumns({"action": F.expr(f"if({unsafe}, 'mute', action)"),
                          "message_type": F.expr("coalesce(_type_fix, message_type)")})
            .withColumn("trace", F.expr(trace)).drop("_reason_low", "_type_fix"))


def trace_summary(verified: DataFrame) -> DataFrame:
    """Messages processed and messages corrected."""
    return verified.agg(
        F.count(F.lit(1)).alias("processed"),
        F.count_if(F.size("corrections") > 0).alias("corrected"))


def corrected_messages(verified: DataFrame) -> DataFrame:
    """The messages that the verifier corrected, with corrections and trace line."""
    return verified.where(F.size("corrections") > 0).select("message_id", "corrections", "trace")


def with_review_flag(df: DataFrame) -> DataFrame:
    """Add ``needs_review``; review leaves the decision itself unchanged."""
    return df.withColumn("needs_review", F.col("confidence") < REVIEW_BELOW)


def with_validation(df: DataFrame) -> DataFrame:
    """Replace rows that break the output contract by the fallback; add ``is_valid``."""
    valid = (f"coalesce(action IN {quoted_list(L.ACTIONS)} "
             f"AND message_type IN {quoted_list(L.MESSAGE_TYPES)} "
             "AND message_id IS NOT NULL AND reason IS NOT NULL "
             "AND evidence_message_ids IS NOT NULL "
             "AND confidence BETWEEN 0 AND 1 AND NOT isnan(confidence), false)")
    fallback = {
        "message_id": "coalesce(message_id, 'unknown')",
        "action": "if(is_valid, action, 'mute')",
        "message_type": "if(is_valid, message_type, 'unknown')",
        "reason": f"if(is_valid, reason, {quoted(FALLBACK_REASON)})",
        "confidence": "if(is_valid, confidence, 0.0D)",
        "evidence_message_ids": "if(is_valid, evidence_message_ids, 'none')",
    }
    return df.withColumn("is_valid", F.expr(valid)).withColumns(
        {name: F.expr(text) for name, text in fallback.items()})
