"""Reason text and confidence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from beckon.functions.match import UNICODE, case, filled, mapped, quoted, stripped

SNIPPET_LENGTH = 80


def one_line(text: str) -> str:
    """Text with a blank for each run of white space."""
    return stripped(f"regexp_replace({text}, {quoted(UNICODE + r'\s+')}, ' ')")


def snippet(text: str, line: str) -> str:
    """Text on one line, cut at the last blank within 80 characters; ``line`` holds ``one_line`` of it."""
    head = f"regexp_replace(substring({line}, 1, {SNIPPET_LENGTH}), ' [^ ]*$', '')"
    return case([(f"{text} = ''", "'(media message)'"),
                 (f"length({line}) <= {SNIPPET_LENGTH}", line)], f"concat({head}, '...')")


def sender_context(admin: str) -> str:
    """Where the message came from, as a clause that starts with a blank."""
    return case([
        ("conversation_type = 'business'", "' from business account'"),
        (f"conversation_type = 'group' AND {admin}", "' from group admin'"),
        ("conversation_type = 'group'", "' in group chat'"),
        (f"{filled('sender_user_id')} != ''", "concat(' from ', sender_user_id)"),
    ], "''")


def percent(rate: str) -> str:
    """Whole percent, ties to even."""
    return f"concat(string(int(bround({rate} * 100, 0))), '%')"


# --- fixed values: reason templates, in order of precedence ----------------
# name: (condition, opening, whether a snippet of the message follows)
# {type}, {forwarded} and {rate} stand for values of the row
NOTIFY = {
    "notify_time_urgent": ("has_specific_time AND {type} = 'urgent'",
                           "Time-critical message requiring immediate action", True),
    "notify_time": ("has_specific_time", "Time-sensitive update with deadline", True),
    "notify_mention": ("has_at_mention AND has_question",
                       "Direct mention requesting response", True),
    "notify_payment": ("{type} = 'payment'", "Payment notification requiring attention", True),
    "notify_urgent": ("{type} = 'urgent'", "High-priority urgent message", True),
    "notify_event": ("{type} = 'event'", "Event or schedule update needing action", True),
    "notify_business": ("{type} = 'business_update'", "Important business update", True),
    "notify_trusted": ("sender_trust_score > 0.7D",
                       "Message from trusted sender requiring attention", True),
    "notify_default": ("true", "High-priority {type} message", True),
}
MUTE = {
    "mute_scam_words": (
        "scam_keyword_count >= 2",
        "Scam/phishing pattern detected with suspicious verification request", False),
    "mute_chain": ("{forwarded} > 5",
                   "Chain content forwarded {forwarded} times — repetitive low-value message",
                   False),
    "mute_forwarded": ("{forwarded} > 0",
                       "Forwarded {forwarded} times with no personal context", True),
    "mute_scam": ("{type} = 'scam'",
                  "Potential scam or router-manipulation attempt blocked", False),
    "mute_spam": ("{type} = 'spam'", "Aggressive promotional spam filtered", True),
    "mute_promotion_dismissed": (
        "{type} = 'promotion' AND category_dismiss_rate > 0.5D",
        "Promotional message from sender user typically dismisses ({rate} dismiss rate)", False),
    "mute_promotion": ("{type} = 'promotion'",
                       "Promotional content filtered as low priority", True),
    "mute_low_trust": ("sender_trust_score < 0.2D",
                       "Low-trust sender with no positive interaction history", True),
    "mute_default": ("true", "Low-value content muted", True),
}
DIGEST = {
    "digest_calm": ("has_negation_of_urgency",
                    "Sender explicitly indicated non-urgent — safe for later review", True),
    "digest_greeting": ("has_greeting", "Casual greeting with no action required", True),
    "digest_business": ("{type} = 'business_update'",
                        "Non-urgent business update for later review", True),
    "digest_event": ("{type} = 'event'", "Event information without immediate deadline", True),
    "digest_forward": ("{type} = 'forward'", "Forwarded content useful for later", True),
    "digest_trusted": ("{type} = 'personal' AND sender_trust_score > 0.7D",
                       "Trusted sender update — useful but no action needed now", True),
    "digest_personal": ("{type} = 'personal'",
                        "Personal message with no urgent action required", True),
    "digest_promotion": (
        "{type} = 'promotion'",
        "Promotional content from opted-in source — review when convenient", True),
    "digest_default": ("true", "Non-urgent update for later review", True),
}
TEMPLATES = {"notify": NOTIFY, "mute": MUTE, "digest": DIGEST}


def with_reason(df: DataFrame, action_col: str = "action", type_col: str = "message_type",
                confidence_col: str = "confidence", out_col: str = "reason") -> DataFrame:
    """Add the reason text and ``reason_template``, the name of its template.

    Uses text features, ``sender_trust_score``, ``category_dismiss_rate`` and
    ``is_group_admin`` of the same row.
    """
    forwarded = "coalesce(forwarded_count, 0)"
    values = {"type": type_col, "forwarded": f"string({forwarded})",
              "rate": percent("category_dismiss_rate")}

    def opening(words: str) -> str:
        text = quoted(words)
        for name, value in values.items():
            text = text.replace("{%s}" % name, f"', {value}, '")
        return f"concat({text})"

    def choose(templates: dict) -> str:
        return case([(condition.format(type=type_col, forwarded=forwarded), quoted(name))
                     for name, (condition, _, _) in templates.items()])

    template = case([(f"{action_col} = {quoted(action)}", choose(templates))
                     for action, templates in TEMPLATES.items()], "'other'")
    texts = {name: f"concat({opening(words)}, _sender" + (", ': ', _snippet)" if cited else ")")
             for templates in TEMPLATES.values()
             for name, (_, words, cited) in templates.items()}
    texts["other"] = (f"concat('Classified as ', {type_col}, ' with ', "
                      f"format_string('%.2f', bround({confidence_col}, 2)), ' confidence')")
    admin = "is_group_admin > 0" if "is_group_admin" in df.columns else "false"
    return df.withColumn("_line", F.expr(one_line(filled("message_text")))).withColumns({
        "_snippet": F.expr(snippet(filled("message_text"), "_line")),
        "_sender": F.expr(sender_context(admin)),
        "reason_template": F.expr(template),
    }).withColumn(out_col, F.expr(mapped("reason_template", texts))).drop("_line", "_snippet", "_sender")


def smoothed_confidence(probability: Column) -> Column:
    """Average of the probability and its larger side, kept within 0.05 to 0.95."""
    blended = 0.5 * probability + 0.5 * F.greatest(probability, 1.0 - probability)
    return F.least(F.greatest(blended, F.lit(0.05)), F.lit(0.95))


def rounded_confidence(confidence: Column) -> Column:
    """Four digits, ties to even."""
    return F.bround(confidence, 4)
