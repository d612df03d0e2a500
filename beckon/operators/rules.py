"""Guardrail and the ordered rule cascade.

Both are pure column expressions: one CASE picks the first rule that holds,
small CASEs map the rule to its action, type, reason and confidence.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from beckon import lexicons as L
from beckon.functions.match import (
    PhraseSet, any_of, bounded, case, distinct_words, either, filled, has_word, mapped, matches, quoted,
    stripped,
)
from beckon.session import where_computed

# --- fixed values: reason and confidence of the guard ----------------------
GUARD_REASON = ("Blocked by security guardrail: prompt injection or "
                "router-manipulation attempt detected.")
GUARD_CONFIDENCE = 0.99
GUARD = PhraseSet("_guard_seen", L.GUARD_PHRASES)
# literals without which a pattern of the list cannot match, in the order of the list
TIME_NEEDS = [["min"], [":"], ["before"], ["before"], ["min", "hour", "hr"], ["by"], ["after"], ["by"],
              ["moved", "shifted", "changed"], ["pick"]]
INJECTION_NEEDS = ["previous", "routing", "sender", "mark", "classify", "route", "action", "routing",
                   "classification", "override", "metadata", "notification", "assistant", "router", "actual",
                   "always"]
SEEN = PhraseSet("_rule_seen", L.RULE_CALM, L.RULE_URGENT_PARTS, L.RULE_TIME_CONTEXT,
                 L.RULE_TRANSACTIONAL, L.RULE_CHAIN, L.RULE_SELLER, L.RULE_LOGISTICS, *TIME_NEEDS,
                 INJECTION_NEEDS, L.RULE_SCAM_WORDS, L.RULE_SCAM_PHRASES)


def with_guard(df: DataFrame, text_col: str = "message_text", seen: PhraseSet = GUARD) -> DataFrame:
    """Add ``is_safe``: false when the text tries to steer the router.

    Where ``df`` has the column of ``seen``, a set that holds the guard's phrases, the text is not searched again.
    """
    if seen.column in df.columns:
        return df.withColumn("is_safe", F.expr(f"NOT {seen.any_of(L.GUARD_PHRASES)}"))
    found = GUARD.found(f"lower({filled(text_col)})")
    return df.withColumn("is_safe", F.expr(f"size({found}) = 0"))


# --- business risk ---------------------------------------------------------

def business_risk(accounts: DataFrame) -> DataFrame:
    """One row per account: ``business_id, high_risk_business``.

    Of an account that occurs several times the greatest row counts, so a message
    meets one row at most.
    """
    official = f"lower({stripped(filled('official_domain'))})"
    used = f"lower({stripped(filled('domain_used_by_sender'))})"
    risky = (f"coalesce(user_reports_30d, 0) >= 15 OR (coalesce(verified, 0) = 0 "
             f"AND {official} != '' AND {used} != '' AND {official} != {used} "
             f"AND coalesce(account_age_days, 0) < 90)")
    fields = F.struct("account_age_days", "user_reports_30d", "verified", "official_domain",
                      "domain_used_by_sender")
    one = accounts.where("business_id IS NOT NULL").groupBy("business_id").agg(F.max(fields).alias("_a"))
    return one.select("business_id", "_a.*").select(
        "business_id", F.expr(risky).alias("high_risk_business"))


def with_business_risk(messages: DataFrame, accounts: DataFrame) -> DataFrame:
    """Left lookup of the account risk; unknown accounts are not risky.

    Messages without a business, most of them, would all meet on the NULL key: they
    get a key of their own instead, which no account has and which spreads them.
    """
    risk = business_risk(accounts).select(
        F.col("business_id").alias("_id"), F.lit(0).cast("long").alias("_none"), "high_risk_business")
    keyed = messages.withColumns({
        "_id": F.coalesce("business_id", F.lit("")),
        "_none": F.when(F.col("business_id").isNull(), F.pmod(
            F.xxhash64("message_id"), F.lit(1 << 32)) + 1).otherwise(F.lit(0)).cast("long")})
    return keyed.join(risk, ["_id", "_none"], "left").drop("_id", "_none").withColumn(
        "high_risk_business", F.coalesce("high_risk_business", F.lit(False)))


# --- predicates, as SQL texts over a lower-cased text ----------------------

def _has(low: str, phrases: list[str], seen: PhraseSet | None) -> str:
    """One of the phrases occurs, by a search or by what a ``PhraseSet`` has found."""
    return any_of(low, phrases) if seen is None else seen.any_of(phrases)


def has_time_reference(low: str, seen: PhraseSet | None = None) -> str:
    """A clock time, a number of minutes, 'by 3' and the like."""
    tests = [matches(low, pattern, needs=_has(low, need, seen))
             for pattern, need in zip(L.RULE_TIME_PATTERNS, TIME_NEEDS, strict=True)]
    return f"({' OR '.join(tests)})"


def scam_word_hits(low: str, seen: PhraseSet | None = None) -> str:
    """Number of different listed words and phrases present."""
    phrases = " + ".join(f"int({matches(low, bounded([p]), needs=_has(low, [p], seen))})" for p in L.RULE_SCAM_PHRASES)
    words = f"if({_has(low, L.RULE_SCAM_WORDS, seen)}, {distinct_words(low, L.RULE_SCAM_WORDS)}, 0)"
    return f"({words} + {phrases})"


def is_scam(low: str, conversation: str, word_hits: str) -> str:
    """Enough different scam words, or fewer with a link or pressure."""
    return (f"({word_hits} >= 3 OR ({word_hits} >= 2 AND ("
            f"{has_word(low, L.RULE_SCAM_PRESSURE)} OR {matches(low, L.RULE_SCAM_LINK)} OR "
            f"({conversation} = 'personal' AND {has_word(low, L.RULE_SCAM_VERIFY)}))))")


def is_spam(raw: str, caps_text: str) -> str:
    """Aggressive marketing phrases, or mostly capital letters."""
    upper = f"upper({raw})"
    letters = f"length(regexp_replace({caps_text}, {quoted('[^\\p{L}]')}, ''))"
    capitals = f"length(regexp_replace({caps_text}, {quoted('[^\\p{Lu}]+')}, ''))"
    return (f"({any_of(upper, L.RULE_SPAM_PHRASES)} "
            f"OR {matches(upper, L.RULE_SPAM_PERCENT, needs=['%'])} "
            f"OR (length({caps_text}) > 20 AND {capitals} > 0.4D * {letters}))")


# --- fixed values: rule -> action, type, confidence, reason ----------------
RULE_OUTPUT = {
    "R0": ("mute", "scam", 0.92,
           "High-risk business account: unverified/lookalike domain with high user "
           "reports - likely phishing"),
    "R1a": ("mute", "forward", None, "likely spam chain content"),
    "R1b": ("mute", "forward", None, "likely low-value chain content"),
    "R1c": ("mute", "forward", 0.79,
            "Single-forwarded chain/greeting content - low value"),
    "R2": ("notify", "personal", 0.86,
           "Direct mention with question requiring response"),
    "R3": ("notify", "urgent", 0.87,
           "Time-sensitive message with specific deadline or constraint"),
    "R4": ("mute", "scam", 0.87,
           "Detected instruction injection attempt trying to manipulate the "
           "routing system"),
    "R5": ("mute", "scam", 0.85,
           "Detected scam/phishing pattern with suspicious verification or OTP request"),
    "R6": ("mute", "spam", 0.81,
           "Promotional spam with aggressive marketing language"),
    "R7": ("digest", "personal", 0.82,
           "Sender explicitly indicated non-urgent message for later review"),
    "R8": ("notify", "event", 0.87,
           "Time-sensitive logistics or transport update requiring immediate attention"),
}


def forward_confidence(count: str) -> str:
    """Confidence grows in steps with the number of forwards."""
    return case([(f"{count} >= 10", "0.85D"), (f"{count} >= 5", "0.83D")], "0.81D")


def with_rules(df: DataFrame, caps_on_raw_text: bool = True, seen: PhraseSet = SEEN) -> DataFrame:
    """Add ``rule_id, rule_action, rule_type, rule_confidence, rule_reason``.

    Needs ``high_risk_business`` (see ``with_business_risk``).  All five are
    NULL when no rule holds.  ``caps_on_raw_text=False`` tests capitals on the
    lower-cased text, so that the test never holds.  Where ``df`` has the column of
    ``seen``, a set that holds all phrases of ``SEEN``, the text is not searched again.
    """
    low, raw, group = "_rule_low", "_rule_raw", "conversation_type"
    forwarded = "coalesce(forwarded_count, 0)"
    deal = f"({group} <=> 'business' AND {seen.any_of(L.RULE_TRANSACTIONAL)})"
    logistics = (f"_timed AND NOT {seen.any_of(L.RULE_SELLER)} "
                 f"AND {seen.any_of(L.RULE_LOGISTICS)}")
    urgent = (f"NOT _calm AND _timed AND ({seen.any_of(L.RULE_URGENT_PARTS)} OR "
              f"({group} <=> 'group' AND {seen.any_of(L.RULE_TIME_CONTEXT)}))")
    rule = case([
        (f"{group} = 'business' AND high_risk_business", "'R0'"),
        (f"{forwarded} >= 5 AND NOT _urgent", "'R1a'"),
        (f"{forwarded} >= 2 AND NOT {deal} AND NOT _urgent", "'R1b'"),
        (f"{forwarded} = 1 AND {seen.any_of(L.RULE_CHAIN)}", "'R1c'"),
        (f"contains({low}, '?') AND {matches(low, L.USER_MENTION, needs=['@u_'])}", "'R2'"),
        ("_urgent", "'R3'"),
        (matches(low, either(L.RULE_INJECTION_PATTERNS), needs=seen.any_of(INJECTION_NEEDS)), "'R4'"),
        (is_scam(low, group, scam_word_hits(low, seen)), "'R5'"),
        (is_spam(raw, raw if caps_on_raw_text else low), "'R6'"),
        ("_calm", "'R7'"),
        (f"{group} = 'group' AND {logistics}", "'R8'"),
    ])

    def output(position: int) -> str:
        return mapped("rule_id", {
            rule_id: quoted(row[position]) if isinstance(row[position], str)
            else f"{row[position]}D"
            for rule_id, row in RULE_OUTPUT.items() if row[position] is not None})

    forward_rule = "rule_id IN ('R1a', 'R1b')"
    searched = df.withColumns({
        raw: F.expr(filled("message_text")), low: F.expr(f"lower({filled('message_text')})")})
    own = [] if seen.column in df.columns else [seen.column]
    if own:
        searched = searched.withColumn(seen.column, F.expr(seen.found(low)))
    return searched.withColumns({
        "_calm": F.expr(seen.any_of(L.RULE_CALM)), "_timed": F.expr(has_time_reference(low, seen)),
    }).withColumn("_urgent", F.expr(urgent)).withColumn("rule_id", F.expr(rule)).withColumns({
        "rule_action": F.expr(output(0)),
        "rule_type": F.expr(output(1)),
        "rule_confidence": F.expr(
            f"if({forward_rule}, {forward_confidence(forwarded)}, {output(2)})"),
        "rule_reason": F.expr(
            f"if({forward_rule}, concat('Message forwarded ', string({forwarded}), ' times - ', "
            f"{output(3)}), {output(3)})"),
    }).drop(raw, low, *own, "_calm", "_timed", "_urgent")


def rule_matches(messages: DataFrame, accounts: DataFrame) -> DataFrame:
    """Only the messages that some rule decides, in the output layout."""
    ruled = with_rules(with_business_risk(messages, accounts))
    return where_computed(ruled, "rule_id IS NOT NULL").select(
        "message_id", F.col("rule_action").alias("action"),
        F.col("rule_type").alias("message_type"), F.col("rule_reason").alias("reason"),
        F.col("rule_confidence").alias("confidence"),
        F.lit("none").alias("evidence_message_ids"), "rule_id")


def rule_coverage(messages: DataFrame, accounts: DataFrame) -> DataFrame:
    """Share of messages that some rule decides."""
    ruled = with_rules(with_business_risk(messages, accounts))
    return ruled.agg(
        F.count(F.lit(1)).alias("messages"),
        F.count("rule_id").alias("matched"),
        F.avg(F.col("rule_id").isNotNull().cast("double")).alias("coverage"))
