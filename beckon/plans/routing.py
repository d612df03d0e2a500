"""The whole router as one plan: guard, rules, model, type, reason, evidence, checks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from beckon.functions import text as tx
from beckon.functions.match import PhraseSet, filled
from beckon.functions.text import with_text_features
from beckon.operators import evidence as ev
from beckon.operators import history as hist
from beckon.operators import reasons, rules, types, verify
from beckon.operators.consistency import enforce_consistency
from beckon.session import staged

TEXT_NEEDED = ["has_at_mention", "has_question", "at_mention_with_question",
               "has_specific_time", "has_negation_of_urgency", "has_greeting",
               "scam_keyword_count"]
HISTORY_NEEDED = ["sender", "category", "group"]
# used where a message has neither a rule nor a model score
DEFAULT_ACTION = "digest"
DEFAULT_PROBABILITY = 0.5
# the phrases of all operators, so that a text is searched once for them
PHRASES = PhraseSet("_phrases", tx.SEEN.phrases, rules.GUARD.phrases, rules.SEEN.phrases, types.SEEN.phrases)


def with_phrases(messages: DataFrame) -> DataFrame:
    """Add the phrases found in the text, unless they are there."""
    if PHRASES.column in messages.columns:
        return messages
    return messages.withColumn("_low", F.expr(f"lower({filled('message_text')})")).withColumn(
        PHRASES.column, F.expr(PHRASES.found("_low"))).drop("_low")


def with_signals(messages: DataFrame, accounts: DataFrame) -> DataFrame:
    """Row-local signals: phrases, guard flag, rule outcome and the text features in use."""
    searched = with_phrases(messages)
    return rules.with_rules(rules.with_business_risk(rules.with_guard(
        with_text_features(searched, features=TEXT_NEEDED, seen=PHRASES), seen=PHRASES), accounts), seen=PHRASES)


def with_decision(df: DataFrame) -> DataFrame:
    """Action, confidence, type and reason.

    A rule goes before the model; ``model_action`` and ``model_probability``
    may be NULL.  Needs ``with_signals`` and the history features in use.
    """
    chosen = df.withColumns({
        "action": F.coalesce("rule_action", "model_action", F.lit(DEFAULT_ACTION)),
        "confidence": F.coalesce("rule_confidence", reasons.smoothed_confidence(
            F.coalesce("model_probability", F.lit(DEFAULT_PROBABILITY)))),
    })
    typed = types.with_rule_type_kept(types.with_message_type(chosen, "action", seen=PHRASES))
    return reasons.with_reason(typed.drop(PHRASES.column))


def with_guard_override(df: DataFrame) -> DataFrame:
    """Unsafe messages get the fixed guard decision and no evidence."""
    fixed = {
        "action": F.lit("mute"), "message_type": F.lit("scam"),
        "reason": F.lit(rules.GUARD_REASON), "confidence": F.lit(rules.GUARD_CONFIDENCE),
        "evidence_message_ids": F.lit("none"), "reason_template": F.lit("guard"),
        "needs_review": F.lit(False),
    }
    return df.withColumns({
        name: F.when(F.col("is_safe"), F.col(name)).otherwise(value)
        for name, value in fixed.items()})


def decide(messages: DataFrame, accounts: DataFrame, tables: hist.HistoryTables,
           scored: DataFrame | None = None, features: DataFrame | None = None) -> DataFrame:
    """Decisions before evidence and checks, one row per message.

    Joins on ``message_id`` follow each other, so the wide rows move once.  ``features``
    takes the place of the history features in use, such as those as of a time.
    """
    signals = with_signals(messages, accounts)
    if scored is None:
        signals = signals.withColumns({
            "model_action": F.lit(None).cast("string"),
            "model_probability": F.lit(None).cast("double")})
    else:
        signals = signals.join(scored, "message_id", "left")
    if features is None:
        features = hist.history_features(messages, tables, HISTORY_NEEDED)
    return with_decision(signals.join(features, "message_id", "left"))


def finish(decided: DataFrame, signal: str = "reason") -> DataFrame:
    """Review flag, guard override, verifier, validation and rounding.

    ``decided`` carries ``evidence_message_ids``.
    """
    flagged = with_guard_override(verify.with_review_flag(decided))
    # the guard decision is consistent, so the verifier leaves it unchanged
    checked = verify.with_validation(verify.with_verification(flagged, signal))
    return checked.withColumn("confidence", reasons.rounded_confidence(F.col("confidence")))


def route(messages: DataFrame, accounts: DataFrame, tables: hist.HistoryTables,
          model: ev.TfIdf | None = None, scored: DataFrame | None = None,
          signal: str = "reason", consistent: bool = True) -> DataFrame:
    """Route messages: decision columns, one row per message.

    ``messages`` may be enriched (transcripts as text, image columns).  Evidence is
    looked up for safe messages only, and not at all without ``model``.  With
    ``consistent`` the result holds ``message_id``, ``created_at`` and the decision;
    else the message columns and all flags too.  Runs jobs at once.
    """
    if model is not None:
        # read by the decision and several times by the search, so enriched and searched once
        messages = staged(rules.with_guard(with_phrases(messages), seen=PHRASES), "arrived")
    decided = decide(messages, accounts, tables, scored)
    if model is None:
        decided = decided.withColumn("evidence_message_ids", F.lit("none"))
    else:
        safe = messages.where("is_safe")
        top = ev.top_evidence(safe, tables.history, model)
        lists = ev.evidence_lists(safe, top)
        decided = decided.join(lists, "message_id", "left").withColumn(
            "evidence_message_ids", F.coalesce("evidence_message_ids", F.lit("none")))
    routed = finish(decided, signal)
    return enforce_consistency(routed) if consistent else routed
