"""Rules, types, reasons and checks in DuckDB SQL."""

from __future__ import annotations

from beckon import lexicons as L
from oracles.words import (
    W, between, has, items, n_has, rx, s, strip, text_features, tokens, word_in,
)

TIME = "|".join(f"(?:{p})" for p in L.RULE_TIME_PATTERNS).replace(r"\w", W)
SCAM_HITS = (f"(len(list_intersect({tokens('low')}, [{items(L.RULE_SCAM_WORDS)}])) + "
             + " + ".join(f"{rx('low', between(p))}::INT" for p in L.RULE_SCAM_PHRASES) + ")")
LINK = rf"http|www\.|\.{W}{{2,3}}(?:/|\n?$)"
SPAM = (f"({has('up', L.RULE_SPAM_PHRASES)} OR regexp_matches(up, '\\d+%\\s*OFF') OR "
        r"(length(t) > 20 AND length(regexp_replace(t, '[^\p{Lu}]', '', 'g')) > 0 AND "
        r"length(regexp_replace(t, '[^\p{Lu}]', '', 'g'))::DOUBLE "
        r"/ length(regexp_replace(t, '[^\p{L}]', '', 'g')) > 0.4))")
SCAM = (f"(hits >= 3 OR (hits >= 2 AND ({word_in('low', L.RULE_SCAM_PRESSURE)} "
        f"OR regexp_matches(low, {s(LINK)}) OR (conversation_type = 'personal' "
        f"AND {word_in('low', L.RULE_SCAM_VERIFY)}))))")

SIGNALS = f"""
  SELECT *, {SCAM} AS scam, {SPAM} AS spam,
    timed AND NOT calm AND ({has('low', L.RULE_URGENT_PARTS)} OR (conversation_type = 'group'
      AND {has('low', L.RULE_TIME_CONTEXT)})) AS urgent
  FROM (SELECT *, {SCAM_HITS} AS hits, {has('low', L.RULE_CALM)} AS calm,
      regexp_matches(low, {s(TIME)}) AS timed
    FROM (SELECT *, lower(t) AS low, upper(t) AS up
      FROM (SELECT *, coalesce(message_text, '') AS t FROM messages)))"""

RULES = f"""
  SELECT *, CASE
      WHEN rule_id IN ('R2', 'R3', 'R8') THEN 'notify' WHEN rule_id = 'R7' THEN 'digest'
      WHEN rule_id IS NOT NULL THEN 'mute' END AS rule_action,
    CASE WHEN rule_id IN ('R0', 'R4', 'R5') THEN 'scam' WHEN rule_id IN ('R1a', 'R1b', 'R1c')
      THEN 'forward' WHEN rule_id IN ('R2', 'R7') THEN 'personal' WHEN rule_id = 'R3'
      THEN 'urgent' WHEN rule_id = 'R6' THEN 'spam' WHEN rule_id = 'R8' THEN 'event' END
      AS rule_type,
    (CASE WHEN rule_id IN ('R1a', 'R1b') THEN CASE WHEN fc >= 10 THEN 0.85 WHEN fc >= 5 THEN 0.83
        ELSE 0.81 END
      ELSE map {{'R0': 0.92, 'R1c': 0.79, 'R2': 0.86, 'R3': 0.87, 'R4': 0.87, 'R5': 0.85,
        'R6': 0.81, 'R7': 0.82, 'R8': 0.87}}[rule_id] END)::DOUBLE AS rule_confidence
  FROM (SELECT m.*, forwarded_count AS fc, CASE
      WHEN conversation_type = 'business' AND coalesce(high_risk_business, false) THEN 'R0'
      WHEN forwarded_count >= 5 AND NOT urgent THEN 'R1a'
      WHEN forwarded_count >= 2 AND NOT urgent AND NOT (conversation_type = 'business'
        AND {has('low', L.RULE_TRANSACTIONAL)}) THEN 'R1b'
      WHEN forwarded_count = 1 AND {has('low', L.RULE_CHAIN)} THEN 'R1c'
      WHEN regexp_matches(low, '@u_\\d+') AND contains(low, '?') THEN 'R2'
      WHEN urgent THEN 'R3'
      WHEN {rx('low', '|'.join(L.RULE_INJECTION_PATTERNS))} THEN 'R4'
      WHEN scam THEN 'R5' WHEN spam THEN 'R6' WHEN calm THEN 'R7'
      WHEN conversation_type = 'group' AND timed AND {has('low', L.RULE_LOGISTICS)}
        AND NOT {has('low', L.RULE_SELLER)} THEN 'R8' END AS rule_id
    FROM signals m LEFT JOIN accounts a ON a.business_id = m.business_id)"""

# fixed values: reason texts of the rules
RULE_REASON = f"""CASE rule_id
  WHEN 'R0' THEN 'High-risk business account: unverified/lookalike domain with high user reports - likely phishing'
  WHEN 'R1a' THEN 'Message forwarded ' || fc || ' times - likely spam chain content'
  WHEN 'R1b' THEN 'Message forwarded ' || fc || ' times - likely low-value chain content'
  WHEN 'R1c' THEN 'Single-forwarded chain/greeting content - low value'
  WHEN 'R2' THEN 'Direct mention with question requiring response'
  WHEN 'R3' THEN 'Time-sensitive message with specific deadline or constraint'
  WHEN 'R4' THEN 'Detected instruction injection attempt trying to manipulate the routing system'
  WHEN 'R5' THEN 'Detected scam/phishing pattern with suspicious verification or OTP request'
  WHEN 'R6' THEN 'Promotional spam with aggressive marketing language'
  WHEN 'R7' THEN 'Sender explicitly indicated non-urgent message for later review'
  WHEN 'R8' THEN 'Time-sensitive logistics or transport update requiring immediate attention' END"""


def message_type(action: str) -> str:
    """CASE over ``tt`` (text in use), ``tl`` (lower), image and feature columns."""
    scam = f"({n_has('tl', L.TYPE_SCAM)} >= 2 OR {has('tl', L.TYPE_SCAM_ALWAYS)})"
    return f"""CASE
      WHEN {strip('tt')} = '' THEN CASE {action} WHEN 'mute' THEN 'spam'
        WHEN 'notify' THEN 'urgent' ELSE 'unknown' END
      WHEN image_category = 'urgent' AND {action} = 'notify' THEN 'urgent'
      WHEN image_category = 'promotional' AND {action} IN ('mute', 'digest') THEN 'promotion'
      WHEN {scam} THEN 'scam'
      WHEN {has('tl', L.TYPE_INJECTION)} THEN 'scam'
      WHEN at_mention_with_question AND NOT {has('tl', L.TYPE_MENTION_CASUAL)} THEN 'urgent'
      WHEN {has('tl', L.TYPE_CALM)} THEN 'personal'
      WHEN {has('tl', L.TYPE_UNKNOWN_SENDER)} THEN 'unknown'
      WHEN {has('tl', L.TYPE_PAYMENT)} AND NOT {has('tl', L.TYPE_PAYMENT_ADVISORY)}
        AND NOT contains(tl, '?') AND NOT contains(tl, '@u_') THEN 'payment'
      WHEN {has('tl', L.TYPE_GREETING)} THEN 'greeting'
      WHEN NOT {has('tl', L.TYPE_PROMOTION_SAFETY)} AND ({word_in('tl', L.TYPE_PROMOTION_WORDS)}
        OR regexp_matches(tl, '(?:^|[^\\p{{L}}\\p{{N}}_])(?:50%|40%){W}')) THEN 'promotion'
      WHEN {has('tl', L.TYPE_EVENT)} OR (conversation_type <> 'business'
        AND {has('tl', L.TYPE_EVENT_NOT_BUSINESS)}) THEN 'event'
      WHEN {action} = 'notify' AND NOT {has('tl', L.TYPE_URGENT_CASUAL)}
        AND (has_specific_time OR {has('tl', L.TYPE_URGENT)}) THEN 'urgent'
      WHEN forwarded_count > 0 THEN 'forward'
      WHEN conversation_type = 'business' AND {has('tl', L.TYPE_BUSINESS_UPDATE)}
        THEN 'business_update'
      WHEN {action} = 'mute' AND {has('tl', L.TYPE_SPAM)} THEN 'spam'
      WHEN conversation_type = 'personal' THEN 'personal'
      WHEN {action} = 'digest' AND conversation_type = 'group' THEN 'personal'
      WHEN {action} = 'notify' THEN 'personal' ELSE 'business_update' END"""


ENRICHED = f"""
  SELECT * REPLACE (CASE WHEN use_tail THEN tail ELSE message_text END AS message_text)
  FROM (SELECT *, coalesce(media_type, '') = 'voice' AND coalesce(tail, '') <> ''
      AND {strip("coalesce(message_text, '')")} = '' AS use_tail,
    CASE WHEN seen THEN ['low', 'medium', 'high'][k % 3 + 1] END AS image_urgency,
    CASE WHEN seen THEN ['promotional', 'informational', 'urgent', 'unknown'][k % 4 + 1] END
      AS image_category,
    CASE WHEN seen THEN CASE WHEN k % 5 = 0 THEN 'none' ELSE coalesce(tail, '') END END
      AS image_extracted_text,
    CASE WHEN seen THEN k % 2 = 0 END AS image_has_deadline
    FROM (SELECT *, coalesce(media_type, '') = 'image' AND k % 10 <> 9 AS seen FROM messages))"""

#: Tables of the router: incoming messages enriched, past ones as they were.
ON_ENRICHED = {
    "raw": "SELECT * REPLACE ('u_' || user_id AS user_id) FROM msg",
    "messages": f"""
      SELECT e.* EXCLUDE (message_text), CASE WHEN e.past THEN m.message_text
        ELSE e.message_text END AS message_text
      FROM ({ENRICHED.replace('FROM messages', 'FROM raw')}) e JOIN raw m USING (message_id)""",
}

TEXT_IN_USE = f"""CASE WHEN {strip("coalesce(message_text, '')")} = ''
  AND lower({strip("coalesce(image_extracted_text, '')")}) NOT IN ('', 'none')
  THEN image_extracted_text ELSE coalesce(message_text, '') END"""

# --- decisions -------------------------------------------------------------


def decided(source: str, scored: bool, enriched: bool = False) -> dict[str, str]:
    """CTEs up to ``decided`` for the rows of ``source`` (a table of messages).

    With ``enriched`` they carry the image columns, see ``ON_ENRICHED``.
    """
    probability = "coalesce(model_probability, 0.5)" if scored else "0.5::DOUBLE"
    join = "LEFT JOIN scored sc USING (message_id)" if scored else ""
    pick = "model_action, " if scored else ""
    feature = text_features(source, "message_id", "message_text")
    snippet = ("CASE WHEN t = '' THEN '(media message)' WHEN length(line) <= 80 THEN line ELSE "
               "regexp_replace(substring(line, 1, 80), ' [^ ]*$', '') || '...' END")
    return {
        "signals": SIGNALS, "ruled": RULES, "feat": feature,
        "chosen": f"""
          SELECT r.*, f.* EXCLUDE (message_id),
            NOT {has('low', L.GUARD_PHRASES)} AS is_safe,
            coalesce(rule_action, {pick}'digest') AS action,
            coalesce(rule_confidence, least(greatest({probability}, 0.5), 0.95))::DOUBLE
              AS confidence,
            coalesce(ss.replied / ss.message_count * 2.0 + ss.opened / ss.message_count
              - ss.dismissed / ss.message_count * 3.0 - ss.reported * 10.0, 0.0) AS trust,
            coalesce(c.category_dismiss_rate, 0.0) AS dismissed_rate,
            coalesce(g.is_group_admin, 0.0) AS admin,
            {"" if enriched else "NULL::VARCHAR AS image_category,"}
            {TEXT_IN_USE if enriched else "t"} AS tt, lower({TEXT_IN_USE if enriched else "t"}) AS tl,
            {strip("regexp_replace(t, '\\s+', ' ', 'g')")} AS line
          FROM ruled r JOIN feat f USING (message_id) {join}
          LEFT JOIN sender_stats ss ON ss.user_id = r.user_id
            AND ss.sender_key = coalesce(r.sender_user_id, 'business')
          LEFT JOIN category c ON c.user_id = r.user_id
            AND c.conversation_type = r.conversation_type
          LEFT JOIN members g ON g.user_id = r.user_id AND g.group_id = r.group_id""",
        "typed": f"""
          SELECT *, CASE WHEN rule_type = 'scam' THEN 'scam' ELSE {message_type('action')} END
              AS message_type, {snippet} AS snip,
            CASE conversation_type WHEN 'business' THEN ' from business account'
              WHEN 'group' THEN CASE WHEN admin > 0 THEN ' from group admin'
                ELSE ' in group chat' END
              ELSE coalesce(' from ' || sender_user_id, '') END AS who
          FROM chosen""",
        "decided": f"SELECT *, {REASON} AS reason FROM typed",
    }


# fixed values: reason texts by action and type
REASON = """CASE action
  WHEN 'notify' THEN CASE
    WHEN has_specific_time AND message_type = 'urgent'
      THEN 'Time-critical message requiring immediate action' || who || ': ' || snip
    WHEN has_specific_time THEN 'Time-sensitive update with deadline' || who || ': ' || snip
    WHEN at_mention_with_question THEN 'Direct mention requesting response' || who || ': ' || snip
    WHEN message_type = 'payment'
      THEN 'Payment notification requiring attention' || who || ': ' || snip
    WHEN message_type = 'urgent' THEN 'High-priority urgent message' || who || ': ' || snip
    WHEN message_type = 'event'
      THEN 'Event or schedule update needing action' || who || ': ' || snip
    WHEN message_type = 'business_update'
      THEN 'Important business update' || who || ': ' || snip
    WHEN trust > 0.7
      THEN 'Message from trusted sender requiring attention' || who || ': ' || snip
    ELSE 'High-priority ' || message_type || ' message' || who || ': ' || snip END
  WHEN 'mute' THEN CASE
    WHEN scam_keyword_count >= 2
      THEN 'Scam/phishing pattern detected with suspicious verification request' || who
    WHEN fc > 5 THEN 'Chain content forwarded ' || fc
      || ' times — repetitive low-value message' || who
    WHEN fc > 0 THEN 'Forwarded ' || fc || ' times with no personal context' || who || ': ' || snip
    WHEN message_type = 'scam'
      THEN 'Potential scam or router-manipulation attempt blocked' || who
    WHEN message_type = 'spam' THEN 'Aggressive promotional spam filtered' || who || ': ' || snip
    WHEN message_type = 'promotion' AND dismissed_rate > 0.5
      THEN 'Promotional message from sender user typically dismisses ('
        || round_even(dismissed_rate * 100, 0)::INT || '% dismiss rate)' || who
    WHEN message_type = 'promotion'
      THEN 'Promotional content filtered as low priority' || who || ': ' || snip
    WHEN trust < 0.2
      THEN 'Low-trust sender with no positive interaction history' || who || ': ' || snip
    ELSE 'Low-value content muted' || who || ': ' || snip END
  ELSE CASE
    WHEN has_negation_of_urgency
      THEN 'Sender explicitly indicated non-urgent — safe for later review' || who || ': ' || snip
    WHEN has_greeting THEN 'Casual greeting with no action required' || who || ': ' || snip
    WHEN message_type = 'business_update'
      THEN 'Non-urgent business update for later review' || who || ': ' || snip
    WHEN message_type = 'event'
      THEN 'Event information without immediate deadline' || who || ': ' || snip
    WHEN message_type = 'forward' THEN 'Forwarded content useful for later' || who || ': ' || snip
    WHEN message_type = 'personal' AND trust > 0.7
      THEN 'Trusted sender update — useful but no action needed now' || who || ': ' || snip
    WHEN message_type = 'personal'
      THEN 'Personal message with no urgent action required' || who || ': ' || snip
    WHEN message_type = 'promotion'
      THEN 'Promotional content from opted-in source — review when convenient' || who
        || ': ' || snip
    ELSE 'Non-urgent update for later review' || who || ': ' || snip END END"""


def checked(evidence: str | None) -> dict[str, str]:
    """CTEs from ``decided`` to ``checked``; ``evidence`` names a table of id lists."""
    ids = "coalesce(e.evidence_message_ids, 'none')" if evidence else "'none'"
    join = f"LEFT JOIN {evidence} e USING (message_id)" if evidence else ""
    guard = ("Blocked by security guardrail: prompt injection or router-manipulation "
             "attempt detected.")
    return {
        "guarded": f"""
          SELECT d.* REPLACE (
              CASE WHEN is_safe THEN action ELSE 'mute' END AS action,
              CASE WHEN is_safe THEN message_type ELSE 'scam' END AS message_type,
              CASE WHEN is_safe THEN reason ELSE {s(guard)} END AS reason,
              CASE WHEN is_safe THEN confidence ELSE 0.99 END::DOUBLE AS confidence),
            is_safe AND confidence < 0.6 AS needs_review,
            CASE WHEN is_safe THEN {ids} ELSE 'none' END AS evidence_message_ids
          FROM decided d {join}""",
        "fixes": f"""
          SELECT *, CASE
            WHEN {has('rl', L.VERIFY_SCAM)} THEN CASE WHEN message_type
              NOT IN ('scam', 'spam') THEN 'scam' END
            WHEN {has('rl', L.VERIFY_SPAM)} THEN CASE WHEN message_type
              NOT IN ('spam', 'promotion', 'scam') THEN 'spam' END
            WHEN {has('rl', L.VERIFY_FORWARD)} THEN CASE WHEN message_type NOT IN ('scam',
              'spam', 'forward', 'greeting', 'promotion', 'payment') THEN 'forward' END
            WHEN {has('rl', L.VERIFY_PROMOTION)} THEN CASE WHEN message_type
              NOT IN ('promotion', 'spam', 'scam') THEN 'promotion' END
            WHEN contains(rl, 'payment notification') THEN CASE WHEN message_type NOT IN
              ('payment', 'scam', 'spam', 'promotion', 'urgent', 'event', 'business_update')
              THEN 'payment' END END AS fix
          FROM (SELECT *, lower(reason) AS rl FROM guarded)""",
        "checked": """
          SELECT * EXCLUDE (action, message_type, confidence),
            CASE WHEN new_type IN ('scam', 'spam') THEN 'mute' ELSE action END AS action,
            new_type AS message_type, round_even(confidence, 4) AS confidence, corrections,
            message_id || ' | action=' || CASE WHEN new_type IN ('scam', 'spam') THEN 'mute'
              ELSE action END || ' | type=' || new_type || ' | conf='
              || printf('%.3f', confidence) || ' | evidence='
              || CASE WHEN evidence_message_ids <> 'none' THEN 'yes' ELSE 'no' END
              || CASE WHEN corrections <> '' THEN ' | fixes=' || corrections ELSE '' END AS trace
          FROM (SELECT *, coalesce(fix, message_type) AS new_type,
            concat_ws(',', 'type:' || message_type || '->' || fix || '(reason_match)',
              CASE WHEN coalesce(fix, message_type) IN ('scam', 'spam') AND action <> 'mute'
                THEN 'action:' || action || '->mute(scam_type_safety)' END) AS corrections
            FROM fixes)""",
    }


CONSISTENT = f"""
  SELECT message_id, b.action, b.message_type, b.reason, b.confidence, b.evidence_message_ids
  FROM (SELECT message_id, first_value(r) OVER (
      PARTITION BY user_id, sender_user_id, conversation_type, media_type, forwarded_count, norm
      ORDER BY r.confidence DESC, created_at, message_id) AS b
    FROM (SELECT message_id, user_id, sender_user_id, conversation_type, media_type,
        forwarded_count, created_at, {strip("lower(coalesce(message_text, ''))")} AS norm,
        {{'action': action, 'message_type': message_type, 'reason': reason,
          'confidence': confidence, 'evidence_message_ids': evidence_message_ids}} AS r
      FROM consistent_input))"""
