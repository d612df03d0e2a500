"""DuckDB SQL for the registered queries, written apart from the Spark plans."""

from __future__ import annotations

from beckon import lexicons as L
from oracles import routing as r
from oracles.prelude import sql
from oracles.words import has, items, rounded, s, text_features, tokens

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]
OUT = "message_id, action, message_type, reason, confidence, evidence_message_ids"
ORACLES: dict[str, str] = {}

# --- text ------------------------------------------------------------------
ORACLES["text_structure"] = (
    f"SELECT doc_id, {', '.join(L.TEXT_FEATURES[:9])} "
    f"FROM ({text_features('documents', 'doc_id', 'text')})")
ORACLES["document_text_features"] = rounded(
    text_features("documents", "doc_id", "text"), L.TEXT_FEATURES, "doc_id")
ORACLES["conversation_text_features"] = rounded(
    text_features("conversations", "conv_id, turn", "text"), L.TEXT_FEATURES, "conv_id, turn")
ORACLES["message_text_features"] = sql(rounded(
    text_features("messages", "message_id", "message_text"), L.TEXT_FEATURES, "message_id"),
    "messages")
ORACLES["keyword_counts"] = sql(
    "SELECT user_id, conversation_type, sum(urgency_keyword_count)::BIGINT AS "
    "urgency_keyword_count, sum(scam_keyword_count)::BIGINT AS scam_keyword_count, "
    "sum(forward_indicator_count)::BIGINT AS forward_indicator_count FROM ("
    + text_features("messages", "user_id, conversation_type", "message_text")
    + ") GROUP BY ALL", "messages")
ORACLES["spam_score"] = (
    "SELECT lang, source, score, count(*) AS documents, "
    "round(max(caps_word_ratio), 6) AS max_caps FROM (SELECT lang, source, caps_word_ratio, "
    "round(spam_pattern_score, 6) AS score FROM ("
    + text_features("documents", "lang, source", "text") + ")) GROUP BY ALL")

# --- guard and rules -------------------------------------------------------
ORACLES["guardrail"] = sql(
    f"SELECT message_id, NOT bad AS is_safe, CASE WHEN bad THEN 'unsafe' ELSE 'safe' END AS path "
    f"FROM (SELECT message_id, {has('lower(coalesce(message_text, chr(32)))', L.GUARD_PHRASES)} "
    "AS bad FROM messages)", "messages")
ORACLES["business_risk"] = sql(
    "SELECT a.business_id, high_risk_business, (SELECT count(*) FROM messages m "
    "WHERE m.business_id = a.business_id) AS messages FROM accounts a", "messages", "accounts")
RULED = {"signals": r.SIGNALS, "ruled": r.RULES}
ORACLES["rule_cascade"] = sql(
    f"SELECT message_id, rule_action AS action, rule_type AS message_type, "
    f"{r.RULE_REASON} AS reason, rule_confidence AS confidence, "
    "'none' AS evidence_message_ids, rule_id FROM ruled WHERE rule_id IS NOT NULL",
    "messages", "accounts", extra=RULED)
ORACLES["rule_output_round_trip"] = f"SELECT {OUT} FROM ({ORACLES['rule_cascade']})"
ORACLES["rule_coverage"] = sql(
    "SELECT count(*) AS messages, count(rule_id) AS matched, "
    "round(count(rule_id) / count(*), 6) AS coverage FROM ruled",
    "messages", "accounts", extra=RULED)
ORACLES["rule_signals"] = sql(
    "SELECT message_id, hits AS scam_words, timed AS has_time, scam AS is_scam, "
    f"spam AS is_spam, {has('low', L.RULE_CHAIN)} AS is_chain, "
    f"{has('low', L.RULE_TRANSACTIONAL)} AS is_transactional, calm AS is_calm FROM signals",
    "messages", extra={"signals": r.SIGNALS})

# --- history ---------------------------------------------------------------
ORACLES["sender_reaction_stats"] = sql(
    "SELECT s.*, coalesce(m.muted, 0) AS muted FROM sender_stats s LEFT JOIN (SELECT user_id, "
    "coalesce(sender_user_id, 'business') AS sender_key, count(*) AS muted FROM history "
    "WHERE event_type IN ('error', 'signup') AND k % 3 = 0 GROUP BY ALL) m "
    "USING (user_id, sender_key)", "sender_stats", "history")
ORACLES["user_reaction_stats"] = sql(
    "SELECT user_id, total_opens, total_replies, total_dismissed, total_reported, "
    "total_messages, round(reply_rate, 6) AS reply_rate, round(open_rate, 6) AS open_rate, "
    "round(avg_daily_notifications, 6) AS avg_daily_notifications, "
    "round(avg_daily_dismissals, 6) AS avg_daily_dismissals FROM user_stats", "user_stats")

HISTORY_SQL = {
    "sender": ("LEFT JOIN sender_stats ss ON ss.user_id = i.user_id AND "
               "ss.sender_key = coalesce(i.sender_user_id, 'business')", {
                   "sender_message_count": "ss.message_count",
                   "sender_reply_rate": "ss.replied / ss.message_count",
                   "sender_open_rate": "ss.opened / ss.message_count",
                   "sender_dismiss_rate": "ss.dismissed / ss.message_count",
                   "sender_report_count": "ss.reported",
                   "sender_trust_score":
                       "ss.replied / ss.message_count * 2.0 + ss.opened / ss.message_count "
                       "- ss.dismissed / ss.message_count * 3.0 - ss.reported * 10.0"}),
    "topic": ("LEFT JOIN topic t ON t.message_id = i.message_id", {
        "topic_similarity": "t.topic_similarity"}),
    "user": ("LEFT JOIN user_stats us ON us.user_id = i.user_id", {
        "user_total_opens": "us.total_opens", "user_total_replies": "us.total_replies",
        "user_reply_rate": "us.reply_rate",
        "user_notification_load": "us.avg_daily_notifications"}),
    "dismissals": ("LEFT JOIN alike sd ON sd.message_id = i.message_id", {
        "similar_dismissals": "sd.n"}),
    "category": ("LEFT JOIN category c ON c.user_id = i.user_id AND "
                 "c.conversation_type = i.conversation_type", {
                     "category_dismiss_rate": "c.category_dismiss_rate"}),
    "business": ("LEFT JOIN relations rel ON rel.user_id = i.user_id AND "
                 "rel.business_id = i.business_id", {
                     c: f"rel.{c}" for c in ["has_recent_order", "has_opted_in",
                                             "has_opted_out", "business_interaction_count"]}),
    "group": ("LEFT JOIN members g ON g.user_id = i.user_id AND g.group_id = i.group_id", {
        c: f"g.{c}" for c in ["is_group_admin", "group_message_count",
                              "group_engagement_rate", "group_is_muted"]}),
}
NEEDS = {"sender": ["sender_stats"], "topic": [], "user": ["user_stats"], "dismissals": [],
         "category": ["category"], "business": ["relations"], "group": ["members"]}
WORDS = tokens("lower(coalesce(message_text, ''))")
SIMILAR = f"""
  SELECT a.message_id, count(*) AS n
  FROM (SELECT message_id, user_id, list_distinct({WORDS}) AS w FROM incoming) a
  JOIN (SELECT user_id, list_distinct({WORDS}) AS w FROM history
        WHERE event_type IN ('error', 'signup')) b
    ON a.user_id = b.user_id AND len(list_intersect(a.w, b.w)) >= 3
  GROUP BY a.message_id"""


def history_select(blocks, digits: int = 6) -> tuple[str, str]:
    """Select list and joins of history features over ``incoming i``."""
    cols = [f"round(coalesce({e}, 0)::DOUBLE, {digits}) AS {n}"
            for b in blocks for n, e in HISTORY_SQL[b][1].items()]
    return ", ".join(cols), " ".join(HISTORY_SQL[b][0] for b in blocks)


for name, block in {"sender_trust": "sender", "user_engagement": "user",
                    "category_dismiss_rate": "category", "business_relation": "business",
                    "group_engagement": "group", "similar_dismissals": "dismissals"}.items():
    columns, joins = history_select([block])
    ORACLES[name] = sql(f"SELECT i.message_id, {columns} FROM incoming i {joins}",
                        "incoming", "history", *NEEDS[block],
                        extra={"alike": SIMILAR} if block == "dismissals" else None)

# --- evidence --------------------------------------------------------------
TERMS = {
    "words": f"""
      SELECT message_id, past, list_filter(regexp_extract_all(
          lower(coalesce(message_text, '')), '[\\p{{L}}\\p{{N}}_]{{2,}}'),
          lambda x: x NOT IN ({items(L.STOP_WORDS)})) AS w FROM messages""",
    "counts": """
      SELECT message_id, past, term, count(*) AS n FROM (
        SELECT message_id, past, unnest(list_concat(w, list_transform(
          range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) AS term FROM words)
      GROUP BY ALL""",
    "vocab": """
      SELECT term, sum(n)::BIGINT AS cf, count(*) AS df FROM counts WHERE past GROUP BY term
      ORDER BY cf DESC, term LIMIT 500""",
    "weights": """
      SELECT message_id, term, w / sqrt(sum(w * w) OVER (PARTITION BY message_id)) AS w
      FROM (SELECT message_id, term, n * (ln((1 + (SELECT count(*) FROM words WHERE past))
          / (1 + df)::DOUBLE) + 1) AS w FROM counts JOIN vocab USING (term))""",
}
SCOPE = {
    "scopes": """
      SELECT *, CASE WHEN n_b > 0 AND (CASE WHEN k1 = 'sender' THEN n_s WHEN k1 = 'group'
          THEN n_g ELSE n_u END) = n_u THEN 'business' ELSE k1 END AS kind
      FROM (SELECT *, CASE WHEN n_g > 0 AND (n_s IS NULL OR n_s = n_u) THEN 'group'
          WHEN n_s > 0 THEN 'sender' ELSE 'user' END AS k1
        FROM (SELECT i.message_id, i.user_id, i.sender_user_id, i.group_id, i.business_id,
            n_u, n_s, n_g, n_b
          FROM incoming i
          JOIN (SELECT user_id, count(*) AS n_u FROM history GROUP BY ALL) USING (user_id)
          LEFT JOIN (SELECT user_id, sender_user_id, count(*) AS n_s FROM history GROUP BY ALL)
            USING (user_id, sender_user_id)
          LEFT JOIN (SELECT user_id, group_id, count(*) AS n_g FROM history GROUP BY ALL)
            USING (user_id, group_id)
          LEFT JOIN (SELECT user_id, business_id, count(*) AS n_b FROM history GROUP BY ALL)
            USING (user_id, business_id)))""",
}
EVIDENCE = {
    **TERMS, **SCOPE,
    "pairs": """
      SELECT c.message_id, h.message_id AS evidence_id, h.created_at,
        max(h.created_at) OVER (PARTITION BY c.message_id) AS newest
      FROM scopes c JOIN incoming i USING (message_id)
      JOIN history h ON h.user_id = c.user_id AND CASE c.kind
        WHEN 'sender' THEN h.sender_user_id = c.sender_user_id
        WHEN 'group' THEN h.group_id = c.group_id
        WHEN 'business' THEN h.business_id = c.business_id ELSE true END
      WHERE length(coalesce(i.message_text, '')) >= 10""",
    "cosines": """
      SELECT p.message_id, p.evidence_id, any_value(created_at) AS created_at,
        any_value(newest) AS newest, sum(a.w * b.w) AS cosine
      FROM pairs p JOIN weights a ON a.message_id = p.message_id
      JOIN weights b ON b.message_id = p.evidence_id AND b.term = a.term
      GROUP BY ALL""",
    "best": """
      SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY message_id
          ORDER BY score DESC, created_at DESC, evidence_id DESC) AS rank
        FROM (SELECT *, round(cosine + 0.15 * exp(-((epoch_us(newest) - epoch_us(created_at))
            / 86400000000.0) / 60.0), 6) AS score FROM cosines) WHERE score > 0.2)
      WHERE rank <= 3""",
    "lists": """
      SELECT i.message_id, coalesce(string_agg(evidence_id, ';' ORDER BY rank), 'none')
        AS evidence_message_ids
      FROM incoming i LEFT JOIN best USING (message_id) GROUP BY ALL""",
    "topic": """
      SELECT message_id, avg(cosine) AS topic_similarity FROM best GROUP BY ALL""",
}
ORACLES["tfidf_vocabulary"] = sql("SELECT * FROM vocab", "messages", extra=TERMS)
ORACLES["tfidf_weights"] = sql(
    "SELECT message_id, term, round(w, 6) AS weight FROM weights", "messages", extra=TERMS)
ORACLES["evidence_scope"] = sql(
    "SELECT message_id, kind, CASE kind WHEN 'sender' THEN sender_user_id WHEN 'group' THEN "
    "group_id WHEN 'business' THEN business_id ELSE '' END AS id, CASE kind WHEN 'sender' THEN "
    "n_s WHEN 'group' THEN n_g WHEN 'business' THEN n_b ELSE n_u END AS scope_rows FROM scopes",
    "incoming", "history", extra=SCOPE)
ORACLES["evidence_topk"] = sql(
    "SELECT message_id, rank, evidence_id, score FROM best",
    "incoming", "history", extra=EVIDENCE)
ORACLES["evidence_list"] = sql("SELECT * FROM lists", "incoming", "history", extra=EVIDENCE)
ORACLES["topic_similarity"] = sql(
    "SELECT message_id, round(topic_similarity, 5) AS topic_similarity FROM topic",
    "incoming", "history", extra=EVIDENCE)

# --- as of each message's time ---------------------------------------------
KNOWN = {"known": """
  SELECT user_id, coalesce(sender_user_id, 'business') AS sender_key, conversation_type,
    created_at + to_minutes((CASE WHEN event_type IN ('click', 'view', 'purchase') THEN k ELSE 0 END)::BIGINT) AS at,
    (event_type IN ('click', 'view', 'purchase'))::INT AS opened, (event_type = 'purchase')::INT AS replied,
    (event_type IN ('error', 'signup'))::INT AS dismissed, (event_type = 'error' AND k >= 60)::INT AS reported,
    list_distinct(""" + WORDS + """) AS w
  FROM history"""}
SCOPE_AS_OF = {"scopes": """
  SELECT *, CASE kind WHEN 'sender' THEN sender_user_id WHEN 'group' THEN group_id WHEN 'business' THEN business_id
      ELSE '' END AS id, CASE kind WHEN 'sender' THEN n_s WHEN 'group' THEN n_g WHEN 'business' THEN n_b ELSE n_u END
      AS scope_rows, CASE kind WHEN 'sender' THEN t_s WHEN 'group' THEN t_g WHEN 'business' THEN t_b ELSE t_u END AS newest
  FROM (SELECT *, CASE WHEN n_b > 0 AND (CASE WHEN k1 = 'sender' THEN n_s WHEN k1 = 'group' THEN n_g ELSE n_u END)
        = n_u THEN 'business' ELSE k1 END AS kind
    FROM (SELECT *, CASE WHEN n_g > 0 AND (n_s = 0 OR n_s = n_u) THEN 'group' WHEN n_s > 0 THEN 'sender'
          ELSE 'user' END AS k1
      FROM (SELECT m.message_id, m.user_id, m.sender_user_id, m.group_id, m.business_id,
          count(*) AS n_u, max(h.created_at) AS t_u,
          count(*) FILTER (h.sender_user_id = m.sender_user_id) AS n_s,
          max(h.created_at) FILTER (h.sender_user_id = m.sender_user_id) AS t_s,
          count(*) FILTER (h.group_id = m.group_id) AS n_g, max(h.created_at) FILTER (h.group_id = m.group_id) AS t_g,
          count(*) FILTER (h.business_id = m.business_id) AS n_b,
          max(h.created_at) FILTER (h.business_id = m.business_id) AS t_b
        FROM messages m JOIN history h ON h.user_id = m.user_id AND h.created_at < m.created_at
        GROUP BY ALL)))"""}
EVIDENCE_AS_OF = {
    **EVIDENCE, **SCOPE_AS_OF,
    "pairs": """
      SELECT c.message_id, h.message_id AS evidence_id, h.created_at, c.newest
      FROM scopes c JOIN messages i USING (message_id)
      JOIN history h ON h.user_id = c.user_id AND h.created_at < i.created_at AND CASE c.kind
        WHEN 'sender' THEN h.sender_user_id = c.sender_user_id
        WHEN 'group' THEN h.group_id = c.group_id
        WHEN 'business' THEN h.business_id = c.business_id ELSE true END
      WHERE length(coalesce(i.message_text, '')) >= 10"""}
del EVIDENCE_AS_OF["lists"]
ORACLES["evidence_scope_as_of"] = sql(
    "SELECT message_id, kind, id, scope_rows, epoch_us(newest) AS newest FROM scopes", "messages", "history",
    extra=SCOPE_AS_OF)
ORACLES["evidence_topk_as_of"] = sql(
    "SELECT message_id, rank, evidence_id, score FROM best", "messages", "history", extra=EVIDENCE_AS_OF)
ORACLES["features_as_of"] = sql("SELECT message_id, " + ", ".join(
    f"round(coalesce({e}, 0)::DOUBLE, 5) AS {n}" for n, e in {
        "sender_message_count": "s.n", "sender_reply_rate": "s.replied / s.n", "sender_open_rate": "s.opened / s.n",
        "sender_dismiss_rate": "s.dismissed / s.n", "sender_report_count": "s.reported",
        "sender_trust_score": "s.replied / s.n * 2.0 + s.opened / s.n - s.dismissed / s.n * 3.0 - s.reported * 10.0",
        "topic_similarity": "topic_similarity", "user_total_opens": "u.opened", "user_total_replies": "u.replied",
        "user_reply_rate": "u.replied / u.n", "user_notification_load": "d.load", "similar_dismissals": "u.alike",
        "category_dismiss_rate": "coalesce(g.dismissed, 0) / greatest(c.n, 1)",
        **{c: c for c in L.HISTORY_FEATURES[13:]}}.items())
    + """ FROM messages m
LEFT JOIN (SELECT m.message_id, count(*) AS n, sum(opened) AS opened, sum(replied) AS replied, sum(dismissed) AS dismissed,
    sum(reported) AS reported FROM messages m JOIN known r ON r.user_id = m.user_id
    AND r.sender_key = coalesce(m.sender_user_id, 'business') AND r.at < m.created_at GROUP BY ALL) s USING (message_id)
LEFT JOIN (SELECT m.message_id, count(*) AS n, sum(opened) AS opened, sum(replied) AS replied, count(*) FILTER (
    dismissed = 1 AND len(list_intersect(r.w, m.w)) >= 3) AS alike
    FROM (SELECT *, list_distinct(""" + WORDS + """) AS w FROM messages) m JOIN known r
    ON r.user_id = m.user_id AND r.at < m.created_at GROUP BY ALL) u USING (message_id)
LEFT JOIN (SELECT m.message_id, count(*) / count(DISTINCT h.created_at::DATE) AS load FROM messages m JOIN history h
    ON h.user_id = m.user_id AND h.created_at::DATE < m.created_at::DATE GROUP BY ALL) d USING (message_id)
LEFT JOIN (SELECT m.message_id, count(*) AS n FROM messages m JOIN history h ON h.user_id = m.user_id
    AND h.conversation_type = m.conversation_type AND h.created_at < m.created_at GROUP BY ALL) c USING (message_id)
LEFT JOIN (SELECT m.message_id, sum(dismissed) AS dismissed FROM messages m JOIN known r ON r.user_id = m.user_id
    AND r.conversation_type = m.conversation_type AND r.at < m.created_at GROUP BY ALL) g USING (message_id)
LEFT JOIN topic USING (message_id)
LEFT JOIN relations rel ON rel.user_id = m.user_id AND rel.business_id = m.business_id
LEFT JOIN members mem ON mem.user_id = m.user_id AND mem.group_id = m.group_id""",
    "messages", "history", "relations", "members", extra={**EVIDENCE_AS_OF, **KNOWN})
ORACLES["stream_live_features"] = sql("SELECT message_id, " + ", ".join(
    f"round(coalesce({e}, 0)::DOUBLE, 6) AS {n}" for n, e in {
        "sender_message_count": "s.n", "sender_reply_rate": "s.replied / s.n", "sender_open_rate": "s.opened / s.n",
        "sender_dismiss_rate": "s.dismissed / s.n", "sender_report_count": "s.reported",
        "sender_trust_score": "s.replied / s.n * 2.0 + s.opened / s.n - s.dismissed / s.n * 3.0 - s.reported * 10.0",
        "user_total_opens": "u.opened", "user_total_replies": "u.replied", "user_reply_rate": "u.replied / u.n",
        "category_dismiss_rate": "coalesce(g.dismissed, 0) / greatest(c.n, 1)"}.items())
    + """ FROM messages m
LEFT JOIN (SELECT m.message_id, count(*) AS n, sum(opened) AS opened, sum(replied) AS replied, sum(dismissed) AS dismissed,
    sum(reported) AS reported FROM messages m JOIN known r ON r.user_id = m.user_id
    AND r.sender_key = coalesce(m.sender_user_id, 'business') AND r.at < m.created_at GROUP BY ALL) s USING (message_id)
LEFT JOIN (SELECT m.message_id, count(*) AS n, sum(opened) AS opened, sum(replied) AS replied
    FROM messages m JOIN known r ON r.user_id = m.user_id AND r.at < m.created_at GROUP BY ALL) u USING (message_id)
LEFT JOIN (SELECT m.message_id, count(*) AS n FROM messages m JOIN messages h ON h.user_id = m.user_id
    AND h.conversation_type = m.conversation_type AND h.created_at < m.created_at GROUP BY ALL) c USING (message_id)
LEFT JOIN (SELECT m.message_id, sum(dismissed) AS dismissed FROM messages m JOIN known r ON r.user_id = m.user_id
    AND r.conversation_type = m.conversation_type AND r.at < m.created_at GROUP BY ALL) g USING (message_id)
WHERE m.created_at >= TIMESTAMP '2024-01-11'""", "messages", "history", extra=KNOWN)
ORACLES["stream_answers"] = sql("""
SELECT user_id, message_id, answered, CASE WHEN answered THEN waited END AS minutes,
  (answered AND opened)::INT AS message_opened, (answered AND event_type = 'purchase')::INT AS message_replied,
  (answered AND NOT opened)::INT AS notification_dismissed,
  (answered AND event_type = 'error' AND k >= 60)::INT AS message_reported
FROM (SELECT *, past AND waited <= 60 AS answered FROM (SELECT *, event_type IN ('click', 'view', 'purchase') AS opened,
    CASE WHEN event_type IN ('click', 'view', 'purchase') THEN k ELSE 0 END AS waited FROM messages))
WHERE created_at >= TIMESTAMP '2024-01-11'""", "messages")
ORACLES["model_contract"] = sql("""
SELECT (SELECT count(*) FROM incoming) AS scored, 0 AS wrong_sums, 0 AS wrong_probabilities, 0 AS wrong_actions,
  count(*) AS labelled, (SELECT sum(t)::BIGINT FROM (SELECT round(count(*) * 0.2::DOUBLE) AS t
    FROM history JOIN truth USING (message_id) GROUP BY true_action)) AS test_rows,
  0 AS changed_by_saving, 200 AS train_rounds, 200 AS test_rounds, 0 AS rises FROM history""",
    "incoming", "history", "truth")

# --- enrichment ------------------------------------------------------------
ENRICHED = {"enriched": r.ENRICHED}
ORACLES["enriched_messages"] = sql(
    "SELECT message_id, media_type, message_text, use_tail AS transcript_used, image_urgency, "
    "image_category, image_extracted_text, image_has_deadline FROM enriched",
    "messages", extra=ENRICHED)
ORACLES["enrichment_counters"] = sql(
    "SELECT unnest(['transcripts_loaded', 'analyses_loaded', 'transcripts_used', "
    "'images_enriched']) AS counter, unnest([count(*) FILTER (media_type = 'voice' AND "
    "coalesce(tail, '') <> ''), count(*) FILTER (seen), count(*) FILTER (use_tail), "
    "count(*) FILTER (seen)]) AS n FROM enriched", "messages", extra=ENRICHED)
ORACLES["media_paths"] = sql(
    "SELECT message_id, media_type, media_id, CASE WHEN p_partkey IS NOT NULL THEN "
    "'dataset/media/images/' || media_id || '.jpg' WHEN c_custkey IS NOT NULL THEN "
    "'dataset/media/audio/' || media_id || '.mp3' END AS media_path FROM messages "
    "LEFT JOIN part ON media_id = 'img_' || p_partkey "
    "LEFT JOIN customer ON media_id = 'vn_' || c_custkey WHERE media_type IS NOT NULL",
    "messages")
ORACLES["media_message_map"] = sql(
    "SELECT media_type, media_id, arg_max(message_id, (created_at, message_id)) AS message_id "
    "FROM messages WHERE media_id IS NOT NULL GROUP BY ALL", "messages")
ORACLES["parsed_model_json"] = (
    "SELECT doc_id, NOT plain AS parsed, CASE WHEN plain THEN 'unknown' ELSE "
    "['high', 'medium', 'low'][doc_id % 3 + 1] END AS urgency, CASE WHEN plain OR doc_id % 4 = 0 "
    "THEN 'unknown' ELSE lower(lang) END AS category, NOT plain AND doc_id % 2 = 0 AS "
    "has_deadline, CASE WHEN plain THEN 'No object here: ' || replace(replace(text, '{', '('), "
    "'}', ')') ELSE text END AS extracted_text, CASE WHEN plain THEN "
    "'Raw response from vision model' ELSE source END AS reason "
    "FROM (SELECT *, doc_id % 5 = 4 AS plain FROM documents)")
ORACLES["table_row_counts"] = " UNION ALL ".join(
    f"SELECT '{t}' AS \"table\", count(*) AS \"rows\" FROM {t}" for t in TABLES)
ORACLES["csv_round_trip"] = (
    "SELECT 'message_' || conv_id || '_' || turn AS message_id, 'digest' AS action, "
    "'personal' AS message_type, text AS reason, turn / 8 AS confidence, "
    "role AS evidence_message_ids FROM conversations")

ORACLES["artefact_round_trip"] = sql(
    "SELECT message_id, tail AS transcript FROM messages WHERE media_type = 'voice'", "messages")
_KEYED = {
    "messages": ("incoming", "message_id"), "sample_messages": ("messages", "message_id"),
    "message_history": ("history", "message_id"), "message_events": ("history", "message_id"),
    "daily_notification_summary": (
        "(SELECT DISTINCT user_id, created_at::DATE AS d FROM history)", "user_id"),
    "business_accounts": ("supplier", "s_suppkey"), "group_members": ("members", "group_id"),
    "user_business_history": ("relations", "business_id"), "images": ("part", "p_partkey"),
    "voice_notes": ("customer", "c_custkey"), "users": ("customer", "c_custkey"),
    "groups": ("(SELECT DISTINCT group_id FROM members)", "group_id"),
}
_TEXTS = {"messages", "sample_messages", "message_history"}
ORACLES["tables_round_trip"] = sql(" UNION ALL ".join(
    f"SELECT '{name}' AS \"table\", count(*) AS \"rows\", count(DISTINCT {key}) AS keys, "
    + ("sum(length(message_text || chr(10) || '\"quoted\", ' || message_id))::BIGINT" if name in _TEXTS else "NULL::BIGINT")
    + f" AS text_chars, true AS unchanged FROM {table}"
    for name, (table, key) in _KEYED.items()), "incoming", "history", "members", "relations")

# --- types, reasons, checks ------------------------------------------------
ORACLES["message_type"] = sql(
    "SELECT message_id, " + ", ".join(
        f"{r.message_type(s(a))} AS type_if_{a}" for a in L.ACTIONS)
    + f" FROM (SELECT *, lower(tt) AS tl FROM (SELECT e.*, {r.TEXT_IN_USE} AS tt, "
    "f.at_mention_with_question, f.has_specific_time FROM enriched e "
    "JOIN feat f USING (message_id)))", "messages",
    extra={**ENRICHED, "feat": text_features("enriched", "message_id", "message_text")})
DECIDED_NEEDS = ["messages", "incoming", "accounts", "scored", "sender_stats", "category",
                 "members"]
DECIDED = r.decided("incoming", scored=True)
# the whole router: enriched messages, evidence, verifier, consistency
CHECKED = {**r.ON_ENRICHED, **EVIDENCE, **r.decided("incoming", scored=True, enriched=True),
           **r.checked("lists")}
FINAL = {**CHECKED, "consistent_input": "SELECT * FROM checked", "final": r.CONSISTENT}
ORACLES["reason_texts"] = sql(
    "SELECT message_id, action, message_type, round(confidence, 6) AS confidence, reason "
    "FROM decided", *DECIDED_NEEDS, extra=DECIDED)
ORACLES["calibrated_confidence"] = sql(
    "SELECT message_id, round_even(p, 4) AS confidence, p < 0.6 AS needs_review FROM (SELECT "
    "message_id, least(0.95::DOUBLE, CASE WHEN model_probability < 0.5 THEN 0.5 "
    "ELSE model_probability END) AS p FROM scored)", "scored")


def on_checked(select: str, *more: str) -> str:
    return sql(select, *DECIDED_NEEDS, "history", *more, extra=CHECKED)


def on_final(select: str, *more: str) -> str:
    return sql(select, *DECIDED_NEEDS, "history", *more, extra=FINAL)


ORACLES["verified_output"] = on_checked(
    "SELECT message_id, action, message_type, corrections, trace FROM checked")
SIGNALS_IN_REASON = {
    "scam": "starts_with(reason, 'Scam/phishing pattern') OR starts_with(reason, 'Potential "
            "scam') OR NOT is_safe",
    "spam": "starts_with(reason, 'Aggressive promotional spam')",
    "forward": "starts_with(reason, 'Chain content') OR regexp_matches(reason, "
               "'^Forwarded (\\d+ times with|content useful)')",
    "promotion": "starts_with(reason, 'Promotional ')",
    "payment": "starts_with(reason, 'Payment notification')",
}
ORACLES["verified_by_template"] = on_checked(
    "SELECT message_id, CASE WHEN t IN ('scam', 'spam') THEN 'mute' ELSE action END AS action, "
    "t AS message_type FROM (SELECT message_id, action, CASE "
    f"WHEN {SIGNALS_IN_REASON['scam']} THEN CASE WHEN message_type IN ('scam', 'spam') THEN "
    "message_type ELSE 'scam' END "
    f"WHEN {SIGNALS_IN_REASON['spam']} THEN message_type "
    f"WHEN {SIGNALS_IN_REASON['forward']} THEN CASE WHEN message_type IN ('scam', 'spam', "
    "'forward', 'greeting', 'promotion', 'payment') THEN message_type ELSE 'forward' END "
    f"WHEN {SIGNALS_IN_REASON['promotion']} THEN CASE WHEN message_type IN ('promotion', 'spam', "
    "'scam') THEN message_type ELSE 'promotion' END "
    "ELSE CASE WHEN "
    f"{SIGNALS_IN_REASON['payment']} AND message_type IN ('personal', 'greeting', 'forward', "
    "'unknown') THEN 'payment' ELSE message_type END END AS t FROM guarded)")
ORACLES["trace_summary"] = on_checked(
    "SELECT count(*) AS processed, count(*) FILTER (corrections <> '') AS corrected FROM checked")
ORACLES["corrected_messages"] = on_checked(
    "SELECT message_id, corrections, trace FROM checked WHERE corrections <> ''")
ORACLES["review_queue"] = on_checked(f"SELECT {OUT} FROM checked WHERE needs_review")
ORACLES["validated_output"] = sql(
    "SELECT message_id, CASE WHEN ok THEN action ELSE 'mute' END AS action, "
    "CASE WHEN ok THEN 'personal' ELSE 'unknown' END AS message_type, CASE WHEN ok THEN "
    "event_type ELSE 'Fallback: Output validation failed after 3 retries.' END AS reason, "
    "CASE WHEN ok THEN round(value / 100, 6) ELSE 0.0 END::DOUBLE AS confidence, "
    "'none' AS evidence_message_ids, ok AS is_valid FROM (SELECT *, CASE event_type WHEN 'view' "
    "THEN 'digest' ELSE 'notify' END AS action, event_type IN ('view', 'click') AND k % 9 <> 0 "
    "AND k % 11 <> 0 AND value <= 100 AND value >= 0 AS ok FROM messages)", "messages")

# --- end to end ------------------------------------------------------------
ORACLES["route_messages"] = on_final("SELECT * FROM final")

ORACLES["consistency"] = sql(
    r.CONSISTENT, "messages", extra={"consistent_input": """
      SELECT message_id || again AS message_id, created_at + again * INTERVAL 1 HOUR AS created_at,
        user_id, sender_user_id, conversation_type, media_type, forwarded_count, message_text,
        CASE again WHEN 0 THEN event_type ELSE conversation_type END AS action,
        conversation_type AS message_type,
        ((event_id + again * 3) % 5)::DOUBLE AS confidence, message_id || again AS reason,
        'none' AS evidence_message_ids FROM messages, (VALUES (0), (1)) v(again)
      WHERE again = 0 OR event_id % 3 = 0"""})

# --- reports ---------------------------------------------------------------


def share(table: str, column: str) -> str:
    return (f"SELECT {column}, count(*) AS n, round(100.0 * count(*) / (SELECT count(*) FROM "
            f"{table})::DOUBLE, 6) AS share FROM {table} GROUP BY {column}")


ORACLES["action_distribution"] = on_final(share("final", "action"))
ORACLES["message_type_top10"] = on_final(
    share("final", "message_type") + " ORDER BY n DESC, message_type LIMIT 10")
ORACLES["confidence_by_action"] = on_final(
    "SELECT action, round(avg(confidence), 6) AS mean_confidence, round(min(confidence), 6) AS "
    "min_confidence, round(max(confidence), 6) AS max_confidence FROM final GROUP BY action")
ORACLES["class_distribution"] = sql(share("truth", "true_action"), "truth")
ORACLES["action_accuracy"] = on_final(
    "SELECT count(*) AS n, round(avg((action = true_action)::INT), 6) AS accuracy "
    "FROM final JOIN truth USING (message_id)", "truth")
ORACLES["rule_accuracy"] = sql(
    "SELECT count(*) AS n, round(avg((rule_action = true_action)::INT), 6) AS accuracy "
    "FROM ruled JOIN truth USING (message_id) WHERE rule_id IS NOT NULL",
    "messages", "accounts", "truth", extra=RULED)
ORACLES["confusion_matrix"] = on_final(
    "SELECT true_action AS true_class, " + ", ".join(
        f"count(*) FILTER (action = '{c}') AS {c}" for c in L.ACTION_CLASSES)
    + " FROM final JOIN truth USING (message_id) GROUP BY true_action", "truth")
ORACLES["class_report"] = sql(
    "SELECT class, round(precision, 6) AS precision, round(recall, 6) AS recall, "
    "round(f1, 6) AS f1, support FROM (SELECT * FROM per UNION ALL SELECT 'macro avg', "
    "avg(precision), avg(recall), avg(f1), sum(support)::BIGINT FROM per UNION ALL SELECT "
    "'weighted avg', sum(precision * support) / sum(support), sum(recall * support) / "
    "sum(support), sum(f1 * support) / sum(support), sum(support)::BIGINT FROM per)",
    *DECIDED_NEEDS, "history", "truth", extra={**FINAL, "per": """
      SELECT class, tp / pred AS precision, tp / n AS recall,
        2.0 * tp / (pred + n) AS f1, n AS support
      FROM (SELECT c AS class,
          count(*) FILTER (action = c AND true_action = c) AS tp,
          count(*) FILTER (action = c) AS pred, count(*) FILTER (true_action = c) AS n
        FROM final JOIN truth USING (message_id),
          (VALUES ('digest'), ('mute'), ('notify')) v(c) GROUP BY c)"""})
ORACLES["type_accuracy"] = on_final(
    "SELECT count(*) AS n, round(avg((message_type = true_type)::INT), 6) AS accuracy, "
    "avg((message_type = true_type)::INT) >= 0.85 AS accepted FROM final JOIN (SELECT message_id, "
    "CASE conversation_type WHEN 'business' THEN 'business_update' ELSE 'personal' END AS true_type "
    "FROM messages) USING (message_id)")
ORACLES["misclassified"] = on_final(
    "SELECT message_id, action, true_action FROM final JOIN truth USING (message_id) "
    "WHERE action <> true_action", "truth")
ORACLES["contract_checks"] = on_final(
    "SELECT 'missing_ids' AS \"check\", count(*) AS violations FROM messages WHERE message_id "
    "NOT IN (SELECT message_id FROM final) UNION ALL SELECT 'duplicate_ids', count(*) - "
    "count(DISTINCT message_id) FROM final UNION ALL SELECT 'action_domain', count(*) FILTER "
    f"(action NOT IN ({items(L.ACTIONS)})) FROM final UNION ALL SELECT 'type_domain', "
    f"count(*) FILTER (message_type NOT IN ({items(L.MESSAGE_TYPES)})) FROM final UNION ALL "
    "SELECT 'confidence_range', count(*) FILTER (confidence < 0 OR confidence > 1) FROM final "
    "UNION ALL SELECT 'empty_reason', count(*) FILTER (trim(reason) = '') FROM final UNION ALL "
    "SELECT 'evidence_format', count(*) FILTER (evidence_message_ids <> 'none' AND NOT "
    "regexp_full_match(evidence_message_ids, 'message_\\d+(;message_\\d+)*')) FROM final UNION "
    "ALL SELECT 'unsafe_not_muted', count(*) FILTER (message_type IN ('scam', 'spam') AND action "
    "<> 'mute') FROM final")

# --- model -----------------------------------------------------------------
_text_doubles = ", ".join(f"round(f.{n}::DOUBLE, 5) AS {n}" for n in L.TEXT_FEATURES)
_columns, _joins = history_select(
    ["sender", "topic", "user", "dismissals", "category", "business", "group"], 5)
ORACLES["feature_matrix"] = sql(
    f"SELECT i.message_id, {_text_doubles}, {_columns} FROM incoming i "
    f"JOIN feat f ON f.message_id = i.message_id {_joins}",
    "incoming", "history", "sender_stats", "user_stats", "category", "relations", "members",
    extra={**EVIDENCE, "alike": SIMILAR,
           "feat": text_features("incoming", "message_id", "message_text")})
ORACLES["label_index"] = sql(
    "SELECT true_action AS action, (dense_rank() OVER (ORDER BY true_action) - 1)::DOUBLE AS "
    "label_index, count(*) AS n FROM truth GROUP BY true_action", "truth")
ORACLES["stratified_split"] = sql(
    "SELECT message_id, true_action, row_number() OVER (PARTITION BY true_action ORDER BY "
    "md5('42:' || message_id), message_id) <= round(count(*) OVER (PARTITION BY true_action) "
    "* 0.2) AS is_test FROM truth", "truth")

# --- streams ---------------------------------------------------------------
ALL_NEEDS = ["messages", "accounts", "sender_stats", "category", "members"]
ORACLES["stream_route"] = sql(
    f"SELECT {OUT} FROM checked", *ALL_NEEDS,
    extra={**r.decided("messages", scored=False), **r.checked(None)})
ORACLES["stream_route_batches"] = sql(
    "SELECT * FROM routed", *ALL_NEEDS, "scored", "incoming", "history",
    extra={**EVIDENCE, **r.decided("incoming", scored=True), **r.checked("lists"),
           "consistent_input": "SELECT * FROM checked", "routed": r.CONSISTENT})
ORACLES["stream_sender_stats"] = sql("SELECT * FROM sender_stats", "sender_stats")
ORACLES["stream_daily_load"] = sql(
    "SELECT user_id, created_at::DATE::VARCHAR AS date, count(*) AS notifications_sent, "
    "sum(dismissed)::BIGINT AS notifications_dismissed FROM reactions GROUP BY ALL", "reactions")
ORACLES["stream_dedup"] = sql("SELECT message_id, user_id FROM messages", "messages")
