"""The traffic tables as DuckDB common table expressions."""

from __future__ import annotations

from beckon.plans.traffic import CUT, PHRASES
from oracles.words import s

_PHRASES = ", ".join(f"({i}, {s(p)})" for i, p in enumerate(PHRASES))

CTES = {
    "msg": f"""
      SELECT event_id, event_type, value, k, tail, message_id, user_id, conversation_type,
        CASE WHEN conversation_type <> 'business'
          THEN 'u_' || (u + 1 + event_id % 4) END AS sender_user_id,
        CASE WHEN conversation_type = 'group' THEN 'g_' || (event_id % (11 * (SELECT count(*) FROM nation))) END AS group_id,
        CASE WHEN conversation_type = 'business' THEN 'b_' || (event_id * 7 % (SELECT count(*) FROM supplier)) END AS business_id,
        ts AS created_at, media_type,
        CASE media_type
          WHEN 'image' THEN 'img_' || (event_id * 5 % (SELECT count(*) + count(*) // 4 FROM part))
          WHEN 'voice' THEN 'vn_' || (event_id * 3 % (SELECT count(*) + count(*) // 3 FROM customer))
          END AS media_id,
        CASE WHEN k < 70 THEN 0 ELSE k % 12 END AS forwarded_count,
        CASE WHEN event_id % 53 = 0
            OR (coalesce(media_type, '') = 'voice' AND event_id % 2 = 0)
            OR (coalesce(media_type, '') = 'image' AND event_id % 5 = 0) THEN NULL
          ELSE phrase || coalesce(' ' || tail, '') END AS message_text,
        ts < TIMESTAMP '{CUT}' AS past
      FROM (SELECT e.*, e.user_id AS u, c.text AS tail, p.phrase,
          regexp_extract(props, '[0-9]+')::INT AS k,
          'message_' || event_id AS message_id,
          ['personal', 'group', 'business'][event_id % 3 + 1] AS conversation_type,
          CASE event_id % 7 WHEN 3 THEN 'image' WHEN 5 THEN 'voice' END AS media_type
        FROM (SELECT * FROM events) e
        JOIN (VALUES {_PHRASES}) p(i, phrase) ON p.i = e.event_id % {len(PHRASES)}
        LEFT JOIN (SELECT conv_id, max(turn) + 1 AS turns FROM conversations GROUP BY ALL) n
          ON n.conv_id = e.event_id // 100
        LEFT JOIN conversations c
          ON c.conv_id = e.event_id // 100 AND c.turn = e.event_id % n.turns)""",
    "messages": "SELECT * REPLACE ('u_' || user_id AS user_id) FROM msg",
    "history": "SELECT * FROM messages WHERE past",
    "incoming": "SELECT * FROM messages WHERE NOT past",
    "reactions": """
      SELECT user_id, message_id, sender_user_id, conversation_type, created_at,
        (event_type IN ('click', 'view', 'purchase'))::INT AS opened,
        (event_type = 'purchase')::INT AS replied,
        (event_type IN ('error', 'signup'))::INT AS dismissed,
        (event_type = 'error' AND k >= 60)::INT AS reported
      FROM history""",
    "accounts": """
      SELECT 'b_' || s_suppkey AS business_id,
        cast(floor(abs(s_acctbal)) AS BIGINT) % 18 >= 15
          OR (s_suppkey % 3 = 0 AND s_suppkey % 10 <> 9 AND s_suppkey % 2 = 1
              AND s_suppkey * 13 % 365 < 90) AS high_risk_business
      FROM supplier""",
    "members": """
      SELECT 'g_' || g AS group_id, 'u_' || o_custkey AS user_id,
        (first % 9 = 0)::INT::DOUBLE AS is_group_admin, n::DOUBLE AS group_message_count,
        CASE WHEN reads > 0 THEN least(replies / reads, 1.0) ELSE 0.0 END::DOUBLE
          AS group_engagement_rate,
        (first % 7 = 0)::INT::DOUBLE AS group_is_muted
      FROM (SELECT o_custkey, o_orderkey % (11 * (SELECT count(*) FROM nation)) AS g, min(o_orderkey) AS first, count(*) AS n,
          count(*) FILTER (o_orderstatus <> 'O') AS reads,
          count(*) FILTER (o_orderpriority = '1-URGENT') AS replies
        FROM orders GROUP BY ALL)""",
    "relations": """
      SELECT 'u_' || o_custkey AS user_id, 'b_' || l_suppkey AS business_id,
        (min(o_orderpriority) IN ('1-URGENT', '2-HIGH', '3-MEDIUM'))::INT::DOUBLE
          AS has_recent_order,
        (l_suppkey % 2)::DOUBLE AS has_opted_in,
        (bool_or(l_returnflag = 'R'))::INT::DOUBLE AS has_opted_out,
        count(*)::DOUBLE AS business_interaction_count
      FROM lineitem JOIN orders ON o_orderkey = l_orderkey GROUP BY o_custkey, l_suppkey""",
    "sender_stats": """
      SELECT user_id, coalesce(sender_user_id, 'business') AS sender_key,
        count(*) AS message_count, sum(opened)::BIGINT AS opened,
        sum(replied)::BIGINT AS replied, sum(dismissed)::BIGINT AS dismissed,
        sum(reported)::BIGINT AS reported
      FROM reactions GROUP BY ALL""",
    "user_stats": """
      SELECT user_id, sum(opened)::BIGINT AS total_opens, sum(replied)::BIGINT AS total_replies,
        sum(dismissed)::BIGINT AS total_dismissed, sum(reported)::BIGINT AS total_reported,
        count(*) AS total_messages, sum(replied) / count(*) AS reply_rate,
        sum(opened) / count(*) AS open_rate,
        count(*) / count(DISTINCT created_at::DATE) AS avg_daily_notifications,
        sum(dismissed) / count(DISTINCT created_at::DATE) AS avg_daily_dismissals
      FROM reactions GROUP BY user_id""",
    "category": """
      SELECT user_id, conversation_type, avg(dismissed) AS category_dismiss_rate
      FROM reactions GROUP BY ALL""",
    "scored": """
      SELECT message_id, ['digest', 'mute', 'notify'][k % 3 + 1] AS model_action,
        (event_id % 1009) / 1008.0::DOUBLE AS model_probability FROM messages""",
    "truth": """
      SELECT message_id, CASE WHEN event_type IN ('purchase', 'click') THEN 'notify'
        WHEN event_type = 'view' THEN 'digest' ELSE 'mute' END AS true_action
      FROM messages""",
}


def sql(body: str, *names: str, extra: dict[str, str] | None = None) -> str:
    """``body`` with the named tables and whatever they need in front of it.

    ``extra`` may put other text in place of a table, such as enriched messages.
    """
    every = {**CTES, **(extra or {})}
    needs = {
        "messages": ["raw"] if "raw" in every else ["msg"], "raw": ["msg"], "history": ["messages"], "incoming": ["messages"],
        "reactions": ["history"], "sender_stats": ["reactions"], "user_stats": ["reactions"],
        "category": ["reactions"], "scored": ["messages"], "truth": ["messages"],
    }
    ordered: list[str] = []

    def add(name: str) -> None:
        for other in needs.get(name, []):
            add(other)
        if name not in ordered:
            ordered.append(name)

    for name in names:
        add(name)
    parts = [f"{n} AS MATERIALIZED ({every[n]})" for n in ordered]
    parts += [f"{n} AS MATERIALIZED ({text})" for n, text in (extra or {}).items()
              if n not in ordered]
    return f"WITH {', '.join(parts)} {body}" if parts else body
