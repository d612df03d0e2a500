"""Text tests in DuckDB SQL, written apart from the Spark expressions.

DuckDB's word boundary knows ASCII only, so bounded words are found among the
tokens of a text, or between explicit non-word characters.
"""

from __future__ import annotations

from beckon import lexicons as L

W = r"[\p{L}\p{N}_]"
NOT_W = r"[^\p{L}\p{N}_]"
BLANKS = ("chr(32)||chr(9)||chr(10)||chr(11)||chr(12)||chr(13)||chr(28)||chr(29)||chr(30)"
          "||chr(31)||chr(133)||chr(160)||chr(5760)||chr(8192)||chr(8193)||chr(8194)"
          "||chr(8195)||chr(8196)||chr(8197)||chr(8198)||chr(8199)||chr(8200)||chr(8201)"
          "||chr(8202)||chr(8232)||chr(8233)||chr(8239)||chr(8287)||chr(12288)")


def s(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def items(values) -> str:
    return ", ".join(s(v) for v in values)


def has(col: str, phrases) -> str:
    """Any phrase as a substring."""
    return "(" + " OR ".join(f"contains({col}, {s(p)})" for p in phrases) + ")"


def n_has(col: str, phrases) -> str:
    return "(" + " + ".join(f"contains({col}, {s(p)})::INT" for p in phrases) + ")"


def rx(col: str, pattern: str, nocase: bool = False) -> str:
    return f"regexp_matches({col}, {s(('(?i)' if nocase else '') + pattern)})"


def between(pattern: str) -> str:
    """The pattern with non-word characters or the ends around it."""
    return f"(?:^|{NOT_W})(?:{pattern})(?:$|{NOT_W})"


def tokens(col: str) -> str:
    return f"regexp_extract_all({col}, {s(W + '+')})"


def n_tokens(low: str, words) -> str:
    return f"len(list_filter({tokens(low)}, lambda x: x IN ({items(words)})))"


def word_in(low: str, words) -> str:
    single = [w for w in words if " " not in w]
    parts = [f"len(list_intersect({tokens(low)}, [{items(single)}])) > 0"] if single else []
    parts += [rx(low, between(w)) for w in words if " " in w]
    return "(" + " OR ".join(parts) + ")"


def strip(col: str) -> str:
    return f"trim({col}, {BLANKS})"


def text_features(source: str, key: str, text: str) -> str:
    """SELECT of the key columns and all 28 features, unrounded."""
    t, low = "t", "low"
    deadline = r"before\s+eod|by\s+\d+|deadline|due\s+(?:date|by|on)"
    return f"""
    SELECT {key},
      has_at_mention, has_question, has_at_mention AND has_question AS at_mention_with_question,
      char_count, word_count, sentence_count, has_url, has_phone, has_email,
      (c1 OR c2 OR c3) AS has_specific_time, has_today, has_now, has_deadline,
      urgency_keyword_count, has_negation_of_urgency, scam_keyword_count,
      has_instruction_injection,
      CASE WHEN word_count > 0 THEN caps / word_count ELSE 0.0 END::DOUBLE AS caps_word_ratio,
      has_excessive_punctuation,
      ((word_count > 0 AND caps / greatest(word_count, 1) > 0.3)::INT
        + has_excessive_punctuation::INT + (scam_keyword_count >= 3)::INT) / 3.0::DOUBLE
        AS spam_pattern_score,
      has_suspicious_link,
      CASE WHEN spec + vague > 0 THEN spec / (spec + vague)::DOUBLE ELSE 0.5::DOUBLE END
        AS time_specificity,
      same_day_indicator, flexible_timing, has_frustration, has_gratitude, has_greeting,
      forward_indicator_count
    FROM (SELECT *,
      c1::INT + c2::INT + c3::INT + has_deadline::INT + {has(low, L.SPECIFIC_TIME_PARTS)}::INT
        AS spec, {has(low, L.VAGUE_TIME_PARTS)}::INT AS vague
    FROM (SELECT *,
      contains(t, '@') AS has_at_mention, contains(t, '?') AS has_question,
      length(st) AS char_count, len({tokens_nonblank(t)}) AS word_count,
      CASE WHEN st = '' THEN 0 ELSE greatest(1, len(list_filter(
        regexp_split_to_array(st, '[.!?]+\\s+'), lambda p: {strip('p')} <> ''))) END
        AS sentence_count,
      {rx(t, 'https?://[^\\s]+', True)} AS has_url,
      {rx(t, '(?:\\+\\d{1,3}[-.\\s]?)?(?:\\(\\d{1,4}\\)|\\d{1,4})[-.\\s]?'
             '\\d{1,4}[-.\\s]?\\d{1,4}[-.\\s]?\\d{1,9}')} AS has_phone,
      {rx(t, L.EMAIL)} AS has_email,
      {rx(t, f'(?:^|{NOT_W})\\d{{1,2}}:\\d{{2}}(?:$|{NOT_W}|(?:am|pm|AM|PM)(?:$|{NOT_W}))')}
        AS c1,
      {rx(t, between('\\d+\\s*(?:min|mins|minute|minutes)'), True)} AS c2,
      {rx(t, between('\\d+\\s*(?:hour|hours|hr|hrs)'), True)} AS c3,
      list_contains({tokens(low)}, 'today') AS has_today,
      list_contains({tokens(low)}, 'now') AS has_now,
      {rx(t, between(deadline), True)} AS has_deadline,
      {n_tokens(low, L.URGENCY_WORDS)} AS urgency_keyword_count,
      {rx(t, between(L.URGENCY_NEGATION.replace(chr(92) + 'b', '')), True)}
        AS has_negation_of_urgency,
      {n_tokens(low, L.SCAM_WORDS)} + {" + ".join(
          f"(length(low) - length(replace(low, {s(p)}, ''))) // {len(p)}"
          for p in L.SCAM_PHRASES)} AS scam_keyword_count,
      {rx(t, between('ignore\\s+previous|disregard\\s+(?:previous|all)|forget\\s+your|'
                     'override\\s+instructions?|new\\s+instructions?:\\s*' + W + '+'), True)}
        AS has_instruction_injection,
      len(list_filter({tokens(t)}, lambda x: regexp_full_match(x, '[A-Z]{{3,}}')))::DOUBLE
        AS caps,
      {rx(t, '[!?]{2,}')} AS has_excessive_punctuation,
      {rx(t, L.SHORT_LINK, True)} OR {rx(t, L.RISKY_LINK, True)} AS has_suspicious_link,
      {rx(t, between(L.SAME_DAY.replace(chr(92) + 'b', '')), True)} AS same_day_indicator,
      {rx(t, between(L.FLEXIBLE.replace(chr(92) + 'b', '')), True)} AS flexible_timing,
      {rx(t, between(L.FRUSTRATION.replace(chr(92) + 'b', '')), True)} AS has_frustration,
      {rx(t, between(L.GRATITUDE.replace(chr(92) + 'b', '')), True)} AS has_gratitude,
      {rx(t, between(L.GREETING.replace(chr(92) + 'b', '')), True)} AS has_greeting,
      len(regexp_extract_all(low, '(?:(?:^|{NOT_W})fwd:|forwarded\\s+message|share\\s+with|'
        || 'please\\s+share|forward\\s+to)')) AS forward_indicator_count
    FROM (SELECT *, lower(t) AS low, {strip('t')} AS st
          FROM (SELECT *, coalesce({text}, '') AS t FROM {source}))))"""


def tokens_nonblank(col: str) -> str:
    return f"regexp_extract_all({col}, '\\S+')"


def rounded(select: str, names, key: str, digits: int = 6) -> str:
    """Round the double columns among the 28 features."""
    doubles = {"caps_word_ratio", "spam_pattern_score", "time_specificity"}
    cols = ", ".join(f"round({n}, {digits}) AS {n}" if n in doubles else n for n in names)
    return f"SELECT {key}, {cols} FROM ({select})"
