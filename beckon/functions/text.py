"""The 28 text features of a message, as row-local column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from beckon import lexicons as L
from beckon.functions.match import (
    UNICODE, PhraseSet, bounded, count_matches, count_substring, filled, matches, quoted,
    stripped,
)

_T, _LOW, _STRIPPED, _SEEN = "_text", "_lowered", "_stripped", "_seen"

# literals without which a pattern cannot match
NEEDS = {
    "url": ["http://", "https://"],
    "minutes": ["min"],
    "hours": ["hour", "hr"],
    "today": ["today"],
    "now": ["now"],
    "deadline": ["before", "by", "deadline", "due"],
    "negation": ["need", "pressure", "whenever", "rush", "urgent", "dramatic", "time",
                 "convenience"],
    "injection": ["ignore", "disregard", "forget", "override", "instruction"],
    "same_day": ["tonight", "today", "this"],
    "flexible": ["when", "rush", "convenience"],
    "frustration": ["work", "broken", "issue", "problem", "error", "fail", "can't", "stuck"],
    "gratitude": ["thank", "appreciate", "grateful", "thx", "ty"],
    "greeting": ["good", "hello", "hi", "hey", "greetings"],
    "forwarded": ["fwd:", "forward", "share"],
}
SEEN = PhraseSet(_SEEN, *NEEDS.values(), L.URGENCY_WORDS, L.SCAM_WORDS, L.SCAM_PHRASES,
                 L.SPECIFIC_TIME_PARTS, L.VAGUE_TIME_PARTS)


def _count_if(test: str, count: str) -> str:
    return f"if({test}, {count}, 0)"


def _base(seen: PhraseSet) -> dict[str, str]:
    """Features that depend on the text alone."""
    def flag(pattern: str, need: str) -> str:
        return matches(_T, pattern, nocase=True, needs=seen.any_of(NEEDS[need]))

    pieces = (f"filter(split({_STRIPPED}, {quoted(UNICODE + L.SENTENCE_BREAK)}), "
              f"piece -> {stripped('piece')} != '')")
    urgency = count_matches(_T, bounded(L.URGENCY_WORDS), nocase=True)
    scam_words = count_matches(_T, bounded(L.SCAM_WORDS), nocase=True)
    scam_phrases = " + ".join(
        _count_if(seen.any_of([p]), count_substring(_LOW, p)) for p in L.SCAM_PHRASES)
    return {
        "has_at_mention": f"contains({_T}, '@')",
        "has_question": f"contains({_T}, '?')",
        "char_count": f"bigint(length({_STRIPPED}))",
        "word_count": count_matches(_T, r"\S+"),
        "sentence_count": f"bigint(if({_STRIPPED} = '', 0, greatest(size({pieces}), 1)))",
        "has_url": flag(L.URL, "url"),
        "has_phone": matches(_T, L.PHONE, needs=matches(_T, r"\d")),
        "has_email": matches(_T, L.EMAIL, needs=["@"]),
        "_clock": matches(_T, L.CLOCK_TIME, needs=[":"]),
        "_minutes": flag(L.MINUTES, "minutes"),
        "_hours": flag(L.HOURS, "hours"),
        "has_today": matches(_LOW, bounded(["today"]), needs=seen.any_of(NEEDS["today"])),
        "has_now": matches(_LOW, bounded(["now"]), needs=seen.any_of(NEEDS["now"])),
        "has_deadline": flag(L.DEADLINE, "deadline"),
        "urgency_keyword_count": _count_if(seen.any_of(L.URGENCY_WORDS), urgency),
        "has_negation_of_urgency": flag(L.URGENCY_NEGATION, "negation"),
        "scam_keyword_count":
            f"{_count_if(seen.any_of(L.SCAM_WORDS), scam_words)} + {scam_phrases}",
        "has_instruction_injection": flag(L.INJECTION, "injection"),
        "_caps_words": count_matches(_T, L.CAPS_WORD),
        "has_excessive_punctuation": matches(_T, L.LOUD_PUNCTUATION),
        "has_suspicious_link": f"({flag(L.SHORT_LINK, 'url')} OR {flag(L.RISKY_LINK, 'url')})",
        "_time_part": seen.any_of(L.SPECIFIC_TIME_PARTS),
        "_vague_part": seen.any_of(L.VAGUE_TIME_PARTS),
        "same_day_indicator": flag(L.SAME_DAY, "same_day"),
        "flexible_timing": flag(L.FLEXIBLE, "flexible"),
        "has_frustration": flag(L.FRUSTRATION, "frustration"),
        "has_gratitude": flag(L.GRATITUDE, "gratitude"),
        "has_greeting": flag(L.GREETING, "greeting"),
        "forward_indicator_count": _count_if(
            seen.any_of(NEEDS["forwarded"]), count_matches(_T, L.FORWARDED, nocase=True)),
    }


def _derived() -> dict[str, str]:
    """Features computed from other features."""
    caps = "if(word_count > 0, _caps_words / word_count, 0.0D)"
    specific = ("(int(_clock) + int(_minutes) + int(_hours) + int(has_deadline) "
                "+ int(_time_part))")
    dated = f"({specific} + int(_vague_part))"
    return {
        "at_mention_with_question": "has_at_mention AND has_question",
        "has_specific_time": "_clock OR _minutes OR _hours",
        "caps_word_ratio": caps,
        "spam_pattern_score": f"(int({caps} > 0.3D) + int(has_excessive_punctuation) "
                              "+ int(scam_keyword_count >= 3)) / 3",
        "time_specificity": f"if({dated} > 0, {specific} / {dated}, 0.5D)",
    }


def _columns(texts: dict[str, str]) -> dict[str, Column]:
    return {name: F.expr(text) for name, text in texts.items()}


def with_text_features(df: DataFrame, text_col: str = "message_text",
                       features: list[str] | None = None, seen: PhraseSet = SEEN) -> DataFrame:
    """Add text features; only those asked for are computed.

    The plan is four projections over the input and stays in one stage.
    Catalyst drops the expressions of features that are not selected.  Where ``df`` has the
    column of ``seen``, a set that holds all phrases of ``SEEN``, the text is not searched again.
    """
    wanted = L.TEXT_FEATURES if features is None else features
    raw = filled(f"`{text_col}`")
    staged = df.withColumns(_columns({
        _T: raw, _LOW: f"lower({raw})", _STRIPPED: stripped(raw)}))
    if seen.column not in df.columns:
        staged = staged.withColumn(seen.column, F.expr(seen.found(_LOW)))
    staged = staged.withColumns(_columns(_base(seen))).withColumns(_columns(_derived()))
    return staged.select(*df.columns, *wanted)
