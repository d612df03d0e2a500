"""Text features and phrase sets against plain Python."""

import random
import re

import pytest
from pyspark.sql import functions as F

from beckon import lexicons as L
from beckon.functions.match import PhraseSet
from beckon.functions.text import with_text_features

TEXTS = [
    "@lee can you check this by 4 pm? It's urgent!!", "", "   ", None, "Thanks, no rush at all",
    "FWD: your account is BLOCKED. Click here to verify account now!!!",
    "Meet at 10:45 or in 20 mins. Maybe later... see http://bit.ly/ab?",
    "énow now naïve NOW end ", "call +1 (555) 010-9999 or mail a.b@c.org",
    "Dinner tonight? The oven is not working,\n\nso we can't open it. Thx",
    "please share with all: forwarded message", "https://safe.example/login today",
]


def expected(text):
    t = text or ""
    low, st = t.lower(), t.strip()

    def find(p, s=t, f=re.I):
        return bool(re.search(p, s, f))

    words = len(st.split())
    pieces = [p for p in re.split(L.SENTENCE_BREAK, st) if p.strip()]
    clock, mins, hours = find(L.CLOCK_TIME, f=0), find(L.MINUTES), find(L.HOURS)
    scam = sum(len(re.findall(rf"\b{w}\b", t, re.I)) for w in L.SCAM_WORDS)
    scam += sum(low.count(p) for p in L.SCAM_PHRASES)
    caps = len(re.findall(L.CAPS_WORD, t)) / words if words else 0.0
    loud = find(L.LOUD_PUNCTUATION)
    spec = clock + mins + hours + find(L.DEADLINE) + any(w in low for w in L.SPECIFIC_TIME_PARTS)
    vague = int(any(w in low for w in L.VAGUE_TIME_PARTS))
    return {
        "has_at_mention": "@" in t, "has_question": "?" in t,
        "at_mention_with_question": "@" in t and "?" in t, "char_count": len(st),
        "word_count": words, "sentence_count": len(pieces) or (1 if st else 0),
        "has_url": find(L.URL), "has_phone": find(L.PHONE), "has_email": find(L.EMAIL, f=0),
        "has_specific_time": clock or mins or hours, "has_today": find(r"\btoday\b", low),
        "has_now": find(r"\bnow\b", low), "has_deadline": find(L.DEADLINE),
        "urgency_keyword_count": sum(len(re.findall(rf"\b{w}\b", t, re.I))
                                     for w in L.URGENCY_WORDS),
        "has_negation_of_urgency": find(L.URGENCY_NEGATION), "scam_keyword_count": scam,
        "has_instruction_injection": find(L.INJECTION), "caps_word_ratio": caps,
        "has_excessive_punctuation": loud,
        "spam_pattern_score": ((caps > 0.3) + loud + (scam >= 3)) / 3,
        "has_suspicious_link": find(L.SHORT_LINK) or find(L.RISKY_LINK),
        "time_specificity": spec / (spec + vague) if spec + vague else 0.5,
        "same_day_indicator": find(L.SAME_DAY), "flexible_timing": find(L.FLEXIBLE),
        "has_frustration": find(L.FRUSTRATION), "has_gratitude": find(L.GRATITUDE),
        "has_greeting": find(L.GREETING),
        "forward_indicator_count": len(re.findall(L.FORWARDED, t, re.I)),
    }


def test_all_features_match_python(spark):
    df = spark.createDataFrame(list(enumerate(TEXTS)), "i int, message_text string")
    rows = with_text_features(df).collect()
    assert len(rows) == len(TEXTS)
    for row in rows:
        want = expected(row["message_text"])
        got = {k: row[k] for k in L.TEXT_FEATURES}
        assert got == pytest.approx(want), row["message_text"]


def test_phrase_set_is_exact_on_random_texts(spark):
    rng = random.Random(7)
    phrases = ["ab", "abc", "abcd", "bc", "c a", "ca", "d?", "b", "aa", "@u_"]
    texts = ["".join(rng.choices("abcd @u_?", k=rng.randint(0, 14))) for _ in range(300)]
    seen = PhraseSet("seen", phrases)
    df = spark.createDataFrame([(t,) for t in texts], "t string").withColumn(
        "seen", F.expr(seen.found("t")))
    some = ["abc", "ca", "d?"]
    rows = df.select("t", F.expr(seen.any_of(some)).alias("some"),
                     F.expr(seen.hits(phrases + ["b"])).alias("n")).collect()
    for row in rows:
        assert row["some"] == any(p in row["t"] for p in some), row["t"]
        assert row["n"] == sum(p in row["t"] for p in phrases + ["b"]), row["t"]
