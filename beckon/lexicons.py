"""Word lists, patterns and domains that fix the meaning of every text test.

Fixed values: results depend on each entry, so they are listed plainly and in
one place.  Lists that look alike (several scam, injection and calm-phrase
lists) belong to different operators and differ on purpose.
"""

# --- fixed values: output domains -----------------------------------------
ACTIONS = ["notify", "digest", "mute"]
MESSAGE_TYPES = [
    "personal", "urgent", "event", "payment", "business_update", "promotion",
    "greeting", "forward", "spam", "scam", "unknown",
]
ACTION_CLASSES = ["digest", "mute", "notify"]

# --- fixed values: names of the 28 text features, in model order ----------
TEXT_FEATURES = [
    "has_at_mention", "has_question", "at_mention_with_question",
    "char_count", "word_count", "sentence_count",
    "has_url", "has_phone", "has_email",
    "has_specific_time", "has_today", "has_now", "has_deadline",
    "urgency_keyword_count", "has_negation_of_urgency",
    "scam_keyword_count", "has_instruction_injection",
    "caps_word_ratio", "has_excessive_punctuation", "spam_pattern_score",
    "has_suspicious_link", "time_specificity", "same_day_indicator",
    "flexible_timing", "has_frustration", "has_gratitude", "has_greeting",
    "forward_indicator_count",
]

# --- fixed values: names of the 21 history features, in model order -------
HISTORY_FEATURES = [
    "sender_message_count", "sender_reply_rate", "sender_open_rate",
    "sender_dismiss_rate", "sender_report_count", "sender_trust_score",
    "topic_similarity",
    "user_total_opens", "user_total_replies", "user_reply_rate",
    "user_notification_load",
    "similar_dismissals", "category_dismiss_rate",
    "has_recent_order", "has_opted_in", "has_opted_out",
    "business_interaction_count",
    "is_group_admin", "group_message_count", "group_engagement_rate",
    "group_is_muted",
]

# --- fixed values: columns that are never model features ------------------
METADATA_COLUMNS = [
    "message_id", "user_id", "conversation_type", "group_id", "business_id",
    "sender_user_id", "created_at", "message_text", "media_type", "media_id",
    "forwarded_count", "action", "message_type", "reason", "confidence",
    "evidence_message_ids",
]

# --- fixed values: relation kinds that count as a recent order ------------
RECENT_ORDER_RELATIONS = [
    "recent_grocery_delivery", "recent_food_delivery",
    "active_sale_subscription", "active_bank_account",
]

# --- fixed values: patterns of the text features --------------------------
URL = r"https?://[^\s]+"
PHONE = (r"(?:\+\d{1,3}[-.\s]?)?(?:\(\d{1,4}\)|\d{1,4})[-.\s]?"
         r"\d{1,4}[-.\s]?\d{1,4}[-.\s]?\d{1,9}")
EMAIL = r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Z|a-z]{2,}\b"
CLOCK_TIME = r"\b\d{1,2}:\d{2}\s*(?:am|pm|AM|PM)?\b"
MINUTES = r"\b\d+\s*(?:min|mins|minute|minutes)\b"
HOURS = r"\b\d+\s*(?:hour|hours|hr|hrs)\b"
DEADLINE = r"\b(?:before\s+eod|by\s+\d+|deadline|due\s+(?:date|by|on))\b"
URGENCY_NEGATION = (r"\b(?:no\s+need|no\s+pressure|whenever\s+you|no\s+rush|"
                    r"not\s+urgent|nothing\s+urgent|nothing\s+dramatic|"
                    r"take\s+your\s+time|at\s+your\s+convenience)\b")
INJECTION = (r"\b(?:ignore\s+previous|disregard\s+(?:previous|all)|"
             r"forget\s+your|override\s+instructions?|"
             r"new\s+instructions?:\s*\w+)\b")
SHORT_LINK = (r"https?://(?:bit\.ly|tinyurl\.com|goo\.gl|ow\.ly|"
              r"t\.co|buff\.ly|adf\.ly|is\.gd|cli\.gs)/[^\s]+")
RISKY_LINK = (r"https?://[^\s]*(?:\.tk|\.ml|\.ga|\.cf|\.gq|"
              r"login|verify|secure|update|account)[^\s]*")
SAME_DAY = (r"\b(?:tonight|today|this\s+evening|this\s+afternoon|"
            r"this\s+morning|later\s+today)\b")
FLEXIBLE = (r"\b(?:whenever|no\s+rush|when\s+(?:you\s+)?free|"
            r"at\s+your\s+convenience|when\s+(?:you\s+)?can)\b")
FRUSTRATION = (r"\b(?:not\s+working|broken|issue|problem|error|failed|failing|"
               r"won't\s+work|doesn't\s+work|"
               r"can't\s+(?:access|login|open)|stuck)\b")
GRATITUDE = (r"\b(?:thank\s+you|thanks|appreciate|grateful|"
             r"much\s+appreciated|thx|ty)\b")
GREETING = (r"\b(?:good\s+morning|good\s+afternoon|good\s+evening|"
            r"hello|hi|hey|greetings)\b")
FORWARDED = r"(?:\bfwd:|forwarded\s+message|share\s+with|please\s+share|forward\s+to)"
SENTENCE_BREAK = r"[.!?]+\s+"
CAPS_WORD = r"\b[A-Z]{3,}\b"
LOUD_PUNCTUATION = r"[!?]{2,}"

# --- fixed values: keyword lists of the text features ---------------------
URGENCY_WORDS = ["urgent", "important", "quick", "asap", "immediately",
                 "priority", "critical", "emergency", "now", "hurry"]
SCAM_WORDS = ["otp", "password", "verify", "blocked", "expire", "expires",
              "confirm", "alert", "suspended", "unauthorized", "unusual",
              "activity", "security", "locked", "update", "immediately"]
SCAM_PHRASES = ["click here", "verify account", "confirm identity"]
SPECIFIC_TIME_PARTS = ["at", "by", "before", "after", "exactly", "sharp",
                       "minutes", "hours", "o'clock", "am", "pm"]
VAGUE_TIME_PARTS = ["soon", "later", "sometime", "eventually", "maybe",
                    "possibly", "perhaps", "flexible"]

# --- fixed values: guardrail ----------------------------------------------
GUARD_PHRASES = [
    "ignore previous instructions", "ignore all instructions",
    "ignore all previous", "ignore sender risk", "ignore the routing",
    "system prompt", "you are now a", "mark this as notify",
    "mark this message as notify", "mark this as digest", "mark this as mute",
    "classify as notify", "set action to notify", "route as notify",
    "routing override", "internal router metadata",
    "system note for the notification router", "assistant instruction",
    "router instruction", "actual message:", "override the routing",
    "change the classification",
]

# --- fixed values: rule cascade -------------------------------------------
RULE_SCAM_WORDS = [
    "otp", "password", "verify", "blocked", "expire", "confirm", "account",
    "security", "alert", "suspend", "urgent", "immediate", "click", "link",
    "login", "credential", "code", "pin", "leak", "batao", "hold", "wallet",
    "payout", "reward", "claim",
]
RULE_SCAM_PHRASES = ["processing fee", "reactivation fee", "verification code"]
RULE_SCAM_LINK = r"(?:http|www\.|\.\w{2,3}(?:/|$))"
RULE_SCAM_VERIFY = ["verify", "confirm", "otp", "password"]
RULE_SCAM_PRESSURE = ["blocked", "expire", "suspend"]
RULE_SPAM_PHRASES = ["CLICK HERE", "LIMITED TIME", "ACT NOW", "HURRY",
                     "WON'T WAIT", "EXCLUSIVE OFFER", "FREE"]
RULE_SPAM_PERCENT = r"\d+%\s*OFF"
RULE_URGENT_PARTS = ["urgent", "asap", "immediately", "right now", "before eod",
                     "deadline", "emergency", "critical", "escalation"]
RULE_TIME_CONTEXT = ["heads-up", "quick", "leaving early", "change for today",
                     "heads up", "last-minute", "just now", "leaving soon",
                     "waiting", "can wait", "max", "hurry"]
RULE_TIME_PATTERNS = [
    r"\d+\s*mins?(?:\s+max)?",
    r"\d{1,2}:\d{2}",
    r"before\s+\d+",
    r"before\s+eod",
    r"in\s+\d+\s+(?:min|hour|hr)",
    r"by\s+\d+",
    r"after\s+\d+",
    r"(?:reach|arrive|come|be\s+there)\s+by\s+\w+",
    r"(?:moved|shifted|changed)\s+to\s+\w+\s+(?:fifteen|thirty|forty|forty five|am|pm)",
    r"(?:pickup|pick\s*up)\s+(?:will|has|is)",
]
RULE_CALM = [
    "nothing urgent", "not urgent", "no rush", "no pressure",
    "nothing dramatic", "no need to respond", "whenever you",
    "take your time", "no hurry", "no need to reply", "no need to call",
    "if you get time", "if you get a chance", "if you get a sec",
    "when you get a chance", "nothing blocking", "when you can",
    "at your convenience", "no deadline", "just checking in",
]
RULE_CHAIN = [
    "forward to", "share with", "send to ten", "forward to ten",
    "fwd as received", "sharing here", "blessings", "good vibes",
    "stay positive", "keep smiling", "luck changes when you share",
    "positive energy", "bhagwan", "forward this", "share kar",
]
RULE_TRANSACTIONAL = [
    "refund", "payout", "order", "delivery", "booking", "payment processed",
    "payment failed", "could not be processed", "transaction", "invoice",
    "receipt", "statement", "scheduled for", "has been shipped", "dispatched",
]
RULE_SELLER = ["selling", "jacket", "kurta", "collect it", "interested",
               "dm if", "price", "bought", "asking"]
RULE_LOGISTICS = ["transport", "school", "bus", "driver", "reach by",
                  "arrive by", "moved to", "shifted to", "changed to",
                  "instead of the main"]
RULE_INJECTION_PATTERNS = [
    r"ignore\s+(?:all\s+)?previous\s+(?:rules|routing|instructions)",
    r"ignore\s+(?:the\s+)?routing",
    r"ignore\s+sender\s+risk",
    r"mark\s+this\s+(?:message\s+)?as\s+(?:notify|digest|mute)",
    r"classify\s+this\s+as\s+(?:notify|digest|mute|urgent)",
    r"route\s+as\s+notify",
    r"set\s+action\s+to\s+(?:notify|digest|mute)",
    r"override\s+(?:the\s+)?routing",
    r"change\s+(?:the\s+)?classification",
    r"routing\s+override",
    r"internal\s+router\s+metadata",
    r"system\s+note\s+for\s+the\s+notification\s+router",
    r"assistant\s+instruction",
    r"router\s+instruction",
    r"actual\s+message:",
    r"always\s+mark\s+this\s+as",
]
USER_MENTION = r"@u_\d+"

# --- fixed values: type inference -----------------------------------------
# "login code" is listed twice and so weighs two
TYPE_SCAM = [
    "otp", "password", "verification code", "login code", "verify now",
    "account-login", "wallet verification", "blocked", "routing rules",
    "workspace access", "account locked", "expire today", "suspended",
    "profile will be restricted", "login code", "send the code",
    "reply with the", "confirm your pin", "share your otp",
    "account will be blocked", "processing fee", "pay the processing fee",
    "claim your reward", "selected for reward", "account hold",
    "hold pe chala", "verification nahi", "otp abhi batao",
    "wallet and card details", "payout profile", "share your account",
    "sharing account number", "send account details", "sharing your account",
    "sharing your account number", "claim benefits",
]
TYPE_SCAM_ALWAYS = ["ignore all previous", "reply with the otp"]
TYPE_INJECTION = [
    "ignore all previous", "ignore all instructions",
    "ignore previous instructions", "ignore sender risk",
    "mark this as notify", "mark this as digest", "mark this as mute",
    "classify as notify", "classify as urgent", "routing override",
    "internal router metadata", "system note for the notification router",
    "assistant instruction", "router instruction", "actual message:",
    "override the routing", "change the classification",
    "always mark this as", "set action to",
]
TYPE_MENTION_CASUAL = ["when you get", "if you get", "no rush",
                       "nothing urgent", "nothing dramatic", "no pressure",
                       "whenever", "no need", "just checking"]
TYPE_CALM = [
    "nothing urgent", "not urgent", "no rush", "no pressure",
    "nothing dramatic", "no need to respond", "no need to reply",
    "no need to call", "whenever you", "take your time", "no hurry",
    "if you get time", "if you get a chance", "if you get a sec",
    "when you get a chance", "just checking in", "nothing blocking",
    "when you can", "at your convenience", "no deadline",
]
TYPE_UNKNOWN_SENDER = ["found your number", "got this number",
                       "volunteer sheet", "got this number from"]
TYPE_PAYMENT = ["payment due", "refund", "amount due", "card statement",
                "pay ", "paid", "invoice", "bill", "reward points",
                "payment date", "processing fee", "payment reminder",
                "charge pending", "reactivation fee", "renewal fee"]
TYPE_PAYMENT_ADVISORY = ["safety advisory", "never ask for otp",
                         "never ask for payment", "do not share"]
TYPE_GREETING = ["good morning", "good evening", "good vibes",
                 "stay positive", "blessings", "keep smiling"]
TYPE_PROMOTION_SAFETY = [
    "safety advisory", "never ask for otp", "never ask for payment",
    "advisory image", "do not share", "maintenance", "society app",
    "service lift", "security alert", "gate band", "lift maintenance",
    "fire alarm test", "circular", "consent", "field trip", "registration",
    "pottery workshop", "workshop",
]
TYPE_PROMOTION_WORDS = [
    "off", "offer", "discount", "sale", "limited", "unsubscribe", "selling",
    "price", "rs", "itinerary", "travel deal", "plot", "token", "shop",
    "shopping", "viewed", "benefit", "kurta", "cashback", "book now",
    "buy now", "welcome offer",
]
TYPE_PROMOTION_PERCENT = ["50%", "40%"]
TYPE_EVENT = [
    "bus", "school", "circular", "consent", "field trip", "cultural night",
    "form is open", "registrations", "internship approval",
    "fire alarm test", "sync is still on", "meeting", "review got pulled",
    "appointment", "scheduled time", "faculty", "maintenance", "society",
    "field-trip list", "client meeting", "standup",
]
TYPE_EVENT_NOT_BUSINESS = ["pickup", "airport"]
TYPE_URGENT_CASUAL = ["when you get", "if you get", "can you call", "no rush",
                      "nothing urgent", "nothing dramatic", "no pressure",
                      "whenever", "no need"]
TYPE_URGENT = [
    "urgent", "asap", "emergency", "escalation", "in 20 minutes",
    "next 10 minutes", "before eod", "deadline", "cannot wait",
    "in 30 minutes", "next 30 minutes", "alert threshold", "incident",
    "failing", "spiking", "join now", "bridge now", "please join",
    "right now", "immediately", "call me now", "call now",
    "come immediately", "reach now",
]
TYPE_BUSINESS_UPDATE = ["order", "delivery", "pickup", "statement", "account",
                        "booking", "ticket", "advisory", "update", "review",
                        "safety advisory"]
TYPE_SPAM = ["click here", "act now", "forward to ten", "chain"]

# --- fixed values: verifier -----------------------------------------------
VERIFY_SCAM = ["scam", "phishing", "otp request", "injection",
               "router-manipulation", "manipulation attempt"]
VERIFY_SPAM = ["spam filtered", "aggressive promotional spam", "spam content"]
VERIFY_FORWARD = ["forwarded", "chain content"]
VERIFY_PROMOTION = ["promotional", "marketing"]
VERIFY_PAYMENT = "payment notification"

# --- fixed values: English function words left out of TF-IDF terms --------
STOP_WORDS = [
    "a", "about", "after", "again", "all", "also", "am", "an", "and", "any",
    "are", "as", "at", "be", "because", "been", "before", "being", "but",
    "by", "can", "could", "did", "do", "does", "down", "each", "few", "for",
    "from", "had", "has", "have", "he", "her", "here", "hers", "him", "his",
    "how", "if", "in", "into", "is", "it", "its", "just", "me", "more",
    "most", "my", "no", "nor", "not", "of", "off", "on", "once", "only",
    "or", "other", "our", "out", "over", "own", "same", "she", "should",
    "so", "some", "such", "than", "that", "the", "their", "them", "then",
    "there", "these", "they", "this", "those", "to", "too", "under", "up",
    "very", "was", "we", "were", "what", "when", "where", "which", "while",
    "who", "why", "will", "with", "would", "you", "your",
]
