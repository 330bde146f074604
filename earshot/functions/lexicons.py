"""Word lists, weights and presets, kept as data.

Every operator takes these as overridable arguments; nothing below is hard-wired into a plan.
"""

from __future__ import annotations

import re
from collections.abc import Iterable

# ---------------------------------------------------------------------------
# Results depend on these being exactly as written.
# ---------------------------------------------------------------------------

VALID_SEVERITY = ("Low", "Medium", "High")
VALID_SENTIMENT = ("Positive", "Neutral", "Negative")

WEAK_LANGUAGE_MARKERS = (
    "hai", "hain", "nahi", "nahin", "nai", "kya", "kyun", "kyu", "kaise", "kaisa", "kaisi", "acha", "achha",
    "theek", "thik", "bohat", "bahut", "zyada", "kam", "sahi", "namaz", "namaaz", "roza", "hadees", "hadith",
    "tafseer", "tafsir", "tarjuma", "masla", "masail", "dua", "duaa", "allah", "rabb", "nabi", "please", "plz",
    "app", "apk", "krna", "karna", "krty", "krte", "hota", "hoti", "raha", "rahi", "gya", "gyi", "mein", "main",
    "mai", "tum", "aap", "hum", "jazak", "jazakallah", "mashallah", "mashaallah", "alhamdulillah", "inshallah",
    "asalam", "salam", "wassalam",
)
STRONG_LANGUAGE_MARKERS = (
    "hai", "hain", "nahi", "nahin", "kaise", "kaisa", "bohat", "bahut", "namaz", "namaaz", "hadees", "tafseer",
    "tarjuma", "masla", "dua", "krna", "karna", "hota", "hoti", "mein", "jazakallah", "mashallah",
    "alhamdulillah", "inshallah",
)

RISK_SIGNALS = {
    "payment": (
        "subscription", "premium", "paid", "payment", "pay", "refund", "charge", "charged", "billing",
        "renew", "renewal", "card", "jazzcash", "easypaisa", "invoice", "trial",
    ),
    "trust": (
        "wrong", "incorrect", "error", "fake", "authentic", "inauthentic", "misleading",
        "reference", "dalil", "proof", "sahih", "zaeef", "daif", "weak", "haram", "halal",
        "ghalat", "galat", "behuda", "adult", "vulgar", "inappropriate",
    ),
    "blocker": (
        "crash", "hang", "stuck", "freeze", "frozen", "not work", "doesn't work", "won't open",
        "load fail", "blank screen", "error", "failed", "otp", "login issue", "can't login",
        "nahi chal", "band ho", "ruk jata", "atak",
    ),
    "religious": (
        "quran", "qur'an", "hadith", "hadees", "tafseer", "dua", "allah", "namaz", "azan",
        "surah", "aayat", "ayat", "deen", "islam",
    ),
}

SENSITIVITY_TAGS = {
    "Ads Sensitivity": ("ad", "ads", "advert", "advertisement", "advertisements", "vulgar"),
    "Monetization Risk": (
        "subscription", "subscribed", "payment", "premium", "refund", "billing", "charge", "charged", "paid",
    ),
    "Trust & Authenticity": (
        "wrong", "incorrect", "authentic", "fake", "sahih", "zaeef", "daeef", "dalil", "proof", "reference",
    ),
    "Quran / Tafseer": (
        "quran", "qur'an", "quraan", "tafseer", "tafsir", "translation", "tarjuma", "ayah", "ayat", "surah", "sura",
    ),
    "Prayer & Worship": ("prayer", "namaz", "namaaz", "azan", "azaan", "adhan", "dua", "duaa", "salah"),
    "Performance Risk": (
        "crash", "crashes", "crashing", "hang", "hangs", "hanging", "slow", "freeze", "freezes", "lag", "laggy",
        "bug", "bugs",
    ),
    "Search & UX": ("search", "ui", "ux", "navigation", "navigate", "find"),
}
DEFAULT_TAG = "General Product"
TRUST_TAG = "Trust & Authenticity"
MONEY_TAG = "Monetization Risk"
UNASSIGNED_PARENT = "Unassigned / No Parent"

QUEUE_TAG_WEIGHTS = {
    "Trust & Authenticity": 5,
    "Quran / Tafseer": 4,
    "Prayer & Worship": 4,
    "Ads Sensitivity": 4,
    "Monetization Risk": 3,
    "Performance Risk": 3,
    "Search & UX": 2,
    "General Product": 1,
}

# Row urgency: scores, their defaults for unknown values, and weights.
SEVERITY_SCORE = {"Low": 0.2, "Medium": 0.55, "High": 1.0}
SENTIMENT_SCORE = {"Positive": 0.05, "Neutral": 0.35, "Negative": 1.0}
UNKNOWN_SEVERITY_SCORE = 0.4
UNKNOWN_SENTIMENT_SCORE = 0.35
URGENCY_WEIGHTS = {
    "severity": 0.40,
    "sentiment": 0.26,
    "payment": 0.12,
    "blocker": 0.12,
    "trust": 0.08,
    "religious_trust": 0.02,
}
# Cluster priority, and the urgency axis of the priority matrix.
PRIORITY_WEIGHTS = {"urgency": 0.55, "growth": 0.25, "impact": 0.20}
HIGH_PRIORITY = 70.0
MATRIX_WEIGHTS = {"high": 0.45, "negative": 0.40, "trust": 0.15}

# Record-level ranks (1 is the mildest).
SEVERITY_RANK = {"Low": 1, "Medium": 2, "High": 3}
SENTIMENT_RANK = {"Positive": 1, "Neutral": 2, "Negative": 3}
SENTIMENT_RANK_FROM_ZERO = {"Positive": 0, "Neutral": 1, "Negative": 2}

TIME_COLUMNS = ("created_at", "timestamp", "date", "datetime", "submitted_at", "feedback_time")

PRESETS = {
    "All Feedback": {},
    "Trust Escalations": {"sentiment": ["Negative"], "risk_primary": ["Trust & Authenticity"]},
    "Subscription Pain": {"risk_primary": ["Monetization Risk"], "sentiment": ["Negative", "Neutral"]},
    "Quran/Tafseer Critical": {
        "risk_primary": ["Quran / Tafseer"],
        "severity": ["High", "Medium"],
        "sentiment": ["Negative", "Neutral"],
    },
    "Ads Sensitivity": {"risk_primary": ["Ads Sensitivity"], "sentiment": ["Negative", "Neutral"]},
    "Performance Critical": {"risk_primary": ["Performance Risk"], "severity": ["High", "Medium"]},
}
QUICK_FILTERS = {
    "Negative Only": {"sentiment": ["Negative"]},
    "High Severity Only": {"severity": ["High"]},
    "Medium+ Severity": {"severity": ["High", "Medium"]},
    "Suggestions Only": {"classification": ["Suggestion"]},
    "Reviews Only": {"classification": ["General Review"]},
}

# Removed from finished term lists (after weighting).
EXTRA_STOP_WORDS = (
    "app", "apps", "plz", "pls", "please", "kindly", "good", "nice", "best", "thanks", "thx", "ka", "ki", "ke",
    "ko", "se", "hai", "hain", "main", "mein", "aur", "ya", "or", "and", "the", "to", "of", "in", "is", "it",
    "for", "on", "this", "that", "be", "with", "should", "would", "could", "can", "may", "must", "have", "has",
    "had", "are", "was", "were",
)
# Description of a cluster: size, label, most frequent sentiment, most frequent severity.
CLUSTER_DESCRIPTION = "Cluster of %d feedback comments centered on: %s. Top sentiment: %s; top severity: %s."
# ---------------------------------------------------------------------------
# End of fixed values.
# ---------------------------------------------------------------------------

# Removed before terms are formed: common English function words of three letters or more
# (shorter ones are never tokens).  A parameter; pass any other list where one is wanted.
STOP_WORDS = (
    "about", "above", "after", "again", "against", "all", "also", "although", "always", "among", "and",
    "another", "any", "are", "around", "because", "been", "before", "being", "below", "between", "both", "but",
    "can", "cannot", "could", "did", "does", "doing", "done", "down", "during", "each", "either", "else",
    "enough", "even", "ever", "every", "few", "for", "from", "further", "get", "give", "had", "has", "have",
    "having", "her", "here", "hers", "herself", "him", "himself", "his", "how", "however", "into", "its",
    "itself", "just", "keep", "least", "less", "made", "make", "many", "may", "might", "mine", "more", "most",
    "much", "must", "myself", "neither", "never", "next", "nor", "not", "nothing", "now", "off", "often",
    "once", "one", "only", "onto", "other", "others", "our", "ours", "ourselves", "out", "over", "own", "per",
    "perhaps", "please", "quite", "rather", "really", "same", "see", "seem", "several", "she", "should",
    "since", "some", "still", "such", "take", "than", "that", "the", "their", "theirs", "them", "themselves",
    "then", "there", "these", "they", "this", "those", "though", "through", "thus", "together", "too", "toward",
    "under", "until", "upon", "very", "was", "well", "were", "what", "when", "where", "whether", "which",
    "while", "who", "whom", "whose", "why", "will", "with", "within", "without", "would", "yet", "you", "your",
    "yours", "yourself", "yourselves",
)


def word_pattern(words: Iterable[str]) -> str:
    """Case-insensitive, Unicode-aware, whole-word alternation."""
    return r"(?iU)\b(?:" + "|".join(re.escape(w) for w in words) + r")\b"


def ascii_word_pattern(words: Iterable[str]) -> str:
    """The same alternation for an engine whose ``\\b`` knows ASCII only (the SQL checks)."""
    return r"(?i)\b(?:" + "|".join(re.escape(w) for w in words) + r")\b"


