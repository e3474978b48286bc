"""Fixed values.

Word lists, patterns, thresholds, prices and texts that decide results. They are data, not
design: changing one changes what the engine answers, so they live together here.
"""

# --- fixed values: routing and cleaning ---------------------------------------------------
BRANDS = ("americanair", "delta", "southwestair", "jetblue", "united", "usairways")
BARE_PHRASES = ("dm sent", "thanks", "thank you", "help")
MIN_TICKET_CHARS = 8
MIN_REPLY_CHARS = 10
REPLY_SEPARATOR = " | "
OTHER_HANDLE_MIN_COUNT = 200
OTHER_HANDLE_LIMIT = 25
FIRST_MENTION_LIMIT = 30

# Cells a pandas CSV reader turns into missing values by default.
NA_TOKENS = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
    "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
)

# --- fixed values: labelling rules; every entry is matched as a whole word, any case --------
URGENCY_WORDS = (
    r"refund", r"broken", r"cancel(?:led)?", r"delay(?:ed)?", r"down", r"help", r"urgent",
    r"emergency", r"asap", r"immediately", r"missing", r"lost", r"stranded", r"issue",
    r"problem", r"waiting",
)
CRITICAL_WORDS = (
    r"stranded", r"unsafe", r"medical", r"police", r"sue", r"lawsuit", r"unacceptable",
    r"disaster", r"fraud",
)
PROFANITY_WORDS = (
    r"fuck", r"shit", r"damn", r"crap", r"hell", r"worst", r"awful", r"terrible", r"horrible",
)
SARCASM_PHRASES = (
    r"oh great", r"wonderful", r"fantastic", r"perfect", r"thanks for nothing", r"love this",
)
DELAY_PHRASES = (
    r"\d+\s?(?:hours?|hrs?|days?|minutes?|mins?)", r"waiting", r"still waiting", r"delayed",
    r"delay", r"cancelled", r"canceled", r"missed", r"missed flight", r"missed connection",
    r"stranded", r"late", r"on hold",
)
DELAY_POINTS = 3
URGENCY_POINTS = 2
PROFANITY_POINTS = 1
CAPS_POINTS = 1
EXCLAMATION_POINTS = 1
CRITICAL_SCORE = 10
CAPS_LIMIT = 0.4
EXCLAMATION_LIMIT = 2
URGENT_FROM = 3

# --- fixed values: model features -----------------------------------------------------------
FEATURES = (
    "text_length", "word_count", "exclamation_count", "question_count", "caps_ratio",
    "has_refund", "has_cancel", "has_delay", "has_help", "has_broken", "has_stranded",
    "has_medical", "profanity_count", "has_time_mention",
)
FEATURE_PATTERNS = {
    "has_refund": r"\brefund\b",
    "has_cancel": r"\bcancel",
    "has_delay": r"\bdelay",
    "has_help": r"\bhelp\b",
    "has_broken": r"\bbroken\b",
    "has_stranded": r"\bstranded\b",
    "has_medical": r"\bmedical\b",
    "has_time_mention": r"\b\d+\s?(?:hours?|hrs?|days?)",
}
# Every match of a pattern above contains one of its stems.
FEATURE_STEMS = {
    "has_refund": ("refund",),
    "has_cancel": ("cancel",),
    "has_delay": ("delay",),
    "has_help": ("help",),
    "has_broken": ("broken",),
    "has_stranded": ("stranded",),
    "has_medical": ("medical",),
    "has_time_mention": ("hour", "hr", "day"),
}
FEATURE_PROFANITY = ("fuck", "shit", "damn", "worst", "awful", "terrible", "horrible")

# --- fixed values: retrieval ----------------------------------------------------------------
VECTOR_DIM = 384
TOP_K = 5
SIMILARITY_FLOOR = 0.3

# --- fixed values: scope guard, first match wins, any case ------------------------------------
GUARD_RULES = (
    ("code_request",
     r"\b(write|generate|create|give me|show me)\s+(me\s+)?(a\s+|some\s+)?"
     r"(python|javascript|typescript|java|c\+\+|sql|html|css|bash|shell|code|"
     r"function|script|class|program|algorithm|snippet)\b"),
    ("arithmetic_expression", r"^\s*[\d\s\.\+\-\*\/\(\)\^%]+\s*=?\s*$"),
    ("creative_writing",
     r"\b(write|compose|give me)\s+(me\s+)?(a\s+)?"
     r"(poem|song|haiku|rap|essay|story|novel|joke)\b"),
    ("general_trivia",
     r"\b(capital\s+of|population\s+of|president\s+of|prime\s+minister\s+of)\b"),
    ("jailbreak_attempt",
     r"\b(ignore\s+(previous|all|prior)\s+instructions|you\s+are\s+now\s+(a\s+)?DAN|"
     r"pretend\s+you\s+are|act\s+as\s+if\s+you\s+have\s+no\s+restrictions|"
     r"disregard\s+your\s+(guidelines|rules|training))\b"),
)
BLOCK_MESSAGES = {
    "code_request": "This assistant doesn't write or debug code.",
    "arithmetic_expression": "This assistant doesn't solve maths problems.",
    "creative_writing": "This assistant doesn't write creative content.",
    "general_trivia": "This assistant doesn't answer general knowledge questions.",
    "jailbreak_attempt": "That type of instruction is not permitted here.",
    "off_topic": "Your question doesn't appear to be about airline customer support.",
}
BLOCK_MESSAGE_DEFAULT = "Query is out of scope."
BLOCK_CODE = "off_topic"
SCOPE_HINT = "Ask about flights, bookings, baggage, refunds, delays or other airline service."
GUARD_QUERY_CHARS = 400

# --- fixed values: prompts ------------------------------------------------------------------
GUARD_PROMPT = (
    "You are a strict topic classifier for an airline customer support chatbot.\n"
    "The chatbot ONLY handles questions about: airlines, flights, air travel, "
    "booking, reservations, cancellations, refunds, baggage, check-in, boarding, "
    "flight delays and disruptions, airport services, loyalty programmes, upgrades, "
    "and related travel support.\n\n"
    "Reply with ONLY the word YES if the message below is within that scope.\n"
    "Reply with ONLY the word NO if it is about anything else "
    "(coding, maths, politics, entertainment, general knowledge, etc.).\n\n"
    "Message: {query}\n\n"
    "Answer (YES or NO):"
)
CONTEXT_PROMPT = (
    "You are a customer support analyst for an airline.\n"
    "Answer the user's question using the similar past tickets below as your "
    "primary source. Ground your response in how those past cases were handled. "
    "Similarity scores range from 0 to 1 — be explicit about uncertainty when "
    "scores are below 0.5. Do not invent information not present in the tickets.\n\n"
    "--- Similar past tickets ---\n{context}\n\n"
    "--- User question ---\n{query}\n\nAnswer:"
)
NO_CONTEXT_PROMPT = (
    "You are a customer support analyst for an airline. "
    "No similar past tickets were found for this query. "
    "Answer based on general airline customer support knowledge and "
    "make clear that your response is not drawn from specific past cases.\n\n"
    "Question: {query}\n\nAnswer:"
)
LABEL_PROMPT = (
    "Classify this airline customer support ticket as exactly one of two labels:\n"
    "  URGENT — service disruption, safety concern, time-sensitive issue, "
    "or any situation needing immediate action\n"
    "  NORMAL — general inquiry, feedback, or routine request\n\n"
    "Respond with ONLY the label (URGENT or NORMAL). No explanation.\n\n"
    "Ticket: {query}"
)
COMPLETION_ERROR_PREFIX = "[LLM unavailable"

# --- fixed values: completion prices, USD per million tokens ----------------------------------
PRICES = {"primary": (0.075, 0.30), "fallback": (0.59, 0.79)}
TICKETS_PER_HOUR = 10_000
