"""Independent plain-Python statements of the text contract, for property tests only."""

import re

from ticketloom import fixed_values as fv

GAPS = re.compile(r"\s+")


def clean(text):
    text = "" if text is None else text
    text = re.sub(r"(?:http|www)\S+", "", text)
    lead = re.match(r"@[A-Za-z0-9_]+\s*", text)
    if lead:
        text = text[lead.end():]
    return GAPS.sub(" ", text.replace("&amp;", "&")).strip()


def handle(text):
    found = re.match(r"\s*@([A-Za-z0-9_]+)", text or "")
    return found.group(1) if found else None


def any_word(words, text):
    return any(re.search(rf"\b{w}\b", text, re.I) for w in words)


def label(text):
    text = text or ""
    letters = [c for c in text if c.isalpha()]
    shouting = bool(letters) and sum(map(str.isupper, letters)) / len(letters) > fv.CAPS_LIMIT
    if any_word(fv.CRITICAL_WORDS, text):
        score = 10
    else:
        score = sum((
            3 * any_word(fv.DELAY_PHRASES, text), 2 * any_word(fv.URGENCY_WORDS, text),
            any_word(fv.PROFANITY_WORDS, text), shouting, text.count("!") > 1,
        ))
    return score, ("URGENT" if score > 2 else "NORMAL")


def features(text):
    text = text or ""
    low = text.lower()
    out = {name: int(re.search(p, low) is not None) for name, p in fv.FEATURE_PATTERNS.items()}
    out["text_length"] = len(text)
    out["word_count"] = len(text.split())
    out["exclamation_count"] = text.count("!")
    out["question_count"] = text.count("?")
    out["caps_ratio"] = sum(map(str.isupper, text)) / (len(text) or 1)
    out["profanity_count"] = len(re.findall(rf"\b(?:{'|'.join(fv.FEATURE_PROFANITY)})\b", low))
    return out
