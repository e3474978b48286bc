"""Texts that stress the string contract."""

import random

HAND_PICKED = [
    None, "", "   ", "  ", "\x1c\x1d", "@Delta", "@Delta hi", "  @Delta x",
    "http://u @Delta x", "@Delta http://t.co/a thanks", "a&amp;amp;b", "ahttps://x.y b",
    "www.x.y z", "HELP", "help", "MISSING bag", "3 hours", "3\x1chours",
    "٣ hours", "delayed\nagain\r\n", "I AM STRANDED", "ⒶⒷ circled",
    "ÉCOLE école", "ſtranded", "Kelvin", "re­fund", "refund_",
    "@été hi", "@a_1　x", "can't cancelled!!", "late?late!late", "12days", "1 daylight",
    "oh great", "on  hold", "sue", "issue", "worst, awful; terrible", "퟿\U0001F600 help!",
    "tab\tsep\x0bvt\x0cff\x85nel", "thank you", "DM sent", "x" * 5000 + " refund",
]
ALPHABET = list("abDELAYhelp refund!?@&;_-0139 \t\n éÉßſK\x1c ́Σ")
WORDS = ["refund", "LATE", "3 hours", "on hold", "@Delta", "http://x", "&amp;", "help", "Damn",
         "cancel", "delay", "medical", "oh great", "5mins", "!!", "?", " ", "\x1f", "missed"]


def texts(n=400, seed=7):
    pick = random.Random(seed)
    out = list(HAND_PICKED)
    for _ in range(n):
        out.append("".join(pick.choice(ALPHABET) for _ in range(pick.randint(0, 40))))
        out.append(pick.choice(["", " ", " "]).join(
            pick.choice(WORDS + ALPHABET) for _ in range(pick.randint(1, 9))))
    return out
