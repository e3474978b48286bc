import random
import re
from collections import Counter

import plain

from ticketloom.llm import catalog, licences
from ticketloom.llm.licence_texts import TEMPLATES


def bigrams(text):
    w = plain.words(text)
    return Counter(zip(w, w[1:]))


def brute(text, templates, limit=0.8):
    """Best region of every template over all runs of lines."""
    lines, out = (text or "").split("\n"), []
    for name in sorted(templates):
        bag, best = bigrams(templates[name]), None
        for i in range(len(lines)):
            for j in range(i, len(lines)):
                part = bigrams("\n".join(lines[i:j + 1]))
                size = sum(part.values()) + sum(bag.values())
                dice = 2 * sum((part & bag).values()) / size if size else 0
                if bag and dice >= limit - 1e-9 and (best is None or dice > best + 1e-12):
                    best = dice
        if best is not None:
            out.append((name, round(best, 9)))
    return out


def test_planted_and_random_texts(spark):
    rng = random.Random(8)
    names, docs = sorted(TEMPLATES), [None, "", "\n\n", "licence", "Released under the MIT License."]
    filler = ["the software is", "of the license", "word and more", "", "!!", "Copyright (c) 2020 A"]
    for _ in range(60):
        lines = [rng.choice(filler) for _ in range(rng.randrange(4))]
        words = re.split(r"\s+", TEMPLATES[rng.choice(names)])
        for _ in range(rng.randrange(3)):
            words[rng.randrange(len(words))] = "changed"
        cut = sorted(rng.randrange(len(words)) for _ in range(3))
        lines += [" ".join(words[a:b]) for a, b in zip([0] + cut, cut + [None])]
        docs.append("\n".join(lines + [rng.choice(filler) for _ in range(rng.randrange(3))]))
    df = spark.createDataFrame([(i, t, 1) for i, t in enumerate(docs)], "doc_id long, text string, dice int")
    got = {r["doc_id"]: r["licences"] for r in licences.with_licences(df).collect()}
    hits = 0
    for i, text in enumerate(docs):
        want = brute(text, TEMPLATES)
        assert [(m["licence"], m["dice"]) for m in got[i]] == want, text
        for m in got[i]:
            region = "\n".join(text.split("\n")[m["first_line"]:m["last_line"] + 1])
            assert (m["licence"], m["dice"]) in brute(region, {m["licence"]: TEMPLATES[m["licence"]]})
        hits += len(want)
    assert hits > 30
    assert licences.digest(df.limit(0)).collect() == []


def test_given_table(spark):
    docs = {d["doc_id"]: d["text"] for d in plain.rows("documents", plain.SF01)}
    notices = {n: t for n, t in TEMPLATES.items() if n.endswith("-notice")}
    found = 0
    for r in catalog.op9_licence_dice(spark, plain.SF01).collect():
        planted = [n for n, t in notices.items() if t in (docs[r["doc_id"]] or "").split("\n")]
        assert set(planted) <= {m.split(":")[0] for m in r["licences"].split(",") if m}
        found += len(planted)
    assert found


def brute_words(text, templates, limit=0.8):
    """Best region of every template over all runs of words: (name, dice, first word, last word)."""
    w, out = plain.words(text), []
    for name in sorted(templates):
        bag, best = bigrams(templates[name]), None
        for i in range(len(w)):
            part = Counter()
            for j in range(i + 1, min(len(w), i + 2 * sum(bag.values()) + 2)):
                part[w[j - 1], w[j]] += 1
                dice = 2 * sum((part & bag).values()) / (j - i + sum(bag.values()))
                if dice >= limit - 1e-9 and (best is None or dice > best[1] + 1e-12):
                    best = (name, dice, i, j)
        if best:
            out.append((best[0], round(best[1], 9), *best[2:]))
    return out


def test_regions_inside_lines(spark):
    rng = random.Random(5)
    short = {n: t for n, t in TEMPLATES.items() if len(t) < 200} | {"rep": "a b a b c a b", "one": "one"}
    docs = ["Copyright 2020 Foo. All rights reserved.", "all rights\nreserved", None, "", "one one"]
    filler = ["of the work", "license", "under", "a b a", "all rights", "and more", "\n", "version 3", "a b c a b"]
    for _ in range(150):
        parts = [rng.choice(filler) for _ in range(rng.randrange(6))]
        words = short[rng.choice(sorted(short))].split()
        if rng.random() < 0.5:
            words[rng.randrange(len(words))] = "changed"
        docs.append(" ".join(parts + words + [rng.choice(filler) for _ in range(rng.randrange(6))]))
    df = spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string")
    rows = licences.with_licences(df, templates=short, whole_lines=False).collect()
    found = 0
    for r in rows:
        got = [(m["licence"], m["dice"], m["first_word"], m["last_word"]) for m in r["licences"]]
        assert got == brute_words(r["text"], short), r["text"]
        for m in r["licences"]:
            at = [len(plain.words("\n".join(r["text"].split("\n")[:i]))) for i in range(r["text"].count("\n") + 2)]
            assert at[m["first_line"]] <= m["first_word"] < at[m["first_line"] + 1]
            assert at[m["last_line"]] <= m["last_word"] < at[m["last_line"] + 1]
        found += len(got)
    assert found > 100 and rows[0]["licences"][0]["licence"] == "All-rights-reserved"


def test_whole_texts_on_one_line_and_bsd(spark):
    names = ["MIT", "BSD-2-Clause", "BSD-3-Clause"]
    docs = [("prose before it " * 300 + TEMPLATES[n] + " and after it" * 300).replace("\n", " ") for n in names]
    docs.append("This paragraph ends with a notice, as some do. " + TEMPLATES["CC-BY-4.0-notice"])
    df = spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string")
    got = {r["doc_id"]: r for r in licences.digest(df).collect()}
    assert [got[i]["licence"] for i in range(4)] == names + ["CC-BY-4.0-notice"]
    assert all(got[i]["dice"] == 1 for i in range(4))
    assert "BSD-3-Clause:0:0:900:" in got[2]["licences"]


def test_a_column_named_text_is_kept(spark):
    df = spark.createDataFrame([("x", 1, "All rights reserved.")], "_text string, c1 int, text string")
    row = licences.with_licences(df).first()
    assert row[:3] == ("x", 1, "All rights reserved.") and len(row["licences"]) == 1
