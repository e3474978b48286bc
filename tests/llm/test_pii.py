import random

import plain

from ticketloom.llm import catalog, pii


def test_given_table(spark):
    got = {r["doc_id"]: r for r in catalog.op10_pii_spans(spark, plain.SF01).collect()}
    docs = plain.rows("documents", plain.SF01)
    assert len(got) == len(docs)
    for doc in docs:
        want, row = plain.base_spans(doc["text"]), got[doc["doc_id"]]
        assert row["base_sha256"] == plain.sha(",".join(f"{k}:{a}:{b}" for k, a, b in want))
        for kind in pii.BASE:
            assert row[f"n_{kind}"] == sum(k == kind for k, _, _ in want)
        assert {f"{k}:{a}:{b}" for k, a, b in want} <= set(row["spans"].split(",")) or not want


def test_random_strings_match_plain_patterns():
    rng = random.Random(3)
    pieces = ["a@b.c", "@", ".", "x", " ", "-", "+", "1", "4111111111111111", "+1 (2) 555-01234",
              "10.0.0.1", "256.1.1.1", "a.b@c-d.e.f@g.h", "(", "é", "00", "\n", "1.2.3.4.5", "%"]
    for _ in range(4000):
        text = "".join(rng.choice(pieces) for _ in range(rng.randrange(14)))
        base = [(k, a, b) for k, a, b, _ in pii.find(text) if k in pii.BASE]
        assert base == plain.base_spans(text), text


def test_more_kinds_need_checks_and_context():
    kinds = lambda text: [k for k, *_ in pii.find(text)]
    assert kinds("IBAN GB82 WEST 1234 5698 7654 32 ok") == ["iban"]
    assert kinds("IBAN GB82 WEST 1234 5698 7654 33 ok") == []
    assert kinds("routing no 021000021") == ["routing"]
    assert kinds("some 021000021") == []
    assert kinds("her SSN is 536-22-1234") == ["ssn"]
    assert kinds("part 536-22-1234") == []
    near = pii.find("call +1 (222) 555-0123")[0]
    far = pii.find("zzzz +1 (222) 555-0123")[0]
    assert near[3] > far[3]


def test_redact_and_rows(spark):
    text = "é mail a@b.co, ip 10.0.0.1"
    assert pii.redact(text, pii.find(text)) == "é mail [EMAIL], ip [IP]"
    df = spark.createDataFrame([(1, text, 5), (2, None, 6), (2, "", 7)],
                               "doc_id long, text string, pii int")
    out = pii.with_spans(df, clean="text").orderBy("doc_id").collect()
    assert out[0]["text"] == "é mail [EMAIL], ip [IP]" and len(out[0]["pii"]) == 2
    assert [(r["text"], r["pii"]) for r in out[1:]] in ([(None, []), ("", [])], [("", []), (None, [])])
    none = pii.digest(df.limit(0)).collect()
    assert none == []


def test_long_text():
    text = ("x" * 50 + " a@b.co 4111111111111111 ") * 5000
    assert len(pii.find(text)) == 10_000


def test_ibans_before_upper_case_words():
    numbers = ["ES9121000418450200051332", "BE68 5390 0754 7034", "AT611904300234573201",
               "PL61109010140000071219812874", "GB82 WEST 1234 5698 7654 32", "NO9386011117947"]
    for number in numbers:
        for after in ("", " BIC", " BIC ABNA", " KRS 12", " BANK OF", " A", ".", "\nBIC"):
            spans = pii.find(f"IBAN {number}{after}")
            assert [(k, a, b) for k, a, b, _ in spans] == [("iban", 5, 5 + len(number))], number + after
    text = "IBAN BE68 5390 0754 7034 AT61 1904 3002 3457 3201 BIC"
    assert pii.redact(text, pii.find(text)) == "IBAN [IBAN] [IBAN] BIC"
    text = "IBAN XX12 ABCD ES91 2100 0418 4502 0005 1332 BIC"
    assert pii.redact(text, pii.find(text)) == "IBAN XX12 ABCD [IBAN] BIC"
    assert pii.find("IBAN ES9121000418450200051333 BIC") == []
