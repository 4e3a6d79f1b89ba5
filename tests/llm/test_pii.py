import re

import pytest

from gridspark.llm import pii

PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+",
    "card": r"[0-9](?:[\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "iban": pii.PATTERNS["iban"],
}


def luhn(d):
    return sum(x if k % 2 == 0 else (2 * x - 9 if x > 4 else 2 * x) for k, x in enumerate(map(int, reversed(d)))) % 10 == 0


def valid(kind, v):
    d = re.sub("[^0-9]", "", v)
    if kind == "ip":
        return all(int(p) <= 255 for p in v.split("."))
    if kind == "card":
        return 13 <= len(d) <= 19 and luhn(d)
    if kind == "phone":
        return 9 <= len(d) <= 15
    if kind == "iban":
        v = v.replace(" ", "")
        return int("".join(str(int(c, 36)) for c in v[4:] + v[:4])) % 97 == 1
    return True


def brute(text):
    return [(kind, m.start(), m.end()) for kind in pii.KINDS for m in re.finditer(PLAIN[kind], text or "") if valid(kind, m.group())]


TEXTS = [
    None, "", "nothing here", "mail a.b@c.example.com, x@y, z@w.org.", "a@b.c@d.e", "a@b.c_d@e.f g@h.i%j@k.l", "@@a@b..c@d.e.",
    "1.2.3.4 256.1.1.1 1.2.3.4.5.6.7.8 001.002.003.0004 0000300.1.1.1 99999999999999999999.1.1.1",
    "card 4111 1111 1111 1111 and 4111-1111-1111-1112, 378282246310005 0000000000000",
    "call +1 (017) 555-7713 or +12 or +1 2, +44 20 7946 0958 9 +123456789012345678", "+1(555)1234567)-.", "+1 555 123 4567 4111111111111111",
    "IBAN DE89 3704 0044 0532 0130 00 or GB82WEST12345698765432, DE89370400440532013001", "é ü 4111111111111111 日本 1.2.3.4 😀 a@b.co 😀",
    "1 2 3 4 " * 3000, "a@b.co " * 700, "1.1.1.1 " * 600, "a" * 200_000, "9" * 200_000, "a." * 60_000 + "@b", "+1" * 5000, "1." * 50_000, "a@" + "b." * 30_000,
]


@pytest.fixture(scope="module")
def found(spark):
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], "doc_id bigint, text string")
    return {r.doc_id: r for r in pii.find_spans(docs).collect()}


@pytest.mark.parametrize("i", range(len(TEXTS)))
def test_against_python(found, i):
    got = [(s.kind, s.start, s.stop) for s in found[i].spans]
    assert got == brute(TEXTS[i])
    assert all(s.value == TEXTS[i][s.start:s.stop] for s in found[i].spans)


def test_context_moves_the_score(documents):
    docs = documents([(1, "my card: 4111111111111111"), (2, "4111111111111111"), (3, "7 1234.4111111111111111")])
    score = {r.doc_id: r.spans[0].score for r in pii.find_spans(docs).collect()}
    assert score[1] > score[2] > score[3]


def test_redact_and_clashing_columns(documents):
    docs = documents([(1, "x a@b.co y 1.2.3.4", 7), (2, None, 8), (3, "+4111111111111111 é", 9)], "spans int")
    out = {r.doc_id: r.text for r in pii.redact(docs).collect()}
    assert out[1] == "x <email> y <ip>" and not out[2] and out[3] == "+<card> é"
    assert dict(pii.find_spans(docs).dtypes)["spans"].startswith("array")
    assert pii.find_spans(documents([])).count() == 0


def test_no_python_in_the_plan(spark, documents):
    plan = pii.find_spans(documents([(1, "a")]))._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Arrow|Pandas|MapIn", plan)
