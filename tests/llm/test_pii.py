"""Personal data against the contract's patterns in Python, and what the method adds."""

from __future__ import annotations

import hashlib
import random
import re

import pytest

from ionframe.llm import pii

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    return sum(sum(divmod(int(d) * (1 + k % 2), 10)) for k, d in enumerate(reversed(digits))) % 10 == 0


def valid(kind, m):
    digits = re.sub("[^0-9]", "", m)
    if kind == "ip":
        return all(int(p) <= 255 for p in m.split("."))
    if kind == "card":
        return 12 <= len(digits) <= 19 and luhn(digits)
    return kind == "email" or 9 <= len(digits) <= 15


def base_spans(text):
    found = [(m.start(), k, kind, m.end()) for k, (kind, p) in enumerate(PATTERNS.items()) for m in re.finditer(p, text or "") if valid(kind, m.group())]
    return [(kind, start, end) for start, _, kind, end in sorted(found)]


CARD, OTHER = "4111111111111111", "5500005555555559"
TEXTS = [
    None, "", "no data at all", "a@b.co_x@y.zz,x@y.z.w-1@q.r", "..%@a-.b c@d e@f.g.", "1.2.3.4.5.6.7.8 256.1.1.1 001.02.3.0255 1.1.1.300",
    f"{CARD} {OTHER}", f"card {CARD}", "4111-1111 1111-1111", f"x{CARD}y", f"+{CARD}", "+1 (017) 555-7713, +44 20.7946 0958-", "+1--------2 +1 2", "é\U0001f600 a@b.c ü 10.0.0.1",
    "\x01a@b.c\x01 \x021.2.3.4", "bank DE89 3704 0044 0532 0130 00 and GB82WEST12345698765432.", "DE88 3704 0044 0532 0130 00", "call (030) 1234-5678 now", "order (030) 1234-5678", "tel: 0301 234 5678",
]


def rows():
    rng = random.Random(4)
    odd = ["".join(rng.choice("0123456789.@+-() ab,_%") for _ in range(rng.randint(1, 300))) for _ in range(300)]
    return [(k, t) for k, t in enumerate(TEXTS + odd + long_texts(300))]


def long_texts(n):
    """Texts on which a pattern that tries every start, or calls itself, is slow or fails."""
    return ["x" * n + "@" + "y" * n, "7" * n, "1 " * n, "1." * 4 + "1" * n + ".1" * 4, "a@b" + ".c" * n, "+1" + "." * n, "a.b-c " * n + f" {CARD}", "1 23" * n]


@pytest.fixture(scope="module")
def found(spark):
    wide = [(k, t, "s", "x", 1.0) for k, t in rows()] + [(None, "a@b.c", None, None, None), (3, "second 1.2.3.4", None, None, None)]
    docs = spark.createDataFrame(wide, "doc_id long, text string, spans string, base string, score double").repartition(4)
    return docs, pii.find_pii(docs).cache()


def test_base_spans_equal_the_patterns(found):
    docs, spans = found
    got = sorted((str(r["doc_id"]), r["text"], [(s["kind"], s["start"], s["end"]) for s in r["spans"] if s["base"]]) for r in spans.collect())
    assert got == sorted((str(r["doc_id"]), r["text"] or "", base_spans(r["text"])) for r in docs.collect())


def test_report(found):
    docs, _ = found
    got = {(r["doc_id"], r["base_sha256"]): r for r in pii.pii_report(docs).collect()}
    for k, t in rows():
        own = base_spans(t)
        r = got[k, hashlib.sha256(",".join(":".join(map(str, s)) for s in own).encode()).hexdigest()]
        assert [r[f"n_{kind}"] for kind in PATTERNS] == [sum(s[0] == kind for s in own) for kind in PATTERNS]
        assert set(filter(None, r["spans"].split(","))) >= {":".join(map(str, s)) for s in own}


def test_added_spans_and_scores(found):
    _, spans = found
    by = {r["text"]: {(r["text"][s["start"] : s["end"]], s["kind"]): s["score"] for s in r["spans"]} for r in spans.collect()}
    assert by[f"{CARD} {OTHER}"] == {(CARD, "pan"): 0.6, (OTHER, "pan"): 0.6}  # one failing match of the card rule
    assert by[f"card {CARD}"] == {(CARD, "card"): 0.9}
    assert by["bank DE89 3704 0044 0532 0130 00 and GB82WEST12345698765432."] == {("DE89 3704 0044 0532 0130 00", "iban"): 1.0, ("GB82WEST12345698765432", "iban"): 0.8}
    assert by["DE88 3704 0044 0532 0130 00"] == {}  # wrong check digits
    assert by["call (030) 1234-5678 now"] == {("(030) 1234-5678", "tel"): 0.6} and by["order (030) 1234-5678"] == {}
    assert by["no data at all"] == {}


def test_redacted(found):
    _, spans = found
    by = {r["doc_id"]: r["text"] for r in pii.redacted(spans).collect() if r["doc_id"] is not None}
    assert by[7] == "card [card]" and by[13] == "é\U0001f600 [email] ü [ip]" and by[0] == ""


def test_long_texts(spark):
    """Runs of 200,000 characters; the patterns in the test itself would not end on them."""
    short, n = long_texts(300), 200_000
    docs = spark.createDataFrame(list(enumerate(long_texts(n))), "doc_id long, text string")
    got = {r["doc_id"]: r for r in pii.pii_report(docs).collect()}
    for k, t in enumerate(short):
        own = base_spans(t)
        assert [got[k][f"n_{kind}"] for kind in PATTERNS] == [sum(s[0] == kind for s in own) for kind in PATTERNS]
    assert got[4]["spans"] == f"email:0:{3 + 2 * n}" and got[6]["spans"] == f"card:{6 * n + 1}:{6 * n + 17}" and got[1]["spans"] == ""


def test_no_rows_and_native_plan(spark):
    none = pii.pii_report(spark.createDataFrame([], "doc_id long, text string"))
    assert none.count() == 0
    plan = none._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Exchange" not in plan
