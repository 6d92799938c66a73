"""Personal data in texts, by built-in functions only.

Regular expressions propose spans, validators confirm them (Luhn for cards, mod 97 for bank
accounts, ranges of parts and digits), and words within ``NEAR`` code points adjust a score.
Four kinds are the base: what their rules confirm stays whatever its score. Three more are
added, where their score reaches ``LEAST`` and no base span overlaps: bank accounts
(``iban``), numbers that stand in one row of digits, which the card rule takes as one
(``pan``), and telephone numbers without a country (``tel``), which only nearby words confirm.

A match is marked with a control character on both sides and the text split there, so pieces
at odd places are matches, and places come from the pieces' lengths. The base patterns are
the contract's, with possessive repeats and a check of the character before, which change no
match but keep one pass over a text linear, also in runs of a million letters or digits.

Defined cases: null and empty texts have no spans; texts of any length are read whole; rows
are treated one by one, so null and repeated doc_ids keep their rows and further columns are
ignored; an empty table gives no rows. Offsets are code points, ends exclusive.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ionframe.llm.shared import text_or_empty

#: Stands beside matches; where a text holds it, the second one takes its place (neither can
#: be part of a match).
MARK, MARKED = "\x01", "\x02"
#: Code points on both sides in which context words count, and how much they do.
NEAR, STEP = 40, 0.3
#: Score that an added span must reach.
LEAST = 0.5
SPANS = "array<struct<start:int,rank:int,kind:string,end:int,score:double,base:boolean>>"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is worked out once, however often the body names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def digits_of(match: Column) -> Column:
    return F.translate(match, " +().-", "")


def luhn(digits: Column) -> Column:
    """Whether a text of digits has a valid check digit (Luhn)."""
    n = F.length(digits)

    def add(total: Column, k: Column) -> Column:  # k: place from the right, from 0
        d = F.substring(digits, n - k, F.lit(1)).cast("int")
        twice = F.when(d > 4, d * 2 - 9).otherwise(d * 2)
        return total + F.when(k % 2 == 1, twice).otherwise(d)

    return F.aggregate(F.sequence(F.lit(0), n - 1), F.lit(0), add) % 10 == 0


def mod_97(account: Column) -> Column:
    """Whether a bank account's check digits hold: letters count from 10, the first four
    characters go last, the remainder by 97 is 1."""
    turned = F.concat(F.substring(account, 5, 40), F.substring(account, 1, 4))

    def step(rest: Column, c: Column) -> Column:
        letter = F.ascii(c) >= 65
        return F.when(letter, rest * 100 + F.ascii(c) - 55).otherwise(rest * 10 + F.ascii(c) - 48) % 97

    return F.aggregate(F.split(turned, ""), F.lit(0), lambda rest, c: F.when(c == "", rest).otherwise(step(rest, c))) == 1


#: A number of at most 255, zeros before it allowed.
_PART = "0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"


def _address(match: Column, *_: Column) -> Column:
    return match.rlike(rf"^{_PART}(?:\.{_PART}){{3}}$")


def _card(match: Column, *_: Column) -> Column:
    return bound(digits_of(match), lambda d: F.when(F.length(d).between(12, 19), luhn(d)).otherwise(False))


def _phone(match: Column, *_: Column) -> Column:
    return F.length(digits_of(match)).between(9, 15)


def _alone(before: Column, after: Column, kind: str) -> Column:
    """Whether no character of ``kind`` (a class) touches the match."""
    return ~F.right(before, F.lit(1)).rlike(kind) & ~F.left(after, F.lit(1)).rlike(kind)


def _account(match: Column, before: Column, after: Column) -> Column:
    return _alone(before, after, "[A-Za-z0-9]") & mod_97(F.translate(match, " ", ""))


def _number(match: Column, before: Column, after: Column) -> Column:
    return _alone(before, after, "[0-9]") & luhn(digits_of(match))


def _telephone(match: Column, before: Column, after: Column) -> Column:
    return _alone(before, after, "[0-9]")


class Kind(NamedTuple):
    name: str
    base: bool
    pattern: str
    valid: Callable[..., Column] | None
    score: float
    words: str  # raise the score
    against: str  # lower it


MONEY_WORDS = "card|visa|mastercard|amex|credit|debit|cvv|karte|carte|tarjeta"
CALL_WORDS = "phone|tel|telephone|call|mobile|cell|fax|telefon|anruf|portable|llame"
OTHER_NUMBERS = "order|invoice|tracking|isbn|serial|version|item|sku"
KINDS = (
    Kind("email", True, r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", None, 0.9, "mail|email|contact|write|address", "example"),
    Kind("ip", True, r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", _address, 0.6, "ip|server|host|address|client|login", "version|section|chapter"),
    Kind("card", True, r"[0-9](?:[\x20-]?[0-9])++", _card, 0.6, MONEY_WORDS, OTHER_NUMBERS),
    Kind("phone", True, r"\+[0-9][\x20().0-9-]+[0-9]", _phone, 0.7, CALL_WORDS, OTHER_NUMBERS),
    Kind("iban", False, r"[A-Z]{2}[0-9]{2}(?:(?:\x20[A-Z0-9]{4}){2,7}(?:\x20[A-Z0-9]{1,3})?|[A-Z0-9]{11,30})", _account, 0.8, "iban|account|bank|konto|compte|cuenta", OTHER_NUMBERS),
    Kind("pan", False, r"(?:[0-9]{4}(?:[\x20-][0-9]{4}){3}|[0-9]{12,19})", _number, 0.6, MONEY_WORDS, OTHER_NUMBERS),
    Kind("tel", False, r"(?:\([0-9]{2,4}\)|0[0-9]{2,4})[\x20.-]?[0-9]{3,4}[\x20.-][0-9]{3,4}", _telephone, 0.3, CALL_WORDS, OTHER_NUMBERS),
)
#: What a text must hold to have a match at all (a cheap test before the pattern).
HOLDS = {"email": "@", "phone": "+", "ip": "."}


def _named(words: str) -> str:
    return f"(?:^|[^a-z])(?:{words})(?:$|[^a-z])"


def proposed(text: Column, kind: Kind, rank: int) -> Column:
    """Confirmed spans of one kind, in order, with their scores."""
    none = F.array().cast(SPANS)

    def spans(pieces: Column) -> Column:
        def step(state: Column, k: Column) -> Column:
            piece, before, after = F.get(pieces, k), F.get(pieces, k - 1), F.get(pieces, k + 1)
            end = state["at"] + F.length(piece)
            near = F.translate(F.concat(F.right(before, F.lit(NEAR)), F.lit(" "), F.left(after, F.lit(NEAR))), UPPER, LOWER)
            score = F.lit(kind.score) + F.when(near.rlike(_named(kind.words)), STEP).otherwise(0.0) - F.when(near.rlike(_named(kind.against)), STEP).otherwise(0.0)
            score = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.round(score, 2)))
            span = F.struct(state["at"].alias("start"), F.lit(rank).alias("rank"), F.lit(kind.name).alias("kind"), end.alias("end"), score.alias("score"), F.lit(kind.base).alias("base"))
            # nothing between two matches: they touch each other
            left = F.when((before == "") & (k > 1), "0").otherwise(before)
            right = F.when((after == "") & (k < F.size(pieces) - 2), "0").otherwise(after)
            good = (k % 2 == 1) if kind.valid is None else F.when(k % 2 == 1, kind.valid(piece, left, right)).otherwise(False)
            return F.struct(end.alias("at"), F.when(good, F.array_append(state["found"], span)).otherwise(state["found"]).alias("found"))

        start = F.struct(F.lit(0).alias("at"), none.alias("found"))
        return F.when(F.size(pieces) > 1, F.aggregate(F.sequence(F.lit(0), F.size(pieces) - 1), start, step, lambda s: s["found"])).otherwise(none)

    marked = F.split(F.regexp_replace(text, F.lit(kind.pattern), F.lit(f"{MARK}$0{MARK}")), MARK, -1)
    found = bound(marked, spans)
    return F.when(F.contains(text, F.lit(HOLDS[kind.name])), found).otherwise(none) if kind.name in HOLDS else found


def find_pii(docs: DataFrame) -> DataFrame:
    """``doc_id, text, spans``: every span as (start, rank, kind, end, score, base), in order
    of start, then kind; ``text`` null counts as empty."""
    clean = F.replace(text_or_empty(), F.lit(MARK), F.lit(MARKED))
    told = docs.select("doc_id", text_or_empty().alias("text"), clean.alias("clean"))
    base = F.concat(*[proposed(F.col("clean"), k, n) for n, k in enumerate(KINDS) if k.base])
    more = F.concat(*[proposed(F.col("clean"), k, n) for n, k in enumerate(KINDS) if not k.base])
    told = told.select("doc_id", "text", base.alias("base"), more.alias("more"))
    free = lambda base: F.filter("more", lambda s: (s["score"] >= LEAST) & ~F.exists(base, lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"])))
    # a text without added proposals (nearly all) skips the comparison
    kept = F.when(F.size("more") > 0, bound(F.col("base"), free)).otherwise(F.col("more"))
    return told.select("doc_id", "text", F.sort_array(F.concat("base", kept)).alias("spans"))


def redacted(found: DataFrame) -> DataFrame:
    """Texts of ``find_pii`` with every span replaced by its kind in brackets (of spans that
    overlap, the first)."""

    def step(state: Column, s: Column) -> Column:
        told = F.concat(state["out"], F.substring(F.col("text"), state["at"] + 1, s["start"] - state["at"]), F.lit("["), s["kind"], F.lit("]"))
        fresh = s["start"] >= state["at"]
        return F.struct(F.when(fresh, s["end"]).otherwise(state["at"]).alias("at"), F.when(fresh, told).otherwise(state["out"]).alias("out"))

    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
    rest = lambda s: F.concat(s["out"], F.substring(F.col("text"), s["at"] + 1, F.length("text")))
    return found.select("doc_id", F.aggregate("spans", start, step, rest).alias("text"))


def told_spans(spans: Column) -> Column:
    """``kind:start:end``, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def pii_report(docs: DataFrame) -> DataFrame:
    """``doc_id, n_email, n_ip, n_card, n_phone`` (base spans), ``base_sha256, spans``."""
    found = find_pii(docs).select("doc_id", "spans")
    of = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    base = told_spans(F.filter("spans", lambda s: s["base"]))
    return found.select("doc_id", *[of(k.name) for k in KINDS if k.base], F.sha2(base.cast("binary"), 256).alias("base_sha256"), told_spans(F.col("spans")).alias("spans"))
