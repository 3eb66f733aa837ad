"""Personal data and keys: spans, false-positive filters, scores, redaction.

Spans come from built-in functions alone. ``regexp_extract_all`` gives the matches and ``split`` by the same
expression the text between them, so running sums of lengths are the positions; both run only on texts that the
expression matches at all.

Names and places need a language model (``providers.EntityProvider``); without one none are found. Its spans come in
as ``more`` and go through the same filters.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from .risk import level_of_score
from .text import blank

# Entity weights, in the order of their catalogue, and the least confidence.
WEIGHTS = {
    "US_SSN": 1.0,
    "CREDIT_CARD": 1.0,
    "IBAN_CODE": 0.9,
    "CRYPTO": 0.8,
    "US_PASSPORT": 1.0,
    "EMAIL_ADDRESS": 0.5,
    "PHONE_NUMBER": 0.5,
    "PERSON": 0.4,
    "LOCATION": 0.3,
    "IP_ADDRESS": 0.3,
    "OPENAI_API_KEY": 1.0,
    "ANTHROPIC_API_KEY": 1.0,
    "AWS_ACCESS_KEY": 1.0,
    "GITHUB_TOKEN": 1.0,
    "STRIPE_LIVE_KEY": 1.0,
}
OTHER_WEIGHT = 0.3
MIN_CONFIDENCE = 0.3
# What tariff codes and postal codes look like.
HTS_CODE = r"\b\d{4}(?:\.\d{2,4}){1,4}\b"
SCHEDULE_B = r"(?i)schedule[_\s]?b['\"]?\s*[:=]\s*['\"]?(\d{10})\b"
ZIP4 = r"\b\d{5}-\d{4}\b"


@dataclass(frozen=True)
class Recognizer:
    entity: str
    regex: str
    score: float
    check: str = ""  # luhn or iban
    context: str = ""  # a weak match counts if this stands before it


# Expressions and scores of keys, social security numbers and passports.
KEYS = (
    Recognizer("OPENAI_API_KEY", r"sk-(?:proj|svcacct|admin)-[a-zA-Z0-9_\-]{20,}", 0.95),
    Recognizer("OPENAI_API_KEY", r"sk-[a-zA-Z0-9]{48}", 0.95),
    Recognizer("ANTHROPIC_API_KEY", r"sk-ant-[a-zA-Z0-9\-]{90,}", 0.95),
    Recognizer("AWS_ACCESS_KEY", r"(?:AKIA|ASIA|AGPA|AIDA)[0-9A-Z]{16}", 0.95),
    Recognizer("GITHUB_TOKEN", r"gh[posur]_[a-zA-Z0-9]{36,}", 0.95),
    Recognizer("GITHUB_TOKEN", r"github_pat_[a-zA-Z0-9_]{60,}", 0.95),
    Recognizer("STRIPE_LIVE_KEY", r"sk_live_[a-zA-Z0-9]{24,}", 0.95),
)
IDENTITIES = (
    Recognizer("US_SSN", r"\b[0-9]{3}[-. ][0-9]{2}[-. ][0-9]{4}\b", 0.85),
    Recognizer("US_PASSPORT", r"\b[A-Z][0-9]{8}\b", 0.85),
    Recognizer("US_PASSPORT", r"\b[A-Z]{2}[0-9]{7}\b", 0.80),
)
# Shapes of our own. Weak ones have 0.05, or 0.4 with a word of their context in the 40 characters before.
SHAPES = (
    Recognizer("US_SSN", r"\b(?:[0-9]{5}-[0-9]{4}|[0-9]{9})\b", 0.05, context=r"(?i)\b(?:ssns?|social|security)\b[^\n]{0,40}$"),
    Recognizer("US_PASSPORT", r"\b[0-9]{9}\b", 0.05, context=r"(?i)\b(?:passports?|travel document)\b[^\n]{0,40}$"),
    Recognizer("CREDIT_CARD", r"\b[3-6][0-9]{3}(?:[- ]?[0-9]{4}){2}[- ]?[0-9]{1,4}\b", 1.0, check="luhn"),
    Recognizer("IBAN_CODE", r"\b[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?\b", 1.0, check="iban"),
    Recognizer("CRYPTO", r"\b(?:bc1[ac-hj-np-z02-9]{11,71}|[13][a-km-zA-HJ-NP-Z1-9]{25,34})\b", 0.5),
    Recognizer("EMAIL_ADDRESS", r"\b[A-Za-z0-9][A-Za-z0-9._%+-]*@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,24}\b", 1.0),
    Recognizer("PHONE_NUMBER", r"(?:\+1[ .-]?)?(?:\([0-9]{3}\) ?|\b[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}\b", 0.4),
    Recognizer("PHONE_NUMBER", r"\b[0-9]{10}\b", 0.4),
    Recognizer("IP_ADDRESS", r"\b(?:(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])\.){3}(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])\b", 0.6),
)
RECOGNIZERS = KEYS + IDENTITIES + SHAPES
#: Characters before a weak match that hold all that a context can match: 15 of its longest words, 40, a line's end.
CONTEXT = 64
SPAN = "array<struct<entity:string,start:int,end:int,score:double,value:string>>"


def spans_of(text: Column, regex: str, group: int = 0) -> Column:
    """array<struct<start, end, value>> of all matches, in order; positions count characters.

    With ``group`` the span is that of the group, which must stand at the end of the match.
    """
    every, between = F.regexp_extract_all(text, F.lit(regex), F.lit(0)), F.split(text, regex, -1)
    inner = F.regexp_extract_all(text, F.lit(regex), F.lit(group)) if group else every
    parts = F.arrays_zip(F.slice(between, 1, F.size(every)).alias("gap"), every.alias("all"), inner.alias("value"))
    begin = F.struct(F.lit(0).alias("at"), F.expr("cast(array() as array<struct<start:int,end:int,value:string>>)").alias("out"))

    def step(s, x):
        end = s["at"] + F.length(x["gap"]) + F.length(x["all"])
        span = F.struct((end - F.length(x["value"])).alias("start"), end.alias("end"), x["value"].alias("value"))
        return F.struct(end.alias("at"), F.concat(s["out"], F.array(span)).alias("out"))

    return F.when(text.rlike(regex), F.aggregate(parts, begin, step, lambda s: s["out"]))


def iban_valid(value: Column) -> Column:
    """ISO 7064 mod 97 of a candidate."""
    plain = F.replace(value, F.lit(" "), F.lit(""))
    turned = F.concat(F.substring(plain, 5, 34), F.substring(plain, 1, 4))
    digit = lambda c: F.when(c.rlike("[0-9]"), c.cast("int")).otherwise(F.ascii(c) - 55)
    rest = F.aggregate(F.split(turned, ""), F.lit(0), lambda s, c: F.when(c == "", s).otherwise(F.pmod(s * F.when(digit(c) > 9, 100).otherwise(10) + digit(c), F.lit(97))))
    return rest == 1


def _recognized(text: Column, r: Recognizer) -> Column:
    found = spans_of(text, r.regex)
    if r.check == "luhn":
        found = F.filter(found, lambda x: F.call_function("luhn_check", F.regexp_replace(x["value"], "[^0-9]", "")))
    elif r.check == "iban":
        found = F.filter(found, lambda x: iban_valid(x["value"]))
    before = lambda x: F.substring(text, F.greatest(x["start"] - CONTEXT, F.lit(0)) + 1, F.least(x["start"], F.lit(CONTEXT)))
    score = (lambda x: F.when(before(x).rlike(r.context), 0.4).otherwise(r.score)) if r.context else (lambda x: F.lit(r.score))
    return F.coalesce(F.transform(found, lambda x: F.struct(F.lit(r.entity).alias("entity"), x["start"].alias("start"), x["end"].alias("end"), score(x).alias("score"), x["value"].alias("value"))), F.expr(f"cast(array() as {SPAN})"))


def overlaps(a: Column, b: Column) -> Column:
    """Half-open intervals that share a position."""
    return (a["start"] < b["end"]) & (b["start"] < a["end"])


def drop_tariff_phones(spans: Column, text: Column) -> Column:
    """Without PHONE_NUMBER spans that are tariff codes.

    Those overlap a dotted code or the value of a schedule_b field, or have the digits of a dotted code of at
    least 8 digits elsewhere in the text.
    """
    none = F.expr("cast(array() as array<struct<start:int,end:int,value:string>>)")
    dotted = F.coalesce(spans_of(text, HTS_CODE), none)
    values = F.coalesce(spans_of(text, SCHEDULE_B, 1), none)
    digits = F.filter(F.transform(dotted, lambda z: F.regexp_replace(z["value"], "\\D", "")), lambda d: F.length(d) >= 8)
    wrong = lambda s: F.exists(F.concat(dotted, values), lambda z: overlaps(s, z)) | F.array_contains(digits, F.regexp_replace(s["value"], "\\D", ""))
    kept = F.filter(spans, lambda s: (s["entity"] != "PHONE_NUMBER") | ~wrong(s))
    return F.when(text.rlike(HTS_CODE) | text.rlike(SCHEDULE_B), kept).otherwise(spans)


def drop_zip_numbers(spans: Column, text: Column) -> Column:
    """Without US_SSN spans that overlap a ZIP+4 code."""
    codes = spans_of(text, ZIP4)
    kept = F.filter(spans, lambda s: (s["entity"] != "US_SSN") | ~F.exists(codes, lambda z: overlaps(s, z)))
    return F.when(text.rlike(ZIP4), kept).otherwise(spans)


def raw_spans(text: Column, ignore: Column | None = None, recognizers: Sequence[Recognizer] = RECOGNIZERS, more: Column | None = None) -> Column:
    """All spans before the filters; ``ignore``: entity types that are not looked for; ``more``: spans of a provider."""
    # One expression decides whether a text can hold anything; most texts end here.
    some = text.rlike("@|[0-9]{3}|sk-|sk_live|gh[posur]_|github_pat|(?:AKIA|ASIA|AGPA|AIDA)|[0-9]\\.[0-9]|bc1") & ~blank(text)
    found = F.concat(*(_recognized(text, r) for r in recognizers))
    found = F.when(some, found).otherwise(F.expr(f"cast(array() as {SPAN})"))
    if more is not None:
        found = F.concat(found, more)
    return found if ignore is None else F.filter(found, lambda s: ~F.array_contains(F.coalesce(ignore, F.expr("cast(array() as array<string>)")), s["entity"]))


def pii_spans(text: Column, ignore: Column | None = None, recognizers: Sequence[Recognizer] = RECOGNIZERS, more: Column | None = None) -> Column:
    found = drop_zip_numbers(drop_tariff_phones(raw_spans(text, ignore, recognizers, more), text), text)
    return F.filter(found, lambda s: s["score"] >= MIN_CONFIDENCE)


def entities(spans: Column) -> Column:
    """Distinct entity types, sorted."""
    return F.array_sort(F.array_distinct(F.transform(spans, lambda s: s["entity"])))


def entity_score(types: Column) -> Column:
    """The largest weight of the types; 0 without any."""
    weights = F.create_map(*(F.lit(x) for kv in WEIGHTS.items() for x in kv))
    return F.coalesce(F.array_max(F.transform(types, lambda e: F.coalesce(weights[e], F.lit(OTHER_WEIGHT)))), F.lit(0.0))


def redact(text: Column, spans: Column) -> Column:
    """``text`` with <ENTITY> for each span; of spans that overlap, the surer and then the longer one counts."""
    ordered = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), (-s["end"]).alias("back"), s["end"].alias("end"), s["score"].alias("score"), s["entity"].alias("entity"))))
    none = F.expr("cast(array() as array<struct<start:int,back:int,end:int,score:double,entity:string>>)")

    def keep(out, s):
        last = F.element_at(out, -1)
        better = (s["score"] > last["score"]) | ((s["score"] == last["score"]) & (s["end"] - s["start"] > last["end"] - last["start"]))
        return F.when(F.size(out) == 0, F.array(s)).when(s["start"] >= last["end"], F.concat(out, F.array(s))).when(better, F.concat(F.slice(out, 1, F.size(out) - 1), F.array(s))).otherwise(out)

    chosen = F.aggregate(ordered, none, keep)
    begin = F.struct(F.lit("").alias("out"), F.lit(0).alias("at"))
    step = lambda s, x: F.struct(F.concat(s["out"], F.substring(text, s["at"] + 1, x["start"] - s["at"]), F.lit("<"), x["entity"], F.lit(">")).alias("out"), x["end"].alias("at"))
    done = F.aggregate(chosen, begin, step, lambda s: F.concat(s["out"], F.substring(text, s["at"] + 1, F.length(text))))
    return F.when(F.size(spans) > 0, done).otherwise(F.coalesce(text, F.lit("")))


def pii_result(text: Column, spans: Column) -> Column:
    """struct(entities, score, level, redacted)."""
    types = entities(spans)
    score = entity_score(types)
    return F.struct(types.alias("entities"), score.alias("score"), level_of_score(score).alias("level"), redact(text, spans).alias("redacted"))
