"""Personal data by DataFrame expressions only: patterns propose spans, checksums confirm them, nearby words move the score.

The four base kinds follow fixed rules and always stay. Two kinds more are proposed by looser patterns: an account number must
pass its mod-97 check, and a national number without "+" needs a word near it that speaks of phones to reach KEEP. All
patterns use possessive repeats and start only where a run of their characters starts, so that Java's matcher neither
recurses nor rescans long runs.
"""

from __future__ import annotations

from functools import partial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scriptorium.llm.common import texts_of

BASE_KINDS = ("email", "ip", "card", "phone")
MORE_KINDS = ("iban", "call")
KINDS = BASE_KINDS + MORE_KINDS

#: What the kinds' patterns accept; each is the plain rule with possessive repeats and a start at a run's start.
PATTERNS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[ -]?[0-9])++",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}+(?: ?[A-Z0-9]{1,3})?+(?![A-Za-z0-9])",
    "call": r"(?<![A-Za-z0-9+.-])\(?[0-9]{3}\)?[ .-][0-9]{3}[.-][0-9]{4}(?![A-Za-z0-9-])",
}
#: What each kind scores by its pattern and check, and how much a word near it adds.
PRIOR = {"email": 0.9, "ip": 0.7, "card": 0.85, "phone": 0.75, "iban": 0.9, "call": 0.4}
NEARBY = {
    "email": ("mail", "contact", "write to"),
    "ip": ("ip", "host", "server", "address"),
    "card": ("card", "visa", "payment", "credit"),
    "phone": ("phone", "call", "tel", "mobile", "fax"),
    "iban": ("iban", "account", "bank"),
    "call": ("phone", "call", "tel", "mobile", "fax"),
}
BOOST = 0.3
#: Kinds that the patterns only propose stay at this score; characters before and after a span where words count as near.
KEEP = 0.6
REACH = 48

_SPAN = "array<struct<kind:string,start:int,end:int,value:string,score:double>>"


def digits_of(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes Luhn's check."""
    n = F.length(digits)
    digit = lambda i: F.substring(digits, n - i + 1, F.lit(1)).cast("int")
    worth = lambda i: F.when(i % 2 == 1, digit(i)).otherwise(digit(i) * 2 - F.when(digit(i) > 4, 9).otherwise(0))
    return F.aggregate(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), F.lit(0), lambda acc, i: acc + F.coalesce(worth(i), F.lit(0))) % 10 == 0


def mod97(value: Column) -> Column:
    """Whether an account number leaves 1 modulo 97, its first four characters moved behind and letters counted from 10."""
    plain = F.replace(value, F.lit(" "), F.lit(""))
    turned = F.split(F.concat(F.substring(plain, F.lit(5), F.length(plain)), F.substring(plain, 1, 4)), "(?<=.)(?=.)")
    number = lambda c: F.when(c.between("0", "9"), F.ascii(c) - 48).otherwise(F.ascii(c) - 55)
    return F.aggregate(turned, F.lit(0), lambda acc, c: (acc * F.when(c.between("0", "9"), 10).otherwise(100) + number(c)) % 97) == 1


def _confirmed(kind: str, value: Column) -> Column:
    n = F.length(digits_of(value))
    if kind == "ip":
        return value.rlike(r"^(?:0*(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])(?:\.|$)){4}$")
    if kind == "card":
        return n.between(16, 19) & luhn(digits_of(value))
    if kind == "phone":
        return n.between(8, 15)
    if kind == "iban":
        return F.length(F.replace(value, F.lit(" "), F.lit(""))).between(15, 34) & mod97(value)
    return F.lit(True)


def _passes(kind: str, span: Column) -> Column:
    return _confirmed(kind, span["value"])


def _may_have(kind: str, text: Column) -> Column:
    if kind == "email":
        return text.contains("@")
    if kind == "phone":
        return text.contains("+")
    return F.col("has_digit")


def _spans(kind: str, text: Column, values: Column) -> Column:
    """Spans of all matches by the lengths of matches and of what split() leaves between them, before any check."""
    between = F.split(text, PATTERNS[kind], -1)
    rows = F.arrays_zip(values.alias("value"), between.alias("gap"))
    start = F.struct(F.lit(0).alias("at"), F.array().cast(_SPAN).alias("spans"))

    def step(acc: Column, x: Column) -> Column:
        at = acc["at"] + F.length(x["gap"])
        end = at + F.length(x["value"])
        span = F.struct(F.lit(kind).alias("kind"), at.alias("start"), end.alias("end"), x["value"].alias("value"), F.lit(0.0).alias("score"))
        return F.struct(F.coalesce(end, at).alias("at"), F.when(x["value"].isNull(), acc["spans"]).otherwise(F.concat(acc["spans"], F.array(span))).alias("spans"))

    return F.aggregate(rows, start, step, lambda acc: acc["spans"])


def _scored(kind: str, text: Column, span: Column) -> Column:
    low = F.greatest(span["start"] - REACH, F.lit(0))
    near = F.lower(F.concat(F.substring(text, low + 1, span["start"] - low), F.lit(" "), F.substring(text, span["end"] + 1, F.lit(REACH))))
    found = F.lit(False)
    for word in NEARBY[kind]:
        found = found | near.contains(word)
    score = F.least(F.lit(1.0), F.lit(PRIOR[kind]) + F.when(found, BOOST).otherwise(0.0))
    return F.struct(span["kind"].alias("kind"), span["start"].alias("start"), span["end"].alias("end"), span["value"].alias("value"), score.alias("score"))


def find_spans(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with a column pii: spans (kind, start, end, value, score) by kind, then start; offsets in code points, end exclusive.

    A null or empty text has none. docs must not have columns pii, has_digit or pii_<kind> itself; redact() and report() take any columns.
    """
    none = F.array().cast(_SPAN)
    out = docs.withColumn("has_digit", F.coalesce(F.col(text).rlike("[0-9]"), F.lit(False)))
    own = F.col(text)
    for kind in KINDS:
        out = out.withColumn(f"pii_{kind}", F.when(_may_have(kind, own), F.regexp_extract_all(own, F.lit(PATTERNS[kind]), F.lit(0))))
    spans = []
    for kind in KINDS:
        values = F.col(f"pii_{kind}")
        kept = F.filter(_spans(kind, own, values), partial(_passes, kind))
        kept = F.transform(kept, partial(_scored, kind, own))
        if kind in MORE_KINDS:
            kept = F.filter(kept, lambda s: s["score"] >= KEEP)
        spans.append(F.when(F.size(F.coalesce(values, F.array().cast("array<string>"))) > 0, kept).otherwise(none))
    return out.withColumn("pii", F.concat(*spans)).drop("has_digit", *(f"pii_{kind}" for kind in KINDS))


def report(docs: DataFrame) -> DataFrame:
    """Per row of docs (doc_id, text): counts and digest of the base kinds, all spans as kind:start:end, and their scores."""
    found = find_spans(texts_of(docs)).select("doc_id", "pii")
    named = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    count = lambda kind: F.size(F.filter("pii", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    base = F.filter("pii", lambda s: s["kind"].isin(*BASE_KINDS))
    scores = F.array_join(F.transform("pii", lambda s: F.format_number(s["score"], 2)), ",")
    return found.select("doc_id", *(count(kind) for kind in BASE_KINDS), F.sha2(named(base), 256).alias("base_sha256"), named(F.col("pii")).alias("spans"), scores.alias("scores"))


def redact(docs: DataFrame) -> DataFrame:
    """docs with each span of its text replaced by its kind in brackets; overlapping spans become one, of the kind that starts first.

    A null text stays null; all other columns stay as they are, whatever their names. An empty table gives no rows.
    """
    found = find_spans(docs.select(F.struct(*docs.columns).alias("whole"), "text"))
    ordered = F.array_sort(F.transform("pii", lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))))
    text = F.col("text")
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(acc: Column, s: Column) -> Column:
        fresh = s["start"] >= acc["at"]
        out = F.concat(acc["out"], F.substring(text, acc["at"] + 1, s["start"] - acc["at"]), F.lit("["), F.upper(s["kind"]), F.lit("]"))
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), F.when(fresh, out).otherwise(acc["out"]).alias("out"))

    clean = F.aggregate(ordered, start, step, lambda acc: F.concat(acc["out"], F.substring(text, acc["at"] + 1, F.length(text))))
    masked = F.when(F.size("pii") > 0, clean).otherwise(text)
    return found.select(*(masked.alias(c) if c == "text" else F.col("whole")[c].alias(c) for c in docs.columns))
