"""Personal data: regular expressions propose spans, checksums confirm them, nearby words adjust the score.

Only DataFrame functions are used. Spans are counted in code points, end exclusive.

Five kinds are found. ``email``, ``ip``, ``card`` and ``phone`` are the base kinds: a proposal is kept when its own test
passes (parts up to 255, Luhn, number of digits), whatever the words around it say; those only move its score.
``iban`` is confirmed by its remainder modulo 97. ``ssn`` (a grouped national number) has no checksum and is kept only
where a context word stands close by.

Nulls and empty texts have no spans. A null id is passed through. Repeated rows are treated one by one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The proposals. Runs are possessive and start where a run starts (or the last match ended), so a text
# of one endless run is read once, not once per position; the matches are those of the plain leftmost search.
LOCAL = "A-Za-z0-9._%+-"
PATTERNS = {
    "email": rf"(?:\G|(?<![{LOCAL}]))[{LOCAL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[ -]?[0-9])++",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]){11,30}(?![A-Za-z0-9])",
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
}
BASE_KINDS = ("email", "ip", "card", "phone")
#: A cheap test that any text with a proposal passes.
MAY_HOLD = {
    "email": lambda t: t.contains("@"),
    "ip": lambda t: t.rlike(r"[0-9]\.[0-9]"),
    "card": lambda t: t.rlike(r"[0-9](?:[ -]?[0-9]){12}"),
    "phone": lambda t: t.rlike(r"\+[0-9]"),
    "iban": lambda t: t.rlike(r"[A-Z]{2}[0-9]{2}"),
    "ssn": lambda t: t.rlike(r"[0-9]-[0-9]{2}-[0-9]"),
}
# Score of a confirmed proposal, and what a context word adds.
SCORES = {"email": 0.8, "ip": 0.6, "card": 0.8, "phone": 0.6, "iban": 0.9, "ssn": 0.3}
CONTEXT_ADDS = 0.2
CONTEXT = {
    "email": r"\b(?:e-?mail|contact|write)\b",
    "ip": r"\b(?:ip|address|server|host)\b",
    "card": r"\b(?:card|credit|visa|payment)\b",
    "phone": r"\b(?:phone|tel|call|mobile|fax)\b",
    "iban": r"\b(?:iban|bank|account|transfer)\b",
    "ssn": r"\b(?:ssn|social security|tax id)\b",
}
ACCEPT = 0.5


def digits_of(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether the last digit is the check digit of the others: every second digit from the right is doubled."""
    ascii_zero = 48
    reversed_digits = F.split(F.reverse(digits), "")
    worth = F.transform(
        reversed_digits,
        lambda d, i: F.when(i % 2 == 0, F.ascii(d) - ascii_zero).otherwise(
            (F.ascii(d) - ascii_zero) * 2 - F.when(F.ascii(d) - ascii_zero > 4, 9).otherwise(0)))
    return F.aggregate(worth, F.lit(0), lambda total, w: total + w) % 10 == 0


def mod97(iban: Column) -> Column:
    """Whether the number, its first four signs moved to the end and letters read as 10 to 35, leaves 1 modulo 97."""
    plain = F.regexp_replace(iban, " ", "")
    moved = F.concat(F.substr(plain, F.lit(5)), F.substr(plain, F.lit(1), F.lit(4)))

    def step(rest: Column, sign: Column) -> Column:
        code = F.ascii(sign)
        return F.when(code < 58, rest * 10 + code - 48).otherwise(rest * 100 + code - 55) % 97

    return F.aggregate(F.split(moved, ""), F.lit(0), step) == 1


def confirmed(kind: str, match: Column) -> Column:
    if kind == "ip":
        return F.forall(F.split(match, r"\."), lambda part: part.rlike("^0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])$"))
    if kind == "card":
        return F.length(digits_of(match)).between(13, 19) & luhn(digits_of(match))
    if kind == "phone":
        return F.length(digits_of(match)).between(9, 15)
    if kind == "iban":
        return mod97(match)
    return F.lit(True)


def places(matches: Column, gaps: Column) -> Column:
    """(start, end) of each match, from the lengths of the matches and of the texts between them."""
    start = F.struct(F.lit(0).alias("at"), F.expr("array()").cast("array<struct<s:int,e:int,m:string>>").alias("found"))

    def step(done: Column, pair: Column) -> Column:
        first = done["at"] + F.length(pair["gaps"])
        last = first + F.length(pair["matches"])
        one = F.struct(first.alias("s"), last.alias("e"), pair["matches"].alias("m"))
        return F.struct(last.alias("at"), F.concat(done["found"], F.array(one)).alias("found"))

    pairs = F.arrays_zip(matches.alias("matches"), F.slice(gaps, 1, F.size(matches)).alias("gaps"))
    return F.aggregate(pairs, start, step, lambda done: done["found"])


def find_spans(docs: DataFrame, near: int = 40) -> DataFrame:
    """(doc_id, spans): spans is an array of (kind, start, end, score, match), by kind and start.

    ``near`` is how many code points before and after a span are searched for context words.
    """
    df = docs.select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias("text"))
    none = F.expr("array()").cast("array<string>")
    held = df.select("*", *[
        F.when(MAY_HOLD[k](F.col("text")), F.regexp_extract_all("text", F.lit(p), F.lit(0))).otherwise(none).alias(f"m_{k}")
        for k, p in PATTERNS.items()])
    gaps = held.select("*", *[
        F.when(F.size(f"m_{k}") > 0, F.split("text", p, -1)).otherwise(none).alias(f"g_{k}") for k, p in PATTERNS.items()])

    def spans_of(kind: str) -> Column:
        found = F.filter(places(F.col(f"m_{kind}"), F.col(f"g_{kind}")), lambda x: confirmed(kind, x["m"]))

        def scored(x: Column) -> Column:
            first = F.greatest(x["s"] - near, F.lit(0))
            around = F.lower(F.concat_ws(" ", F.substr("text", first + 1, x["s"] - first), F.substr("text", x["e"] + 1, F.lit(near))))
            score = F.lit(SCORES[kind]) + F.when(around.rlike(CONTEXT[kind]), CONTEXT_ADDS).otherwise(0.0)
            return F.struct(F.lit(kind).alias("kind"), x["s"].alias("start"), x["e"].alias("end"), score.alias("score"), x["m"].alias("match"))

        ready = F.transform(found, scored)
        return ready if kind in BASE_KINDS else F.filter(ready, lambda x: x["score"] >= ACCEPT)

    empty = F.expr("array()").cast("array<struct<kind:string,start:int,end:int,score:double,match:string>>")
    each = gaps.select("doc_id", *[
        F.when(F.size(f"m_{k}") > 0, spans_of(k)).otherwise(empty).alias(k) for k in PATTERNS])
    return each.select("doc_id", F.concat(*[F.col(k) for k in PATTERNS]).alias("spans"))


def op9_pii(spark, sf_dir: str) -> DataFrame:
    """Per document: counts of the base kinds, the hash of the base spans, and all spans as text."""
    from meterstone.llm.common import table

    found = find_spans(table(spark, sf_dir, "documents"))

    def text_of(spans: Column) -> Column:
        return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")

    def number_of(kind: str) -> Column:
        return F.size(F.filter("spans", lambda x: x["kind"] == kind)).cast("long")

    base = F.filter("spans", lambda x: x["kind"].isin(*BASE_KINDS))
    return found.select(
        "doc_id",
        *[number_of(k).alias(f"n_{k}") for k in BASE_KINDS],
        F.sha2(text_of(base).cast("binary"), 256).alias("base_sha256"), text_of(F.col("spans")).alias("spans"),
        F.transform("spans", lambda x: x["score"]).alias("scores"))
