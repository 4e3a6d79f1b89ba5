"""Personal data: patterns propose spans, checksums confirm them, words nearby move the score.

All of it is column expressions. Spark has no function that gives the places of all matches, but
splitting a text at a pattern gives what lies between them: the running sums of the lengths of
both are the places. The patterns are written so that every engine step goes forward (possessive
quantifiers, starts that cannot lie inside a run), so a text of any kind takes linear time.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

# Kinds in the order in which spans are listed; the first four are the base.
BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "iban")

# An e-mail's local part starts where its run of characters does, or right after the match before.
PATTERNS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9](?:[\x20().-]*+[0-9])++",
    "iban": r"[A-Z]{2}[0-9]{2}(?:[A-Z0-9]{11,30}|(?:\x20[A-Z0-9]{4}){2,7}(?:\x20[A-Z0-9]{1,3})?)",
}
# A text without this has no match.
NEEDS = {"email": "@", "ip": ".", "phone": "+"}
# Score of a confirmed span, and words that raise it when they stand nearby.
SCORES = {"email": 0.9, "ip": 0.6, "card": 0.8, "phone": 0.6, "iban": 0.9}
CONTEXT = {
    "email": "mail|contact|write|kontakt|correo|courriel",
    "ip": "ip|address|host|server|login",
    "card": "card|visa|mastercard|amex|credit|payment|karte|tarjeta|carte",
    "phone": "phone|tel|call|mobile|fax|telefon|appel",
    "iban": "iban|account|bank|konto|cuenta|compte",
}
# Code points looked at to either side, what a word nearby adds, and what digits around a number take away.
NEARBY, RAISE, LOWER = 40, 0.1, 0.2
BLOCK = 256
STEP = "array<struct<gap:int,size:int,value:string>>"


def digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(number: Column) -> Column:
    """Does a string of digits pass the Luhn check?"""
    n = F.length(number)

    def add(total: Column, i: Column) -> Column:
        d = F.substring(number, n - i, F.lit(1)).cast("int")
        twice = d * 2
        return total + F.when(i % 2 == 0, d).when(twice > 9, twice - 9).otherwise(twice)

    return F.aggregate(F.sequence(F.lit(0), n - 1), F.lit(0), add) % 10 == 0


def mod97(account: Column) -> Column:
    """Does an account number (letters A-Z and digits) leave 1 when divided by 97, its first four characters put last?"""
    turned = F.concat(F.substring(account, F.lit(5), F.length(account)), F.substring(account, 1, 4))

    def add(rest: Column, i: Column) -> Column:
        code = F.ascii(F.substring(turned, i, F.lit(1)))
        return F.when(code < 65, rest * 10 + code - 48).otherwise(rest * 100 + code - 55) % 97

    return F.aggregate(F.sequence(F.lit(1), F.length(turned)), F.lit(0), add) == 1


def confirmed(kind: str, value: Column) -> Column:
    if kind == "ip":
        plain = F.regexp_replace(value, "(?<![0-9])0+(?=[0-9])", "")
        return F.forall(F.split(plain, "\\."), lambda p: (F.length(p) <= 3) & (F.try_to_number(p, F.lit("999")) <= 255))
    if kind == "card":
        return F.when(F.length(digits(value)).between(13, 19), luhn(digits(value))).otherwise(False)
    if kind == "phone":
        return F.length(digits(value)).between(9, 15)
    if kind == "iban":
        return mod97(F.replace(value, F.lit(" "), F.lit("")))
    return F.lit(True)


def matches(rows: DataFrame, kind: str, text: str = "text") -> DataFrame:
    """``rows`` with column ``kind``: an array of (start, stop, value) of all matches, confirmed or not."""
    pattern = PATTERNS[kind]
    t = F.col(text)
    none = F.array().cast("array<string>")
    found = F.regexp_extract_all(t, F.lit(pattern), F.lit(0))
    if kind in NEEDS:
        found = F.when(F.contains(t, F.lit(NEEDS[kind])), found).otherwise(none)
    some = F.size("_found") > 0
    steps = F.zip_with(F.slice(F.split(t, pattern, -1), F.lit(1), F.size("_found")), F.col("_found"),
                       lambda b, m: F.struct(F.length(b).alias("gap"), F.length(m).alias("size"), m.alias("value")))
    blocks = F.transform(F.sequence(F.lit(0), ((F.size("_steps") - 1) / BLOCK).cast("int")),
                         lambda k: F.slice(F.col("_steps"), k * BLOCK + 1, F.lit(BLOCK)))
    ends = F.aggregate("_blocks", F.array(F.lit(0)), lambda acc, b: F.concat(acc, F.array(
        F.element_at(acc, -1) + F.aggregate(b, F.lit(0), lambda s, x: s + x["gap"] + x["size"]))))

    def locate(block: Column, start: Column) -> Column:
        empty = F.array().cast("array<struct<start:int,stop:int,value:string>>")
        return F.aggregate(
            block, F.struct(start.alias("at"), empty.alias("out")),
            lambda acc, x: F.struct(
                (acc["at"] + x["gap"] + x["size"]).alias("at"),
                F.concat(acc["out"], F.array(F.struct(
                    (acc["at"] + x["gap"]).alias("start"), (acc["at"] + x["gap"] + x["size"]).alias("stop"),
                    x["value"].alias("value")))).alias("out")),
            lambda acc: acc["out"])

    # Each step is a column that the next uses more than once, so that none is computed again.
    return (rows.withColumn("_found", found)
            .withColumn("_steps", F.when(some, steps).otherwise(F.array().cast(STEP)))
            .withColumn("_blocks", F.when(F.size("_steps") > 0, blocks).otherwise(F.array().cast(f"array<{STEP}>")))
            .withColumn("_starts", ends)
            .withColumn(kind, F.flatten(F.zip_with("_blocks", F.slice("_starts", F.lit(1), F.size("_blocks")), locate)))
            .drop("_found", "_steps", "_blocks", "_starts"))


def _scored(kind: str, text: Column, span: Column) -> Column:
    before = F.lower(F.substring(text, F.greatest(F.lit(1), span["start"] - NEARBY + 1), F.least(F.lit(NEARBY), span["start"])))
    behind = F.lower(F.substring(text, span["stop"] + 1, F.lit(NEARBY)))
    words = rf"(?<![a-z])(?:{CONTEXT[kind]})"
    near = F.rlike(before, F.lit(words)) | F.rlike(behind, F.lit(words))
    # A number among other digits is more likely part of a table or a serial number.
    crowded = F.rlike(before, F.lit(r"[0-9]{4}[\x20.-]?$")) if kind in ("ip", "card", "phone") else F.lit(False)
    score = F.lit(SCORES[kind]) + F.when(near, F.lit(RAISE)).otherwise(0.0) - F.when(crowded, F.lit(LOWER)).otherwise(0.0)
    return F.struct(F.lit(kind).alias("kind"), span["start"].alias("start"), span["stop"].alias("stop"),
                    span["value"].alias("value"), F.round(score, 2).alias("score"))


def find_spans(docs: DataFrame) -> DataFrame:
    """``docs`` with ``spans``: kind, start, stop (code points, end exclusive), value and score of each.

    By kind as in ``KINDS``, then start. A null or empty text has none. Kinds are independent of
    each other, so spans of two kinds may overlap. A column named ``spans`` is replaced.
    """
    rows = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), F.coalesce(docs["text"], F.lit("")).alias("text"))
    for kind in KINDS:
        rows = matches(rows, kind)
    def scored(kind: str) -> Column:
        return F.transform(F.filter(kind, lambda s: confirmed(kind, s["value"])), lambda s: _scored(kind, F.col("text"), s))

    spans = [scored(kind) for kind in KINDS]
    return rows.select(*[F.col("row").getField(c).alias(c) for c in docs.columns if c.lower() != "spans"],
                       F.concat(*spans).alias("spans"))


def redact(docs: DataFrame, score: float = 0.0) -> DataFrame:
    """``docs`` with every span of at least ``score`` replaced by its kind in angle brackets.

    Of overlapping spans the one that starts first is replaced, then the longer one.
    """
    found = find_spans(docs)
    chosen = F.array_sort(F.filter("spans", lambda s: s["score"] >= score),
                          lambda a, b: F.when(a["start"] != b["start"], a["start"] - b["start"]).otherwise(b["stop"] - a["stop"]))
    # From left to right: what is done so far, and where the rest starts.
    done = F.aggregate(
        chosen, F.struct(F.lit("").alias("out"), F.lit(0).alias("at")),
        lambda acc, s: F.when(s["start"] < acc["at"], acc).otherwise(F.struct(
            F.concat(acc["out"], F.substring(F.col("text"), acc["at"] + 1, s["start"] - acc["at"]), F.lit("<"), s["kind"], F.lit(">")).alias("out"),
            s["stop"].alias("at"))))
    return (found.withColumn("_done", done)
            .withColumn("text", F.when(F.size(chosen) == 0, F.col("text")).otherwise(
                F.concat("_done.out", F.substring(F.col("text"), F.col("_done.at") + 1, F.length("text")))))
            .drop("_done", "spans"))


def listed(spans: Column, kinds: tuple[str, ...] = KINDS) -> Column:
    """Spans of these kinds as ``kind:start:end``, joined by commas."""
    own = F.filter(spans, lambda s: reduce(lambda a, b: a | b, [s["kind"] == k for k in kinds]))
    return F.array_join(F.transform(own, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["stop"].cast("string"))), ",")


def count_of(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")
