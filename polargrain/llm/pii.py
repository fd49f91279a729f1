"""Personal data in texts, in DataFrame functions only (no Python in the plan).

Regular expressions propose spans, checksums confirm them (Luhn for cards, mod 97 for
IBANs), and words near a span move its score (raising words on both sides, lowering words
before it). The four base kinds (email, ip, card, phone)
stay whatever their score; the added kinds (iban, local_phone) stay from ``threshold`` on,
so a number without a country code only counts next to a word such as "phone".

Positions come from splitting a text by the pattern that also extracts the matches: the
lengths of the pieces before a match and of the earlier matches sum to its start; the sums
are formed block by block, in close to linear time for any number of matches. Patterns
are written without repeated groups and with start guards, so that they run in linear time
and constant stack on very long texts while matching the same spans as the plain patterns
that each comment gives.

Defined results: null text counts as empty and has no spans; spans of different kinds may
overlap; each row of the input gives its row, repeated doc_ids included; other columns are
ignored; an empty table gives no rows.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from polargrain.llm.common import table

SPAN = "array<struct<s:int,e:int,score:double>>"
NEAR = 40
# a part of an address, 0 to 255 with any leading zeros
OCTET = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"
LOCAL = "[A-Za-z0-9._%+-]"


@dataclass(frozen=True)
class Kind:
    name: str
    base: bool
    pattern: str
    gate: str  # a cheap pattern that every match contains
    score: float
    raised_by: str
    lowered_by: str


KINDS = (
    # [A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+
    Kind("email", True, rf"(?:(?<!{LOCAL})|\G){LOCAL}++@[A-Za-z0-9-]++\.[A-Za-z0-9-][A-Za-z0-9.-]*?(?=\.(?![A-Za-z0-9-])|[^A-Za-z0-9.-]|\z)", "@", 0.9, r"mail|contact|write|from|to", r"example"),
    # [0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)
    Kind("ip", True, r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", r"[0-9]\.[0-9]", 0.6, r"ip|host|address|server", r"version|release|v"),
    # [0-9]([\x20-]?[0-9])+
    Kind("card", True, r"[0-9](?=[\x20-]?[0-9])[0-9\x20-]*?(?=[\x20-](?![0-9])|[^0-9\x20-]|\z)", r"[0-9][\x20-]?[0-9]", 0.7, r"card|visa|credit|debit|payment", r"order|serial|isbn"),
    # \+[0-9][\x20().0-9-]+[0-9]
    Kind("phone", True, r"\+[0-9][\x20().0-9-]+[0-9]", r"\+[0-9]", 0.7, r"phone|tel|call|fax|mobile", r"order|serial"),
    Kind("iban", False, r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:[A-Z0-9]{11,30}|(?: [A-Z0-9]{4}){2,7}(?: [A-Z0-9]{1,3})?)(?![A-Za-z0-9])", r"[A-Z]{2}[0-9]{2}", 0.6, r"iban|account|bank|konto|compte|cuenta", r"serial|key|token"),
    Kind("local_phone", False, r"(?<![0-9+.-])(?:\([0-9]{3}\) ?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}(?![0-9])", r"[0-9]{3}[ .-][0-9]{4}", 0.3, r"phone|tel|call|fax|mobile", r"order|serial"),
)


def _luhn(digits: Column) -> Column:
    def term(i: Column) -> Column:
        d = F.substring(digits, F.length(digits) - i, F.lit(1)).cast("int")
        return F.when(i % 2 == 0, d).otherwise(d * 2 - F.when(d > 4, 9).otherwise(0))

    terms = F.transform(F.sequence(F.lit(0), F.length(digits) - 1), term)
    return F.aggregate(terms, F.lit(0), lambda a, x: a + x) % 10 == 0


def _mod97(text: Column) -> Column:
    plain = F.regexp_replace(text, " ", "")
    turned = F.concat(F.substring(plain, F.lit(5), F.length(plain)), F.substring(plain, 1, 4))

    def step(a: Column, c: Column) -> Column:
        code = F.ascii(c)
        return F.when(code < 58, (a * 10 + code - 48) % 97).otherwise((a * 100 + code - 55) % 97)

    return F.aggregate(F.filter(F.split(turned, ""), lambda c: c != ""), F.lit(0), step) == 1


def _valid(kind: str, match: Column) -> Column:
    digits = F.regexp_replace(match, "[^0-9]", "")
    if kind == "ip":
        return match.rlike(rf"^{OCTET}\.{OCTET}\.{OCTET}\.{OCTET}$")
    if kind == "card":
        return F.when(F.length(digits).between(16, 19), _luhn(digits)).otherwise(False)
    if kind == "phone":
        return F.length(digits).between(8, 15)
    if kind == "iban":
        return _mod97(match)
    return F.lit(True)


def _let(value: Column, use) -> Column:
    """``use`` of a value that is computed once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _running(steps: Column, block: int = 128) -> Column:
    """Sums of all leading parts of an array.

    An appending fold copies its array at every step, so only blocks are folded, and their
    sums: n steps cost about n * block + (n / block) ** 2 / 2 copied numbers.
    """
    longs = lambda c: F.transform(c, lambda x: x.cast("long"))
    append = lambda out, x: F.concat(out, F.array(F.coalesce(F.try_element_at(out, F.lit(-1)), F.lit(0).cast("long")) + x))
    none = F.array().cast("array<long>")
    numbers = F.sequence(F.lit(0), F.floor((F.size(steps) - 1) / block).cast("int"))
    part = lambda k: F.slice(steps, k * block + 1, F.lit(block))
    sums = F.transform(numbers, lambda k: F.aggregate(longs(part(k)), F.lit(0).cast("long"), lambda a, x: a + x))
    before = F.aggregate(sums, none, append)
    inner = lambda ends: F.flatten(F.transform(numbers, lambda k: _let(ends[k] - F.aggregate(longs(part(k)), F.lit(0).cast("long"), lambda a, x: a + x), lambda at: F.transform(F.aggregate(longs(part(k)), none, append), lambda x: x + at))))
    return _let(before, inner)


def _spans(kind: Kind, pieces: Column, matches: Column, threshold: float) -> Column:
    """Confirmed spans of one kind, in order, with scores."""

    def one(match: Column, i: Column, ends: Column) -> Column:
        before, after, end = pieces[i], pieces[i + 1], ends[i].cast("int")
        near = F.concat_ws(" ", F.right(before, F.lit(NEAR)), F.left(after, F.lit(NEAR)))
        raised = F.when(near.rlike(rf"(?i)(?<![a-z])(?:{kind.raised_by})(?![a-z])"), 0.25).otherwise(0.0)
        lowered = F.when(F.right(before, F.lit(NEAR)).rlike(rf"(?i)(?<![a-z])(?:{kind.lowered_by})(?![a-z])"), 0.25).otherwise(0.0)
        score = F.least(F.lit(1.0), F.lit(kind.score) + raised - lowered)
        return F.struct((end - F.length(match)).alias("s"), end.alias("e"), score.alias("score"), _valid(kind.name, match).alias("valid"))

    steps = F.transform(matches, lambda m, i: F.length(pieces[i]) + F.length(m))
    placed = _let(steps, lambda held: _let(_running(held), lambda ends: F.transform(matches, lambda m, i: one(m, i, ends))))
    keep = lambda x: x["valid"] if kind.base else x["valid"] & (x["score"] >= threshold)
    found = F.transform(F.filter(placed, keep), lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e"), x["score"].alias("score")))
    return F.when(F.size(matches) > 0, found).otherwise(F.array().cast(SPAN))


def find_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """Per row: doc_id and an array of confirmed spans (s, e, score) for every kind."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("t"))
    for kind in KINDS:
        gate = F.col("t").contains("@") if kind.gate == "@" else F.col("t").rlike(kind.gate)
        rows = rows.withColumn(f"m_{kind.name}", F.when(gate, F.regexp_extract_all("t", F.lit(kind.pattern), F.lit(0))).otherwise(F.array().cast("array<string>")))
    for kind in KINDS:
        some = F.size(f"m_{kind.name}") > 0
        rows = rows.withColumn(f"p_{kind.name}", F.when(some, F.split("t", kind.pattern, -1)).otherwise(F.array().cast("array<string>")))
    return rows.select("doc_id", *[_spans(k, F.col(f"p_{k.name}"), F.col(f"m_{k.name}"), threshold).alias(k.name) for k in KINDS])


def _written(kinds: tuple[Kind, ...]) -> Column:
    def each(kind: Kind) -> Column:
        return F.transform(F.col(kind.name), lambda x: F.concat_ws(":", F.lit(kind.name), x["s"].cast("string"), x["e"].cast("string")))

    return F.array_join(F.concat(*map(each, kinds)), ",")


def pii_digest(docs: DataFrame, **options) -> DataFrame:
    """Counts of the base kinds, a digest of the base spans, and all spans with their scores."""
    found = find_pii(docs, **options)
    base = tuple(k for k in KINDS if k.base)
    scores = F.concat(*[F.transform(F.col(k.name), lambda x: x["score"].cast("decimal(3,2)").cast("string")) for k in KINDS])
    counts = [F.size(k.name).cast("long").alias(f"n_{k.name}") for k in base]
    return found.select("doc_id", *counts, F.sha2(_written(base), 256).alias("base_sha256"), _written(KINDS).alias("spans"), F.array_join(scores, ",").alias("scores"))


def op7_pii(spark, sf_dir: str) -> DataFrame:
    return pii_digest(table(spark, sf_dir, "documents"))
