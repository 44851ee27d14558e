"""Personal data: patterns propose spans, checksums confirm them, nearby words adjust the score.

Every kind has a pattern; its matches, leftmost and not overlapping, are proposals. A check
(parts of an address, number of digits, Luhn, mod-97, ranges of national ids) confirms or
drops each, without another try inside a dropped one. A confirmed span scores its kind's base;
a context word of the kind (in English, German, French or Spanish) in the CONTEXT characters
before or after adds CONTEXT_BONUS. Spans of THRESHOLD or more stay. The four kinds of BASE
and ibans pass by their check alone, and the bonus tells how sure they are; national ids and
short cards (13 to 15 digits, Luhn) need a context word as well.

All of it is built of Spark's own functions. Patterns start only where a match can start
leftmost, and repeat possessively where nothing follows; places of matches are sums of the
lengths before them, made block by block; context is cut out of the text in UTF-32, where
every place is known. So time stays linear in long runs and, but for a very small part, in
the number of matches. A text is searched for a kind only if it holds a character the kind
can't do without. Spans are in code points, end exclusive.

Cases: null text counts as empty and has no spans. Very long texts are searched whole.
Repeated rows are searched each. An empty table gives an empty result. Other columns, and
whatever their names, are left alone.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from entivore.llm.common import table

CONTEXT, CONTEXT_BONUS, THRESHOLD = 40, 0.4, 0.5
#: Matches whose lengths are summed at a time.
BLOCK = 64


@dataclass(frozen=True)
class Kind:
    name: str
    pattern: str
    needs: str  # the text must match it
    check: str
    base: float  # score of a confirmed span
    words: str  # context, lower case


_RUN = r"(?:(?<![{0}])|\G)"
_LOCAL = r"A-Za-z0-9._%+-"
KINDS = (
    Kind("email", _RUN.format(_LOCAL) + rf"[{_LOCAL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", "@", "any", 0.9, "mail|contact|kontakt|correo|courriel|write|schreib|escri|écri"),
    Kind("ip", _RUN.format("0-9") + r"[0-9]++(?:\.[0-9]++){3}", r"[0-9]\.[0-9]", "ip", 0.7, r"\bip\b|serve[ru]|servidor|host|addres|adres|direcci"),
    Kind("card", r"[0-9](?:[\x20-]?[0-9])++", r"[0-9]", "card", 0.8, "card|karte|carte|tarjeta|visa|[ck]r[eé]dit|payment|zahlung|paiement|pago"),
    Kind("phone", r"\+[0-9][\x20().0-9-]+[0-9]", r"\+[0-9]", "phone", 0.6, "phone|call|tel[eé:. ]|tél|mobile|móvil|handy|anruf|appel|llam"),
    Kind("iban", r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])", r"[A-Z]{2}[0-9]{2}", "mod97", 0.9, "iban|account|ban[ckq]|konto|compte|cuenta"),
    Kind("national_id", r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])", r"[0-9]-[0-9]{2}-[0-9]", "national_id", 0.2, r"ssn|social|security|sozial|sécurité|seguridad|ausweis|\bdni\b|\bid\b"),
    Kind("short_card", r"(?<![0-9+.-])[0-9](?:[\x20-]?[0-9]){12,14}(?![0-9.-])", r"[0-9]", "short_card", 0.2, "card|karte|carte|tarjeta|visa|amex|[ck]r[eé]dit|payment|zahlung|paiement|pago"),
)
BASE = ("email", "ip", "card", "phone")


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    def step(acc, i):
        d = F.substr(digits, F.length(digits) - i, F.lit(1)).cast("int")
        twice = F.when(d > 4, d * 2 - 9).otherwise(d * 2)
        return acc + F.when(i % 2 == 1, twice).otherwise(d)

    return F.aggregate(F.sequence(F.lit(0), F.length(digits) - 1), F.lit(0), step) % 10 == 0


def _mod97(m: Column) -> Column:
    value = F.regexp_replace(m, " ", "")
    turned = F.concat(F.substr(value, F.lit(5)), F.substr(value, F.lit(1), F.lit(4)))

    def step(acc, c):
        n = F.when(c.rlike("[0-9]"), F.ascii(c) - 48).otherwise(F.ascii(c) - 55)
        return F.when(n > 9, acc * 100 + n).otherwise(acc * 10 + n) % 97

    return F.aggregate(F.split(turned, ""), F.lit(0), step) == 1


def _part_fits(p: Column) -> Column:
    short = F.regexp_replace(p, "^0+", "")
    return (F.length(short) < 3) | ((F.length(short) == 3) & (short <= "255"))


def _confirmed(check: str, m: Column) -> Column:
    n = F.length(_digits(m))
    return {
        "any": lambda: F.lit(True),
        "ip": lambda: F.forall(F.split(m, r"\."), _part_fits),
        "card": lambda: F.when(n.between(16, 19), _luhn(_digits(m))).otherwise(F.lit(False)),
        "short_card": lambda: F.when(n.between(13, 15), _luhn(_digits(m))).otherwise(F.lit(False)),
        "phone": lambda: n.between(8, 15),
        "mod97": lambda: _mod97(m),
        "national_id": lambda: ~m.rlike("^(?:000|666|9)|-00-|-0000$"),
    }[check]()


def _let(value: Column, use) -> Column:
    """use(value), with value made once."""
    return F.transform(F.array(value), use)[0]


def _before(values: Column, join) -> Column:
    """For each of the integers values: join (a sum, a maximum) of 0 and all before it."""

    def over(part: Column) -> Column:
        return F.aggregate(part, F.lit(0), join)

    def block(b: Column) -> Column:
        return F.slice(values, b * BLOCK + 1, F.lit(BLOCK))

    blocks = F.sequence(F.lit(0), ((F.size(values) - 1) / BLOCK).cast("int"))

    def within(totals: Column) -> Column:
        return F.flatten(F.transform(blocks, lambda b: _let(F.struct(block(b).alias("part"), over(F.slice(totals, F.lit(1), b)).alias("so_far")), lambda x: F.transform(x["part"], lambda _, i: join(x["so_far"], over(F.slice(x["part"], F.lit(1), i)))))))

    return F.when(F.size(values) > 0, _let(F.transform(blocks, lambda b: over(block(b))), within)).otherwise(F.array().cast("array<int>"))


def _cut(wide: Column, start: Column, end: Column) -> Column:
    """The text from start to end, given in UTF-32."""
    start = F.greatest(start, F.lit(0))
    return F.decode(F.substr(wide, 4 * start + 1, 4 * (end - start)), "UTF-32")


def _spans(text: Column, kind: Kind) -> Column:
    """array<struct<start, end, score>> of the kind's confirmed spans, by start.

    The pieces between matches, split by the same pattern, give the places of the matches."""
    none = F.array().cast("array<struct<start:int,end:int,score:double>>")
    found = F.struct(F.split(text, kind.pattern, -1).alias("gaps"), F.regexp_extract_all(text, F.lit(kind.pattern), F.lit(0)).alias("hits"))

    def placed(x: Column) -> Column:
        lengths = F.transform(x["hits"], lambda h, i: F.length(F.get(x["gaps"], i)) + F.length(h))
        at = _let(lengths, lambda v: _before(v, lambda a, b: a + b))
        at = _let(at, lambda before: F.transform(x["hits"], lambda h, i: F.struct((F.get(before, i) + F.length(F.get(x["gaps"], i))).alias("start"), h.alias("hit"))))
        return F.filter(at, lambda s: F.coalesce(_confirmed(kind.check, s["hit"]), F.lit(False)))

    def scored(wide: Column, s: Column) -> Column:
        start, end = s["start"], s["start"] + F.length(s["hit"])
        near = F.lower(F.concat(_cut(wide, start - CONTEXT, start), F.lit(" "), _cut(wide, end, end + CONTEXT)))
        score = F.lit(kind.base) + F.when(near.rlike(kind.words), CONTEXT_BONUS).otherwise(0.0)
        return F.struct(start.cast("int").alias("start"), end.cast("int").alias("end"), score.cast("double").alias("score"))

    spans = _let(_let(found, placed), lambda hits: F.when(F.size(hits) > 0, _let(F.encode(text, "UTF-32"), lambda wide: F.transform(hits, lambda s: scored(wide, s)))).otherwise(none))
    return F.when(text.rlike(kind.needs), F.filter(spans, lambda s: s["score"] >= THRESHOLD)).otherwise(none)


def find(docs: DataFrame) -> DataFrame:
    """doc_id, text and an array of spans per kind."""
    return docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).select("doc_id", "text", *[_spans(F.col("text"), k).alias(k.name) for k in KINDS])


def _each(kind: Kind, form) -> Column:
    return F.transform(kind.name, lambda s: form(kind.name, s))


def redacted(found: DataFrame) -> DataFrame:
    """doc_id and the text with each span replaced by its kind in angle brackets; spans that begin inside another are covered by it."""
    every = F.array_sort(F.concat(*[_each(k, lambda name, s: F.struct(s["start"].alias("start"), (-s["end"]).alias("back"), F.lit(name).alias("kind"))) for k in KINDS]))
    made = found.select("doc_id", "text", every.alias("spans"), F.encode("text", "UTF-32").alias("wide"))
    made = made.withColumn("ends", F.transform("spans", lambda s: (-s["back"]).cast("int")))
    made = made.withColumn("at", _before(F.col("ends"), lambda a, b: F.greatest(a, b)))
    parts = F.transform("spans", lambda s, i: F.when(s["start"] >= F.get("at", i), F.concat(_cut(F.col("wide"), F.get("at", i), s["start"]), F.lit("<"), s["kind"], F.lit(">"))).otherwise(""))
    last = _cut(F.col("wide"), F.coalesce(F.array_max("ends"), F.lit(0)), F.length("text"))
    return made.select("doc_id", F.concat(F.array_join(parts, ""), last).alias("text"))


def _listed(names) -> Column:
    parts = [_each(k, lambda name, s: F.concat_ws(":", F.lit(name), s["start"].cast("string"), s["end"].cast("string"))) for k in KINDS if k.name in names]
    return F.array_join(F.concat(*parts), ",")


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find(table(spark, sf_dir, "documents"))
    counts = [F.size(k).cast("long").alias(f"n_{k}") for k in BASE]
    return found.select("doc_id", *counts, F.sha2(_listed(BASE).cast("binary"), 256).alias("base_sha256"), _listed([k.name for k in KINDS]).alias("spans"), F.array_join(F.concat(*[_each(k, lambda _, s: F.format_string("%.1f", s["score"])) for k in KINDS]), ",").alias("scores"))
