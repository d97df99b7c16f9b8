"""Personal data: patterns propose spans, checksums confirm them, words nearby adjust their score. Column expressions only."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Kinds in output order. A possessive run that starts only where its class starts, or where the last match
# ended (\G), finds the same leftmost spans as the plain pattern and stays linear on long runs; possessive groups are matched in a
# loop, where greedy ones would use up the stack.
EMAIL = r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?:(?<![0-9])|\G)[0-9]++(?:\.[0-9]+){3}"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
IBAN = r"[A-Z]{2}[0-9]{2}[A-Z0-9]{11,30}"
SSN = r"[0-9]{3}-[0-9]{2}-[0-9]{4}"
OCTETS = r"^0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])(?:\.0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])){3}$"
WINDOW = 40  # code points looked at on either side for context words


@dataclass(frozen=True)
class Kind:
    name: str
    pattern: str
    guard: str  # one character, or a pattern; implied by the kind's pattern: a text without it has no span of the kind
    base: float  # score of a confirmed span
    context: str  # words that raise the score by RAISE
    accept: float  # least score to be reported


RAISE = 0.3
KINDS = (
    Kind("email", EMAIL, "@", 0.7, "mail|e-mail|email|contact|write", 0.0),
    Kind("ip", IP, ".", 0.6, "ip|host|server|address|client", 0.0),
    Kind("card", CARD, r"[0-9][\x20-]?[0-9]", 0.7, "card|credit|visa|payment|pay", 0.0),
    Kind("phone", PHONE, "+", 0.6, "phone|call|tel|mobile|fax", 0.0),
    Kind("iban", IBAN, "[0-9]{2}", 0.7, "iban|bank|account|transfer", 0.6),
    Kind("ssn", SSN, "-", 0.4, "ssn|social|security|tax", 0.6),
)
BASE = ("email", "ip", "card", "phone")


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def _luhn(m: Column) -> Column:
    d = _digits(m)
    n = F.length(d)

    def add(total: Column, i: Column) -> Column:
        v = F.substring(d, n - i, F.lit(1)).cast("int") * (F.lit(1) + i % 2)
        return total + F.when(v > 9, v - 9).otherwise(v)

    total = F.aggregate(F.sequence(F.lit(0), n - 1), F.lit(0), add)
    return F.when(n.between(13, 19), total % 10 == 0).otherwise(False)


def _mod97(m: Column) -> Column:
    turned = F.concat(F.substring(m, 5, 40), F.substring(m, 1, 4))

    def step(rest: Column, c: Column) -> Column:
        v = F.ascii(c)
        return F.when(v >= 65, (rest * 100 + v - 55) % 97).otherwise((rest * 10 + v - 48) % 97)

    return F.aggregate(F.split(turned, ""), F.lit(0), lambda r, c: F.when(c == "", r).otherwise(step(r, c))) == 1


def _alone(before: Column, after: Column) -> Column:
    return ~F.substring(before, -1, 1).rlike("[A-Za-z0-9]") & ~F.substring(after, 1, 1).rlike("[A-Za-z0-9]")


def _confirmed(kind: str, m: Column, before: Column, after: Column) -> Column:
    if kind == "ip":
        return m.rlike(OCTETS)
    if kind == "card":
        return _luhn(m)
    if kind == "phone":
        return F.length(_digits(m)).between(9, 15)
    if kind == "iban":
        return _alone(before, after) & _mod97(m)
    if kind == "ssn":
        return _alone(before, after)
    return F.lit(True)


def _starts(steps: Column, n: Column) -> Column:
    """Running sums of an array in n * sqrt(n) steps."""
    width = F.ceil(F.sqrt(n)).cast("int")
    blocks = F.transform(
        F.sequence(F.lit(0), F.ceil(n / width).cast("int") - 1),
        lambda k: F.aggregate(F.slice(steps, k * width + 1, width), F.lit(0), lambda a, x: a + x),
    )
    offsets = F.transform(blocks, lambda _, k: F.aggregate(F.slice(blocks, F.lit(1), k), F.lit(0), lambda a, x: a + x))
    return F.flatten(
        F.transform(
            offsets,
            lambda base, k: F.transform(
                F.slice(steps, k * width + 1, width),
                lambda _, j: base + F.aggregate(F.slice(steps, k * width + 1, j + 1), F.lit(0), lambda a, x: a + x),
            ),
        )
    )


def _kind_spans(df: DataFrame, kind: Kind) -> DataFrame:
    """Add column _<kind>: array of (kind, start, end, score) of the accepted spans, by start."""
    text, m, p, s = F.col("_text"), F.col("_m"), F.col("_p"), F.col("_s")
    has = text.contains(kind.guard) if len(kind.guard) == 1 else text.rlike(kind.guard)
    none = F.array().cast("array<string>")
    df = df.withColumn("_m", F.when(has, F.regexp_extract_all(text, F.lit(kind.pattern), 0)).otherwise(none))
    df = df.withColumn("_p", F.when(F.size(m) > 0, F.split(text, kind.pattern, -1)).otherwise(none))
    # length of the text between the start of a match and the start of the one before
    lengths = F.concat(F.array(F.lit(0)), F.transform(m, F.length))
    df = df.withColumn("_s", F.zip_with(F.transform(F.slice(p, F.lit(1), F.size(m)), F.length), F.slice(lengths, F.lit(1), F.size(m)), lambda a, b: a + b))
    df = df.withColumn("_at", F.when(F.size(s) > 0, _starts(s, F.size(s))).otherwise(F.array().cast("array<int>")))
    near = rf"(?i)(?:^|[^A-Za-z])(?:{kind.context})(?:$|[^A-Za-z])"

    def span(z: Column) -> Column:
        hint = F.concat(F.right(z["before"], F.lit(WINDOW)), F.lit(" "), F.left(z["after"], F.lit(WINDOW))).rlike(near)
        return F.struct(
            F.lit(kind.name).alias("kind"),
            z["at"].alias("start"),
            (z["at"] + F.length(z["m"])).alias("end"),
            F.when(_confirmed(kind.name, z["m"], z["before"], z["after"]), F.lit(kind.base) + F.when(hint, RAISE).otherwise(0.0))
            .otherwise(-1.0).alias("score"),
        )

    zipped = F.arrays_zip(
        m.alias("m"), F.slice(p, F.lit(1), F.size(m)).alias("before"), F.slice(p, F.lit(2), F.size(m)).alias("after"), F.col("_at").alias("at"),
    )
    found = F.filter(F.transform(zipped, span), lambda x: x["score"] >= F.lit(kind.accept))
    return df.withColumn(f"_{kind.name}", F.when(F.size(m) > 0, found).otherwise(F.array().cast("array<struct<kind:string,start:int,end:int,score:double>>"))).drop("_m", "_p", "_s", "_at")


def find_spans(df: DataFrame, column: str = "text", out: str = "spans") -> DataFrame:
    """Add ``out``: array of (kind, start, end, score), by kind and then start; code points, end exclusive.

    A null or empty text has no span. Repeated rows give repeated results; other columns stay, and a column named like the
    output is replaced. Base kinds are reported whenever their check holds; iban and ssn need a score of 0.6.
    """
    kept = [c for c in df.columns if c != out]
    work = df.select(F.struct(*[F.col(f"`{c}`") for c in kept]).alias("_row"), F.coalesce(F.col(f"`{column}`"), F.lit("")).alias("_text"))
    for kind in KINDS:
        work = _kind_spans(work, kind)
    return work.select("_row.*", F.concat(*[F.col(f"_{k.name}") for k in KINDS]).alias(out))


def joined(spans: Column) -> Column:
    """kind:start:end of all spans, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def mask(df: DataFrame, column: str = "text", spans: str = "spans") -> DataFrame:
    """Replace every reported span by its kind in brackets; of overlapping spans the union is replaced, named by the first."""
    text, found = F.coalesce(F.col(column), F.lit("")), F.array_sort(
        F.col(spans),
        lambda a, b: F.when(a["start"] != b["start"], a["start"] - b["start"]).otherwise(b["end"] - a["end"]),
    )
    empty = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("parts"))

    def cut(state: Column, s: Column) -> Column:
        return F.when(
            s["start"] >= state["at"],
            F.struct(s["end"].alias("at"), F.concat(state["parts"], F.array(
                F.substring(text, state["at"] + 1, s["start"] - state["at"]), F.concat(F.lit("["), s["kind"], F.lit("]")))).alias("parts")),
        ).otherwise(F.struct(F.greatest(state["at"], s["end"]).alias("at"), state["parts"].alias("parts")))

    whole = F.aggregate(found, empty, cut, lambda z: F.concat(F.array_join(z["parts"], ""), F.substring(text, z["at"] + 1, F.length(text))))
    return df.withColumn(column, F.when(F.size(spans) > 0, whole).otherwise(F.col(column)))
