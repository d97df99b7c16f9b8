"""Scalar text rules: ids, colours, themes, prompts, set numbers, HTML fields and LDraw tokens."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from brickloom.functions.geometry import cell, identity
from brickloom.functions.numbers import fixed_text, let
from brickloom.lookups import ALLOWED_PARTS, MECABRICKS_COLORS, MECABRICKS_PARTS


def _map(rows: list[tuple]) -> Column:
    return F.create_map(*[F.lit(v) for row in rows for v in row])


def map_part_id(part: Column) -> Column:
    """Mecabricks part id -> LDraw file name."""
    clean = F.lower(F.trim(part))
    return F.when(clean.endswith(".dat"), clean).otherwise(
        F.coalesce(F.try_element_at(_map(MECABRICKS_PARTS), clean), F.concat(clean, F.lit(".dat")))
    )


def map_color_id(color: Column) -> Column:
    """Exact name, else the first known name inside it, else digits, else light gray."""
    clean = F.lower(F.trim(color))
    first = F.coalesce(*[F.when(clean.contains(name), code) for name, code in MECABRICKS_COLORS])
    digits = F.when(clean.rlike(r"^\d+$"), clean.try_cast("int"))
    exact = F.try_element_at(_map(MECABRICKS_COLORS), clean)
    return F.when(color.isNull() | (color == ""), 7).otherwise(F.coalesce(exact, first, digits, F.lit(7)))


def convert_matrix(matrix: Column, scale: float = 2500.0) -> Column:
    """Y-up 16-value matrix -> Y-down transform; anything but 16 values gives the identity."""
    sign = [1.0, -1.0, -1.0]
    rows = []
    for i in range(3):
        rows += [cell(matrix, i, j) * (sign[i] * sign[j]) for j in range(3)]
        rows.append(cell(matrix, i, 3) * (sign[i] * scale))
    whole = F.array(*[v.cast("double") for v in rows], *[F.lit(v) for v in (0.0, 0.0, 0.0, 1.0)])
    return F.when(F.size(matrix) == 16, whole).otherwise(identity())


# Theme families in match order.
FAMILIES = [
    ("Space", "star wars|space|mars|galaxy|rocket|shuttle"),
    ("Vehicles", "car|truck|vehicle|speed|technic|train|racer"),
    ("Structures", "castle|house|building|modular|city|creator|station|shop"),
    ("Creatures", "bionicle|mech|robot|creature|beast|dino|animal"),
]


def theme_family(theme: Column) -> Column:
    low = F.lower(theme)
    return F.coalesce(*[F.when(low.rlike(p), name) for name, p in FAMILIES], F.lit("Other"))


def set_number(name: Column) -> Column:
    """``9999-<n>`` of synthetic sets, else the leading digits, else the name."""
    synthetic = F.nullif(F.regexp_extract(name, r"^(9999-[0-9]+)", 1), F.lit(""))
    digits = F.nullif(F.regexp_extract(name, r"^([0-9]+)", 1), F.lit(""))
    return F.coalesce(F.when(name.startswith("9999-"), F.coalesce(synthetic, name)), digits, name)


def set_number_dashed(name: Column) -> Column:
    """``<n>-<m>`` prefix, else the name."""
    return F.coalesce(F.nullif(F.regexp_extract(name, r"^([0-9]+-[0-9]+)", 1), F.lit("")), name)


def prompt_color(prompt: Column) -> Column:
    low = F.lower(prompt)
    return F.when(low.rlike("roja|rojo|red"), 4).when(low.rlike("azul|blue"), 1).when(low.rlike("verde|green"), 2).otherwise(14)


def prompt_inventory(prompt: Column) -> Column:
    low = F.lower(prompt)
    chair = _map([("3001.dat", 2), ("3004.dat", 2), ("3005.dat", 2)])
    tower = _map([("3001.dat", 3), ("3004.dat", 2)])
    return F.when(low.rlike("silla|chair"), chair).when(low.rlike("torre|tower"), tower)


def prompt_pieces(prompt: Column, asked: int = 6) -> Column:
    low = F.lower(prompt)
    return F.when(low.rlike("silla|chair"), 6).when(low.rlike("torre|tower"), 5).otherwise(asked)


def absolute_url(url: Column) -> Column:
    return F.when(url.startswith("http"), url).when(url.startswith("//"), F.concat(F.lit("https:"), url)).otherwise(url)


def source_from_path(path: Column) -> Column:
    return F.when(F.lower(path).contains("bricklink"), "BrickLink").otherwise("OMR")


def source_from_id(name: Column) -> Column:
    return F.when(name.contains("omr"), "OMR").otherwise("Local")


def labelled_count(text: Column, label: str) -> Column:
    """``1,234 Label`` -> 1234, 0 when absent."""
    hit = F.regexp_extract(text, rf"(?i)([\d,]+)\s*{label}", 1)
    return F.coalesce(F.regexp_replace(hit, ",", "").try_cast("int"), F.lit(0))


def digits_only(text: Column) -> Column:
    return F.coalesce(F.regexp_replace(text, r"\D", "").try_cast("int"), F.lit(0))


def count_codes(text: Column) -> Column:
    """Number of 6 to 7 digit codes."""
    return F.size(F.regexp_extract_all(text, F.lit(r"\b(\d{6,7})\b"), F.lit(1)))


# --- LDraw tokens ---------------------------------------------------------------------------------


def _ldraw_line(line: Column) -> Column:
    """Normal form of one line, NULL when it is dropped."""

    def body(tok: Column) -> Column:
        at = lambda k: F.get(tok, F.lit(k))
        whole = [F.rint(at(k).try_cast("double")).cast("long").cast("string") for k in (2, 3, 4)]
        rot = F.transform(F.slice(tok, 6, 9), lambda t: fixed_text(t.try_cast("double"), 2))
        step = (at(0) == "0") & (F.upper(at(1)) == "STEP")
        part = (at(0) == "1") & (F.size(tok) >= 15)
        return F.when(step, "0 STEP").when(
            part, F.concat_ws(" ", F.lit("1"), at(1), *whole, F.array_join(rot, " "), F.lower(at(14)))
        )

    return let(F.split(F.regexp_replace(line, r"^\s+|\s+$", ""), r"\s+"), body)


def ldraw_normalize(text: Column) -> Column:
    """Keep steps and parts, positions rounded half-even to whole units, rotations to two decimals."""
    lines = F.transform(F.split(text, "\n"), lambda s: _ldraw_line(s))
    return F.array_join(F.filter(lines, lambda s: s.isNotNull()), "\n")


# Special tokens and rotation texts around the integer range -500..499.
SPECIALS = ["[PAD]", "[UNK]", "[BOS]", "[EOS]", "0", "STEP"]
ROTATIONS = ["1.0", "0.0", "-1.0", "1.00", "0.00", "-1.00"]


def token_vocabulary() -> list[str]:
    return [*SPECIALS, *[str(i) for i in range(-500, 500)], *ROTATIONS, *ALLOWED_PARTS]


def _word_id(word: Column) -> Column:
    """Vocabulary position by rule: specials, integers, rotations, parts; 1 when unknown."""
    base = len(SPECIALS)
    # a number is a word only as it is written by itself: no sign of zero, no leading zeros
    in_range = let(word.try_cast("int"), lambda n: F.when(n.between(-500, 499) & (n.cast("string") == word), n + 500 + base))
    ids = {w: i for i, w in enumerate(token_vocabulary()) if not w.lstrip("-").isdigit()}

    def named(fits) -> Column:
        return F.try_element_at(_map([(w, i) for w, i in ids.items() if fits(w)]), word)

    # the ending tells which few names a word can be, so most words meet neither the pattern nor the list of parts
    known = (
        F.when(word.endswith(".dat"), named(lambda w: w.endswith(".dat")))
        .when(word.contains("."), named(lambda w: "." in w and not w.endswith(".dat")))
        .otherwise(F.coalesce(in_range, named(lambda w: "." not in w)))
    )
    return F.coalesce(known, F.lit(1))


def _whole_ids(tokens: Column) -> Column:
    """Ids of coordinates rounded half-even to whole numbers, by arithmetic; what is no number leaves no word."""
    whole = F.transform(tokens, lambda t: F.rint(t.try_cast("double")).try_cast("long"))
    return F.transform(whole, lambda n: F.when(n.between(-500, 499), (n + 500 + len(SPECIALS)).cast("int")).when(n.isNotNull(), 1))


def _rotation_ids(tokens: Column) -> Column:
    """Ids of rotation entries with two decimals, by their ranges.

    The doubles nearest to 0.995 and 1.005 lie below these numbers and that nearest to 0.005 above, which decides whether the bound itself
    belongs to the range. Minus zero has a text of its own, which is no word.
    """
    base = len(SPECIALS) + 1000 + 3

    def one(v: Column, token: Column) -> Column:
        unit = (F.abs(v) > 0.995) & (F.abs(v) <= 1.005)
        return F.when(unit, F.when(v > 0, base).otherwise(base + 2)).when((F.abs(v) < 0.005) & ~token.startswith("-"), base + 1).otherwise(1)

    return F.zip_with(F.transform(tokens, lambda t: t.try_cast("double")), tokens, one)


def _line_ids(line: Column) -> Column:
    """Ids of one line and of its end, NULL when the line is dropped; a coordinate that is no number leaves no word."""

    def body(tok: Column) -> Column:
        at = lambda k: F.get(tok, F.lit(k))
        one, step = F.lit(1 + 500 + len(SPECIALS)), F.array(F.lit(500 + len(SPECIALS)), F.lit(5), F.lit(1))
        ids = [F.array(one, _word_id(at(1))), _whole_ids(F.slice(tok, 3, 3)), _rotation_ids(F.slice(tok, 6, 9)), F.array(_word_id(F.lower(at(14))), F.lit(1))]
        part = F.array_compact(F.concat(*ids))
        return F.when((at(0) == "1") & (F.size(tok) >= 15), part).when((at(0) == "0") & (F.upper(at(1)) == "STEP"), step)

    return let(F.split(F.btrim(line, F.lit(" \t\n\x0b\f\r")), r"\s+"), body)


def ldraw_encode(text: Column) -> Column:
    """Token ids: begin, every line's words followed by one unknown (the line break), end.

    The ids are those of the words of ``ldraw_normalize``, without going through its text.
    """
    lines = F.filter(F.transform(F.split(text, "\n"), lambda s: _line_ids(s)), lambda ids: ids.isNotNull())
    # a text without lines is one empty line
    ids = let(lines, lambda found: F.when(F.size(found) > 0, F.flatten(found)).when(found.isNotNull(), F.array(F.lit(1))))
    return F.concat(F.array(F.lit(2)), ids, F.array(F.lit(3)))


def ldraw_decode(ids: Column) -> Column:
    """Words of the ids without the four markers; line breaks are not recoverable."""
    base, spread = len(SPECIALS), 1000
    tail = F.array(*[F.lit(w) for w in [*ROTATIONS, *ALLOWED_PARTS]])
    head = F.array(F.lit("0"), F.lit("STEP"))

    def word(i: Column) -> Column:
        return (
            F.when(i.between(4, 5), F.get(head, i - 4))
            .when(i.between(base, base + spread - 1), (i - base - 500).cast("string"))
            .when(i >= base + spread, F.get(tail, i - base - spread))
        )

    return F.array_join(F.filter(F.transform(ids, lambda i: word(i)), lambda w: w.isNotNull()), " ")
