"""Fixed lookup values, as plain text, and small tables built from them.

All tables here are bounded by this file, so joining them with a broadcast is always safe.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# The standard part vocabulary, in index order.
ALLOWED_PARTS = """
3005 3004 3003 3002 3001 3010 3009 3008 3007 3006 3024 3023 3022 3021 3020 3710 3666 3460 3032 3031
3030 3035 3034 3832 3062b 3941 3036 3958 3005p01 3004p01 3003p01 3010p01
""".split()
ALLOWED_PARTS = [f"{p}.dat" for p in ALLOWED_PARTS]
ALLOWED_COLORS = list(range(16))

# Part id, width, height, depth in LDU.
PART_DIMENSIONS = """
3005 20 24 20
3004 20 24 40
3003 40 24 40
3002 40 24 60
3001 40 24 80
3010 20 24 80
3009 20 24 120
3008 20 24 160
3007 40 24 160
3006 40 24 200
3024 20 8 20
3023 20 8 40
3022 40 8 40
3021 40 8 60
3020 40 8 80
3710 20 8 80
3666 20 8 120
3460 20 8 160
3032 80 8 120
3031 80 8 80
3030 80 8 200
3035 80 8 160
3034 40 8 160
3832 40 8 200
3062b 20 24 20
3941 40 24 40
3036 120 8 160
3958 120 8 120
3005p01 20 24 20
3004p01 20 24 40
3003p01 40 24 40
3010p01 20 24 80
3070 20 8 20
3069 20 8 40
63864 20 8 60
15573 20 8 40
26601 40 8 40
11477 20 16 40
15556 10 24 10
28697 10 64 10
28701 20 24 20
35338 20 16 20
35380 20 8 20
35480 20 8 40
35787 40 8 40
3665 20 24 40
41769 40 8 80
41770 40 8 80
41822 80 8 80
42610 20 16 20
4274 10 20 10
42923 20 8 40
48205 80 8 120
48208 80 8 120
50340 20 8 40
5091 20 8 40
5092 20 8 40
51483 20 8 80
5414 20 24 80
5415 20 24 80
65426 40 8 80
65429 40 8 80
69754 20 8 40
69755 20 8 20
76382 20 24 10
111870 20 24 20
112754 20 24 20
112755 40 24 40
32803 40 16 40
79491 40 8 40
""".strip().splitlines()
PART_DIMENSIONS = [
    (f"{p}.dat", float(w), float(h), float(d))
    for p, w, h, d in (line.split() for line in PART_DIMENSIONS)
]

# Part id and display name.
PART_NAMES = """
3070 Flat Tile 1x1
3069 Flat Tile 1x2
3794 Plate 1x2 W. 1 Knob
70501c Coin No. 3
3003 Brick 2x2
3001 Brick 2x4
3005 Brick 1x1
3010 Brick 1x4
3034 Plate 2x8
3021 Plate 2x3
15573 Plate 1x2 W. 1 Knob
26601 Plate 2x2 Corner 45 Deg.
11477 Plate W. Bow 1x2x2/3
15556 Light Sword Shaft
28697 Light Sword Blade
28701 Nose Cone Small 1x1
32803 Brick 2x2x2/3 Inverted Bow
35338 Roof Tile 1x1x2/3
35380 Flat Tile 1x1 Round
35480 Plate 1x2 Rounded
35787 Tile 2x2 W. 45 Cut
3665 Roof Tile 1x2 Inv.
41769 Right Plate 2x4 W. Angle
41770 Left Plate 2x4 W. Angle
41822 Plate 4x4 W. Angle
42610 Hub 11.2x7.84
4274 Connector Peg W. Knob
42923 Plate 2x1 W. Holder Vertical
48205 Right Plate 4x6
48208 Left Plate 4x6
50340 Plate 1x2 W. Fork Vertical
5091 Tile 1x2 Cut Left
5092 Tile 1x2 Cut Right
51483 Plate 1x4 W. Stumps Vertical
5414 Brick 1x4x1 Half Bow Right
5415 Brick 1x4x1 Half Bow Left
65426 Right Plate 2x4
65429 Left Plate 2x4
69754 Plate 1x2 W. Shooter
69755 Trigger No. 1
76382 Mini Upper Torso
111870 Mini Creature Head
112754 Mini Legs
112755 Final Brick 2x2
79491 Plate 2x2 1/4 Circle
""".strip().splitlines()
PART_NAMES = [(f"{i}.dat", n) for i, n in (line.split(" ", 1) for line in PART_NAMES)]

# Colour code and display hex.
COLOR_HEX = [
    (0, "#1b1c1e"),
    (1, "#1e3a8a"),
    (2, "#15803d"),
    (4, "#b91c1c"),
    (6, "#78350f"),
    (7, "#94a3b8"),
    (8, "#475569"),
    (9, "#60a5fa"),
    (14, "#eab308"),
    (15, "#f8fafc"),
    (25, "#f97316"),
    (26, "#d946ef"),
    (29, "#f472b6"),
    (73, "#3b82f6"),
    (272, "#1e40af"),
    (378, "#86efac"),
]
DEFAULT_HEX = "#cbd5e1"

# Mecabricks part ids that map to themselves plus ".dat" or to a renamed file.
MECABRICKS_PARTS = [
    ("3005", "3005.dat"), ("3004", "3004.dat"), ("3003", "3003.dat"), ("3002", "3002.dat"), ("3001", "3001.dat"), ("3010", "3010.dat"),
    ("3009", "3009.dat"), ("3008", "3008.dat"), ("3007", "3007.dat"), ("3006", "3006.dat"), ("3024", "3024.dat"), ("3023", "3023.dat"),
    ("3022", "3022.dat"), ("3021", "3021.dat"), ("3020", "3020.dat"), ("3710", "3710.dat"), ("3666", "3666.dat"), ("3460", "3460.dat"),
    ("3032", "3032.dat"), ("3031", "3031.dat"), ("3030", "3030.dat"), ("3035", "3035.dat"), ("3034", "3034.dat"), ("3832", "3832.dat"),
    ("3036", "3036.dat"), ("3958", "3958.dat"), ("3062", "3062b.dat"), ("3062b", "3062b.dat"), ("3941", "3941.dat"),
]

# Mecabricks colour names in match order.
MECABRICKS_COLORS = """
black 0
blue 1
green 2
red 4
brown 6
light_gray 7
dark_gray 8
light_blue 9
bright_green 10
light_green 11
yellow 14
white 15
orange 25
magenta 26
pink 29
medium_blue 73
dark_blue 272
sand_green 378
solid_black 0
solid_blue 1
solid_green 2
solid_red 4
solid_light_gray 7
solid_dark_gray 8
solid_yellow 14
solid_white 15
""".strip().splitlines()
MECABRICKS_COLORS = [(n, int(c)) for n, c in (line.split() for line in MECABRICKS_COLORS)]

# Wheel and cabin parts of the vehicle rules.
WHEEL_PARTS = """
3139 42610 56902 30027 18976 18977 55981 55982 30285 6014 6015 56890 56891 30285b 6014b
""".split()
WHEEL_PARTS = [f"{p}.dat" for p in WHEEL_PARTS]
CABIN_PARTS = ["3823.dat", "3829.dat", "3829c01.dat"]

# Parts and words of the vehicle filter.
VEHICLE_PARTS = [
    *WHEEL_PARTS,
    *[f"{p}.dat" for p in "2926 4150 4274 3829 3829c01 50745 98282 30029".split()],
]
VEHICLE_TYRES = [f"{p}.dat" for p in "3139 30027 6015 18977 56890 56891".split()]
VEHICLE_KEYWORDS = """
car truck rover racer buggy vehicle tractor kart roadster formula1 tow-truck jeep 4wd chassis auto
""".split()

# The vehicle vocabulary, in index order.
VEHICLE_VOCAB = """
3139 42610 56902 30027 18976 18977 55981 55982 30285 30285b 6014 6015 56890 56891 6014b
2926 4150 4274 3829 3829c01 50745 98282 30029 3823
3024 3023 3022 3021 3020 3710 3666 3460 3034 3832 3032 3031 3030 3035 3036 3958
3005 3004 3003 3002 3001 3010 3009 3008 3007 3006
""".split()
VEHICLE_VOCAB = [f"{p}.dat" for p in VEHICLE_VOCAB]
VEHICLE_COLORS = [0, 1, 2, 4, 14, 15, 71, 72]


def sql_literal(value) -> str:
    if value is None:
        return "NULL"
    if isinstance(value, bool):
        return "true" if value else "false"
    if isinstance(value, float):
        return f"CAST({value!r} AS DOUBLE)"
    if isinstance(value, int):
        return str(value)
    return "'" + str(value).replace("'", "''") + "'"


def values_sql(rows: list[tuple], columns: list[str], alias: str = "v") -> str:
    """A VALUES table usable in both SQL dialects."""
    body = ", ".join("(" + ", ".join(sql_literal(v) for v in row) + ")" for row in rows)
    return f"(VALUES {body}) AS {alias}({', '.join(columns)})"


def inline_table(spark: SparkSession, columns: list[str], rows: list[tuple]) -> DataFrame:
    """A local relation with known size (no Python RDD behind it)."""
    return spark.sql(f"SELECT * FROM {values_sql(rows, columns)}")


def part_table(spark: SparkSession) -> DataFrame:
    """part_id, w, h, d (NULL when only the name is known), part_name."""
    names = dict(PART_NAMES)
    dims = {p: (w, h, d) for p, w, h, d in PART_DIMENSIONS}
    ids = [*dims, *[p for p in names if p not in dims]]
    rows = [(p, *dims.get(p, (None, None, None)), names.get(p)) for p in ids]
    return inline_table(spark, ["part_id", "lw", "lh", "ld", "part_name"], rows)


def vocab_table(spark: SparkSession) -> DataFrame:
    return inline_table(spark, ["part_no", "part_id"], list(enumerate(ALLOWED_PARTS)))


def color_table(spark: SparkSession) -> DataFrame:
    return inline_table(spark, ["color", "hex"], COLOR_HEX)
