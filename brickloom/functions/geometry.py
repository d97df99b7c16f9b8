"""Matrix, bounding-box and anchor expressions over row-major 4x4 transforms.

Everything is built-in Column arithmetic, so it stays inside code generation.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brickloom.lookups import part_table

STUD = 20.0
IDENTITY = [1.0, 0.0, 0.0, 0.0, 0.0, 1.0, 0.0, 0.0, 0.0, 0.0, 1.0, 0.0, 0.0, 0.0, 0.0, 1.0]


def identity() -> Column:
    return F.array(*[F.lit(v) for v in IDENTITY])


def cell(t: Column | str, i: int, j: int) -> Column:
    """Entry (i, j) of a 16-value row-major matrix."""
    t = F.col(t) if isinstance(t, str) else t
    return F.get(t, F.lit(4 * i + j))


def _dot(terms):
    total = terms[0]
    for term in terms[1:]:
        total = total + term
    return total


def mat_compose(a: Column | str, b: Column | str) -> Column:
    """Product of two 4x4 matrices."""
    return F.array(
        *[_dot([cell(a, i, k) * cell(b, k, j) for k in range(4)]) for i in range(4) for j in range(4)]
    )


def relative_translation(a: Column | str, b: Column | str) -> list[Column]:
    """World-axis offset from a to b (not rotated into a's frame)."""
    return [cell(b, i, 3) - cell(a, i, 3) for i in range(3)]


def relative_rotation(a: Column | str, b: Column | str) -> list[Column]:
    """Rotation part of b seen from a: Ra^T Rb, row-major."""
    return [_dot([cell(a, k, i) * cell(b, k, j) for k in range(3)]) for i in range(3) for j in range(3)]


def relative_transform(a: Column | str, b: Column | str) -> Column:
    """12 values: offset then rotation."""
    return F.array(*relative_translation(a, b), *relative_rotation(a, b))


def relative_matrix(a: Column | str, b: Column | str) -> Column:
    """The same pair as a 4x4 row-major matrix."""
    t, r = relative_translation(a, b), relative_rotation(a, b)
    rows = [v for i in range(3) for v in (*r[3 * i : 3 * i + 3], t[i])]
    return F.array(*rows, *[F.lit(v) for v in (0.0, 0.0, 0.0, 1.0)])


def transform_from(x, y, z, rotation: list[Column]) -> Column:
    """4x4 matrix from a position and nine rotation values."""
    t = [x, y, z]
    rows = [v for i in range(3) for v in (*rotation[3 * i : 3 * i + 3], t[i])]
    return F.array(*[v.cast("double") for v in rows], *[F.lit(v) for v in (0.0, 0.0, 0.0, 1.0)])


def yaw_rotation(yaw: Column) -> list[Column]:
    """Rotation about Y by a number of quarter turns."""
    c = F.when(yaw == 0, 1.0).when(yaw == 2, -1.0).otherwise(0.0)
    s = F.when(yaw == 1, 1.0).when(yaw == 3, -1.0).otherwise(0.0)
    zero, one = F.lit(0.0), F.lit(1.0)
    return [c, zero, s, zero, one, zero, F.lit(0.0) - s, zero, c]


def with_dims(df: DataFrame, part: str = "part_id") -> DataFrame:
    """Add w, h, d. Known parts come from the table; others are read off the name or id."""
    table = F.broadcast(part_table(df.sparkSession).withColumnRenamed("part_id", "_lp"))
    pid = F.lower(F.col(part))
    name = F.lower(F.coalesce(F.col("part_name"), F.lit("")))
    size = r"(\d+)\s*x\s*(\d+)"
    source = F.when(name.rlike(size), name).when(pid.rlike(size), pid)
    flat = F.concat_ws(" ", pid, name).rlike("plate|tile")
    tall = F.when(flat, 8.0).otherwise(24.0)
    small = pid.startswith("302") | pid.startswith("307")

    def side(group: int) -> Column:
        return F.regexp_extract(source, size, group).cast("double") * STUD

    unnamed_h = F.when(small, 8.0).otherwise(24.0)
    out = df.join(table, F.col(part) == F.col("_lp"), "left").withColumns(
        {
            "w": F.coalesce("lw", side(1), F.lit(20.0)),
            "h": F.coalesce("lh", F.when(source.isNotNull(), tall).otherwise(unnamed_h)),
            "d": F.coalesce("ld", side(2), F.lit(20.0)),
        }
    )
    return out.drop("_lp", "lw", "lh", "ld", "part_name")


ROT = [f"r{i}{j}" for i in range(3) for j in range(3)]
POS = ["x", "y", "z"]
BOX = ["min_x", "max_x", "min_y", "max_y", "min_z", "max_z"]


def unpack(df: DataFrame) -> DataFrame:
    """Scalar position and rotation columns, so hot joins avoid array access."""
    cols = {f"r{i}{j}": cell("transform", i, j) for i in range(3) for j in range(3)}
    cols |= {axis: cell("transform", i, 3) for i, axis in enumerate(POS)}
    return df.withColumns(cols)


def world_bounds(df: DataFrame) -> DataFrame:
    """Axis-aligned box of the transformed part box, in closed form, plus its mean height."""
    out = {}
    for i, axis in enumerate(POS):
        centre = F.col(axis) - F.col(f"r{i}1") * F.col("h") / 2
        reach = _dot([F.abs(F.col(f"r{i}{j}")) * F.col(s) for j, s in enumerate("whd")]) / 2
        out[f"c{axis}"] = centre
        out[f"min_{axis}"] = centre - reach
        out[f"max_{axis}"] = centre + reach
    return df.withColumns(out).withColumn("mean_y", F.col("cy"))


def solids(df: DataFrame) -> DataFrame:
    """part_id + transform -> dims, stud counts, scalar pose, world bounds and whether it is rigid."""
    body = world_bounds(unpack(with_dims(df)))
    tests = []
    for i in range(3):
        for j in range(i, 3):
            dot = _dot([F.col(f"r{k}{i}") * F.col(f"r{k}{j}") for k in range(3)])
            tests.append(F.abs(dot - (1.0 if i == j else 0.0)) < 1e-3)
    rigid = tests[0]
    for test in tests[1:]:
        rigid = rigid & test
    return body.withColumns({"nx": stud_count("w"), "nz": stud_count("d"), "rigid": rigid})


def stud_count(side: str) -> Column:
    return F.greatest(F.lit(1), F.rint(F.col(side) / STUD).cast("int"))


# the columns that pair tests on solids need
SHAPE = ["h", "nx", "nz", "rigid", *[f"r{i}{j}" for i in range(3) for j in range(3)], "x", "y", "z"]


def anchors(df: DataFrame, kind: str | Column, keep: list[str], first: int | None = None) -> DataFrame:
    """Explode studs (top) or sockets (bottom) to world points (anchor_idx, ax, ay, az).

    ``kind`` is "stud" or "socket", or a column with either. ``first`` keeps only the leading anchors, for operators defined on those.
    """
    n, m = stud_count("w"), stud_count("d")
    last = n * m - 1 if first is None else F.least(n * m - 1, F.lit(first - 1))
    grid = df.withColumns({"_n": n, "_m": m, "anchor_idx": F.explode(F.sequence(F.lit(0), last))})
    i = F.floor(F.col("anchor_idx") / F.col("_m"))
    j = F.col("anchor_idx") % F.col("_m")
    if isinstance(kind, Column):
        level = F.when(kind == "stud", -F.col("h")).otherwise(0.0)
    else:
        level = (-F.col("h")) if kind == "stud" else F.lit(0.0)
    local = {
        "_lx": -10.0 * (F.col("_n") - 1) + STUD * i,
        "_ly": level,
        "_lz": -10.0 * (F.col("_m") - 1) + STUD * j,
    }
    world = [
        (
            F.col(f"r{k}0") * F.col("_lx")
            + F.col(f"r{k}1") * F.col("_ly")
            + F.col(f"r{k}2") * F.col("_lz")
            + F.col(axis)
        ).alias(f"a{axis}")
        for k, axis in enumerate(POS)
    ]
    return grid.withColumns(local).select(*keep, "anchor_idx", *world)
