"""Operator inputs derived from the test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brickloom.functions.geometry import transform_from, with_dims, yaw_rotation
from brickloom.lookups import ALLOWED_PARTS, PART_DIMENSIONS, values_sql
from brickloom.operators.scans import ordinal, scan

LINE_ORDER = [
    "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice",
    "l_discount", "l_tax", "l_shipdate", "l_returnflag", "l_linestatus",
]


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def _lattice(spark, sf) -> DataFrame:
    lines = ordinal(table(spark, sf, "lineitem"), ["l_orderkey"], LINE_ORDER, "pi")
    vocab = F.array(*[F.lit(p) for p in ALLOWED_PARTS])
    return lines.select(
        F.col("l_orderkey").alias("assembly_id"),
        F.col("pi").cast("int").alias("part_index"),
        F.get(vocab, (F.col("l_partkey") % 32).cast("int")).alias("part_id"),
        (F.col("l_suppkey") % 16).cast("int").alias("color"),
        F.floor(F.col("pi") / 2).cast("int").alias("step_id"),
        (10 * (F.col("l_partkey") % 7 - 3)).cast("double").alias("x"),
        (-8 * (F.col("l_suppkey") % 6)).cast("double").alias("y"),
        (10 * (F.col("l_quantity").cast("int") % 7 - 3)).cast("double").alias("z"),
        (F.col("l_linenumber") % 4).cast("int").alias("yaw"),
    )


def _posed(df: DataFrame) -> DataFrame:
    return df.withColumns(
        {
            "page_num": F.col("step_id"),
            "transform": transform_from(F.col("x"), F.col("y"), F.col("z"), yaw_rotation(F.col("yaw"))),
        }
    ).select("assembly_id", "part_index", "part_id", "color", "step_id", "page_num", "transform")


def placed_parts(spark: SparkSession, sf: str) -> DataFrame:
    """Assemblies on a lattice, one per order."""
    return _posed(_lattice(spark, sf))


def stacked_parts(spark: SparkSession, sf: str) -> DataFrame:
    """The same parts piled into one tower per order."""
    p = with_dims(_lattice(spark, sf).withColumns({"x": F.lit(0.0), "z": F.lit(0.0), "yaw": F.lit(0)}))
    p = scan(p, ["assembly_id"], ["part_index"], sums={"top": F.col("h")})
    return _posed(p.withColumn("y", F.col("h") - F.col("top")))


VOCAB_SQL = values_sql(
    [(i, p, *next(d[1:] for d in PART_DIMENSIONS if d[0] == p)) for i, p in enumerate(ALLOWED_PARTS)],
    ["part_no", "part_id", "w", "h", "d"],
    "vocab",
)

# CTEs shared by the oracles of placed parts. p: parts with dims; pl: distinct placements;
# b: placements with world bounds; studs / sockets: world anchors.
P_SQL = f"""
o AS (
  SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY {", ".join(LINE_ORDER)}) - 1 AS pi
  FROM lineitem),
p AS (
  SELECT l_orderkey AS assembly_id, CAST(pi AS INTEGER) AS part_index, part_no, part_id, w, h, d,
    CAST(l_suppkey % 16 AS INTEGER) AS color, CAST(pi // 2 AS INTEGER) AS step_id,
    CAST(10 * (l_partkey % 7 - 3) AS DOUBLE) AS x,
    CAST(-8 * (l_suppkey % 6) AS DOUBLE) AS y,
    CAST(10 * (CAST(l_quantity AS INTEGER) % 7 - 3) AS DOUBLE) AS z,
    CAST(l_linenumber % 4 AS INTEGER) AS yaw,
    CASE l_linenumber % 4 WHEN 0 THEN 1.0::DOUBLE WHEN 2 THEN -1.0::DOUBLE ELSE 0.0::DOUBLE END AS c,
    CASE l_linenumber % 4 WHEN 1 THEN 1.0::DOUBLE WHEN 3 THEN -1.0::DOUBLE ELSE 0.0::DOUBLE END AS s
  FROM o JOIN {VOCAB_SQL} ON part_no = l_partkey % 32)"""

STACK_SQL = P_SQL.replace("\np AS (", "\np0 AS (") + """,
p AS (
  SELECT * EXCLUDE (x, y, z, yaw, c, s), 0.0::DOUBLE AS x, 0.0::DOUBLE AS z, 0 AS yaw,
    1.0::DOUBLE AS c, 0.0::DOUBLE AS s,
    h - sum(h) OVER (PARTITION BY assembly_id ORDER BY part_index) AS y
  FROM p0)"""

PL_SQL = """,
pl AS (
  SELECT assembly_id, part_id, w, h, d, x, y, z, c, s, min(part_index) AS owner, count(*) AS copies
  FROM p GROUP BY ALL),
b AS (
  SELECT *,
    x - (abs(c) * w + abs(s) * d) / 2 AS min_x, x + (abs(c) * w + abs(s) * d) / 2 AS max_x,
    y - h AS min_y, y AS max_y,
    z - (abs(s) * w + abs(c) * d) / 2 AS min_z, z + (abs(s) * w + abs(c) * d) / 2 AS max_z
  FROM pl)"""

ANCHOR_SQL = """,
grid AS (
  SELECT *, greatest(1, CAST(round_even(w / 20, 0) AS INTEGER)) AS n,
    greatest(1, CAST(round_even(d / 20, 0) AS INTEGER)) AS m FROM b),
local AS (
  SELECT *, -10.0 * (n - 1) + 20.0 * (idx // m) AS lx, -10.0 * (m - 1) + 20.0 * (idx % m) AS lz
  FROM (SELECT *, unnest(range(n * m)) AS idx FROM grid)),
studs AS (
  SELECT *, c * lx + s * lz + x AS ax, y - h AS ay, -s * lx + c * lz + z AS az FROM local),
sockets AS (
  SELECT *, c * lx + s * lz + x AS ax, y AS ay, -s * lx + c * lz + z AS az FROM local)"""

CONTACT_SQL = """,
touch AS (
  SELECT DISTINCT a.assembly_id, least(a.owner, b.owner) AS part_a, greatest(a.owner, b.owner) AS part_b,
    CASE WHEN a.owner < b.owner THEN a.copies ELSE b.copies END AS copies_a,
    CASE WHEN a.owner < b.owner THEN b.copies ELSE a.copies END AS copies_b
  FROM studs a JOIN sockets b ON a.assembly_id = b.assembly_id AND a.owner <> b.owner
   AND (a.ax-b.ax)*(a.ax-b.ax) + (a.ay-b.ay)*(a.ay-b.ay) + (a.az-b.az)*(a.az-b.az) < 1.0
  WHERE abs(a.max_y - b.min_y) < 2.0 OR abs(b.max_y - a.min_y) < 2.0)"""


def numbered_lines(spark: SparkSession, sf: str) -> DataFrame:
    """Line items with their position ``pi`` in the order."""
    return ordinal(table(spark, sf, "lineitem"), ["l_orderkey"], LINE_ORDER, "pi")
