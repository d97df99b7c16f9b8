"""Placed parts to LDraw lines and nested documents.

Texts are produced as ordered line rows (assembly_id, ord, sub, line): a file is the lines of one
assembly in (ord, sub) order, so no assembly has to fit one row. ``write_ldraw`` stores them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brickloom.functions.geometry import cell
from brickloom.functions.numbers import fixed_text
from brickloom.operators.scans import fits, scan
from brickloom.operators.spatial import all_small, gathered, join_by

STEP = "0 STEP"


def number_text(value: Column) -> Column:
    """Shortest text of a single-precision value, never in exponent form."""
    short = value.cast("float")
    size = F.abs(short)
    plain = (size == 0) | ((size >= 1e-3) & (size < 1e7))
    fixed = F.regexp_replace(F.format_string("%.10f", short.cast("double")), r"(\.\d+?)0+$", "$1")
    return F.when(plain, short.cast("string")).otherwise(fixed)


def _values(order: list[Column], style) -> Column:
    return F.array_join(F.transform(F.array(*order), lambda v: style(v)), " ")


def _matrix_order() -> list[Column]:
    return [cell("transform", i, 3) for i in range(3)] + [cell("transform", i, j) for i in range(3) for j in range(3)]


def part_line(position: int | None = None, rotation: int | None = None) -> Column:
    """``1 colour x y z a..i part`` with shortest numbers, or with fixed decimals."""
    cells = _matrix_order()
    pos = _values(cells[:3], number_text if position is None else lambda v: fixed_text(v, position))
    rot = _values(cells[3:], number_text if rotation is None else lambda v: fixed_text(v, rotation))
    return F.concat_ws(" ", F.lit("1"), F.col("color").cast("string"), pos, rot, F.col("part_id"))


def _file_lines(df: DataFrame, before: Column, line: Column, header: list[str]) -> DataFrame:
    """Header lines per assembly, and per part the lines ``before`` it and its own.

    A part's line is put together after its rows are multiplied, so what only counts or lists assemblies writes no text.
    """
    spots = df.withColumn("_before", before).withColumn("sub", F.explode(F.sequence(F.lit(0), F.size("_before"))))
    body = spots.select(
        "assembly_id", F.col("ord").cast("long").alias("ord"), "sub",
        F.when(F.col("sub") < F.size("_before"), F.get("_before", F.col("sub"))).otherwise(line).alias("line"),
    )
    heads = df.select("assembly_id").distinct().select(
        "assembly_id", F.lit(-1).cast("long").alias("ord"),
        F.posexplode(F.array(*[F.lit(h) for h in header])).alias("sub", "line"),
    )
    return heads.unionByName(body)


def to_ldraw(parts: DataFrame, header: str = "0 Generated Model") -> DataFrame:
    """Stable order by step with one ``0 STEP`` per step passed."""
    df = scan(parts, ["assembly_id"], ["step_id", "part_index"], rank="ord", lags={"_prev": F.col("step_id")})
    start = F.greatest(F.coalesce("_prev", F.lit(0)), F.lit(0))
    gap = F.greatest(F.col("step_id") - start, F.lit(0))
    return _file_lines(df, F.array_repeat(F.lit(STEP), gap), part_line(), [header])


def to_ldraw_paged(parts: DataFrame, header: list[str]) -> DataFrame:
    """List order; one ``0 STEP PAGE n`` whenever the step exceeds every earlier one; three decimals."""
    small = fits(parts, ["assembly_id"])
    df = scan(parts, ["assembly_id"], ["part_index"], rank="ord", maxes={"_top": F.col("step_id")}, bounded=small)
    df = scan(df, ["assembly_id"], ["part_index"], lags={"_earlier": F.col("_top")}, bounded=small)
    rises = F.col("step_id") > F.greatest(F.coalesce("_earlier", F.lit(0)), F.lit(0))
    mark = F.array(F.concat(F.lit("0 STEP PAGE "), F.coalesce("page_num", "step_id").cast("string")))
    return _file_lines(df, F.when(rises, mark).otherwise(F.array().cast("array<string>")), part_line(3, 3), header)


def to_ldraw_marked(ordered: DataFrame, header: str) -> DataFrame:
    """Parts that carry ``ord`` and ``new_step``: four decimals for positions, six for rotations."""
    before = F.when(F.col("new_step"), F.array(F.lit(STEP))).otherwise(F.array().cast("array<string>"))
    return _file_lines(ordered, before, part_line(4, 6), [header])


def write_ldraw(lines: DataFrame, path: str, files: int = 1) -> None:
    """Store lines under one folder per assembly, in order within and across its files."""
    (
        lines.repartitionByRange(max(files, 1), "assembly_id", "ord", "sub")
        .sortWithinPartitions("assembly_id", "ord", "sub")
        .select("assembly_id", "line")
        .write.mode("overwrite")
        .partitionBy("assembly_id")
        .text(path)
    )


def assembly_documents(sequenced: DataFrame, names: DataFrame) -> DataFrame:
    """Nested document per set from parts with sequence_index; use after a size filter.

    names: assembly_id, set_name, set_number.
    """
    part = F.struct("sequence_index", "part_id", "color", "transform", "step_id")
    docs = sequenced.groupBy("assembly_id").agg(
        F.count(F.lit(1)).cast("int").alias("num_parts"), F.array_sort(F.collect_list(part)).alias("parts")
    )
    return docs.join(names, "assembly_id").select("assembly_id", "set_name", "set_number", "num_parts", "parts")


def homogenized_documents(parts: DataFrame, connections: DataFrame, names: DataFrame) -> DataFrame:
    """Nested connection document per set; use after a size filter."""
    links = connections.groupBy("assembly_id", "part_index").agg(
        F.array_sort(F.collect_list(F.struct(F.col("parent_index").alias("parent_part_index"), "parent_anchor",
                                             "child_anchor", "relative_transform"))).alias("connections")
    )
    record = F.struct(
        "part_index", "part_id", F.col("color").alias("color_code"), "step_id",
        F.col("transform").alias("absolute_transform"), "connections",
    )
    small = all_small(parts)
    docs = (
        join_by(gathered(parts) if small else parts, links, {"part_index": "part_index"}, small, "left")
        .withColumn("connections", F.coalesce("connections", F.array().cast(links.schema["connections"].dataType)))
        .groupBy("assembly_id")
        .agg(F.count(F.lit(1)).cast("int").alias("num_parts"), F.array_sort(F.collect_list(record)).alias("sequence"))
    )
    return docs.join(names, "assembly_id").select("assembly_id", "set_name", "num_parts", "sequence")


def homogenized_chunks(parts: DataFrame, children: DataFrame, names: DataFrame, size: int = 1000) -> DataFrame:
    """Connection documents of assemblies of any size, in chunks of ``size`` parts in list order.

    children: rows of ``child_connections``; a connection names the parent placement by its first part and counts its copies.
    """
    links = children.groupBy("assembly_id", "part_index").agg(
        F.array_sort(F.collect_list(F.struct(F.col("p").alias("parent_part_index"), F.col("n_parents").alias("parent_copies"), "parent_anchor",
                                             "child_anchor", "relative_transform"))).alias("connections")
    )
    record = F.struct(
        "part_index", "part_id", F.col("color").alias("color_code"), "step_id", F.col("transform").alias("absolute_transform"), "connections"
    )
    small = all_small(parts)
    placed = scan(gathered(parts) if small else parts, ["assembly_id"], ["part_index"], rank="ord", bounded=small).withColumn("chunk_no", F.floor(F.col("ord") / size).cast("int"))
    chunks = (
        join_by(placed, links, {"part_index": "part_index"}, small, "left")
        .withColumn("connections", F.coalesce("connections", F.array().cast(links.schema["connections"].dataType)))
        .groupBy("assembly_id", "chunk_no")
        .agg(F.count(F.lit(1)).cast("int").alias("num_parts"), F.array_sort(F.collect_list(record)).alias("sequence"))
    )
    return chunks.join(names, "assembly_id").select("assembly_id", "set_name", "chunk_no", "num_parts", "sequence")


def write_documents(docs: DataFrame, path: str) -> None:
    docs.write.mode("overwrite").partitionBy("assembly_id").json(path)
