"""Ordering, step numbering and next-part examples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from brickloom.functions.geometry import cell
from brickloom.lookups import ALLOWED_PARTS, part_table, color_table, DEFAULT_HEX
from brickloom.functions.geometry import with_dims
from brickloom.operators.scans import fits, ordinal, scan


def size_filter(parts: DataFrame, least: int = 1, below: int = 100) -> DataFrame:
    """Keep assemblies with least <= n < below parts; afterwards every assembly is small."""
    sizes = parts.groupBy("assembly_id").agg(F.count(F.lit(1)).alias("_n"))
    kept = sizes.filter((F.col("_n") >= least) & (F.col("_n") < below))
    return parts.join(kept.select("assembly_id"), "assembly_id", "left_semi")


def sequence_index(parts: DataFrame, bounded: bool = False) -> DataFrame:
    """Stable order by step, numbered from 0."""
    return ordinal(parts, ["assembly_id"], ["step_id", "part_index"], "sequence_index", bounded)


def bottom_up_index(parts: DataFrame, bounded: bool = False) -> DataFrame:
    """Lowest part first (largest y), then by step."""
    y = cell("transform", 1, 3)
    return ordinal(parts, ["assembly_id"], [y.desc(), F.col("step_id"), F.col("part_index")], "sequence_index", bounded)


def std_steps(ordered: DataFrame, order: str = "ord") -> DataFrame:
    """New step when the height moves by more than 8 or the step already holds five parts.

    A height jump starts a run; inside a run every fifth part starts a step.
    """
    y = cell("transform", 1, 3)
    small = fits(ordered, ["assembly_id"])
    df = scan(ordered, ["assembly_id"], [order], rank="_k", lags={"_prev_y": y}, bounded=small)
    jump = F.coalesce(F.abs(y - F.col("_prev_y")) > 8.0, F.lit(False))
    df = df.withColumn("_start", F.when(jump | (F.col("_k") == 0), F.col("_k")))
    df = scan(df, ["assembly_id"], [order], lasts={"_run": F.col("_start")}, bounded=small)
    inside = F.col("_k") - F.col("_run")
    df = df.withColumn("new_step", (inside % 5 == 0) & (F.col("_k") > 0))
    df = scan(df, ["assembly_id"], [order], sums={"std_step": F.col("new_step").cast("int")}, bounded=small)
    return df.drop("_k", "_prev_y", "_start", "_run")


def layer_steps(parts: DataFrame) -> DataFrame:
    """Ground-up order (stable), new step when the height moves by more than 5."""
    y = cell("transform", 1, 3)
    order = [y.desc(), F.col("part_index")]
    small = fits(parts, ["assembly_id"])
    df = scan(parts, ["assembly_id"], order, rank="ord", lags={"_prev_y": y}, bounded=small)
    df = df.withColumn("new_step", F.coalesce(F.abs(y - F.col("_prev_y")) > 5.0, F.lit(False)))
    steps = {"layer_step": F.col("new_step").cast("int")}
    return scan(df, ["assembly_id"], ["ord"], sums=steps, bounded=small).drop("_prev_y")


def stack_heights(parts: DataFrame) -> DataFrame:
    """y of each part when piled on the previous ones: minus the sum of the earlier heights."""
    df = scan(with_dims(parts), ["assembly_id"], ["part_index"], sums={"_top": F.col("h")})
    return df.withColumn("stack_y", F.col("h") - F.col("_top")).drop("_top")


def training_examples(sequenced: DataFrame, vocab: list[str] = ALLOWED_PARTS, layout: str = "split",
                      colors: list[int] | None = None, mask_color: bool = False) -> DataFrame:
    """For every part after the first: the earlier parts as state and the part as target.

    Input must come out of ``size_filter``, which bounds the state. ``layout`` is ``split`` (offset
    then rotation) or ``rows`` (the top three matrix rows). ``mask_color`` forces colour index 0.
    """
    w = Window.partitionBy("assembly_id").orderBy("sequence_index").rowsBetween(Window.unboundedPreceding, -1)
    state = F.collect_list(F.struct("part_id", "color", "transform", "step_id")).over(w)
    index = F.array_position(F.array(*[F.lit(p) for p in vocab]), F.col("part_id"))
    if layout == "split":
        order = [(i, 3) for i in range(3)] + [(i, j) for i in range(3) for j in range(3)]
    else:
        order = [(i, j) for i in range(3) for j in range(4)]
    if mask_color:
        color: Column = F.lit(0)
    elif colors is not None:
        color = F.greatest(F.array_position(F.array(*[F.lit(c) for c in colors]), F.col("color")) - 1, F.lit(0))
    else:
        color = F.col("color")
    return sequenced.withColumn("state", state).filter("sequence_index > 0").select(
        "assembly_id", F.col("sequence_index").alias("k"), "state",
        F.greatest(index - 1, F.lit(0)).cast("int").alias("part_target"), color.cast("int").alias("color_target"),
        F.array(*[cell("transform", i, j) for i, j in order]).alias("transform_target"),
    )


def part_labels(parts: DataFrame) -> DataFrame:
    """Display colour and name of every part."""
    spark = parts.sparkSession
    names = part_table(spark).filter("part_name IS NOT NULL").select("part_id", "part_name")
    bare = F.replace(F.replace("part_id", F.lit(".dat"), F.lit("")), F.lit("b"), F.lit(""))
    return (
        parts.join(F.broadcast(color_table(spark)), "color", "left")
        .join(F.broadcast(names), "part_id", "left")
        .withColumns({"hex": F.coalesce("hex", F.lit(DEFAULT_HEX)), "part_name": F.coalesce("part_name", bare)})
    )


def step_report_payload(parts: DataFrame) -> DataFrame:
    """Part rows of the step report with the page of the step's first part.

    Rows stay flat (one per part) so that a step of any size is spread; nest them with
    ``step_documents`` for assemblies that passed a size filter.
    """
    first = parts.groupBy("assembly_id", "step_id").agg(F.min_by("page_num", "part_index").alias("step_page"))
    shown = part_labels(with_dims(parts))
    return shown.join(first, ["assembly_id", "step_id"]).select(
        "assembly_id", "step_id", "step_page", "part_index", "part_id",
        F.col("part_name").alias("name"), "color", "hex", "w", "h", "d", "transform",
    )


def step_documents(payload: DataFrame) -> DataFrame:
    part = F.struct("part_index", "part_id", "name", "color", "hex", "w", "h", "d", "transform")
    return payload.groupBy("assembly_id", "step_id", "step_page").agg(F.array_sort(F.collect_list(part)).alias("parts"))


def part_glossary(payload: DataFrame) -> DataFrame:
    return payload.select("assembly_id", "part_id", "name").distinct()
