"""Per-assembly balance, interlocking and vehicle metrics, and the rewards built from them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brickloom.functions.geometry import SHAPE, unpack, with_dims
from brickloom.lookups import CABIN_PARTS, WHEEL_PARTS
from brickloom.operators.graph import gravity_check
from brickloom.operators.mirror import mirror_match
from brickloom.operators.spatial import PLACING, anchor_hits, bodies, box_pairs, placements
from brickloom.session import durable


def com_stable(parts: DataFrame) -> DataFrame:
    """Centre of mass inside the ground box (footprints unrotated, margin 2)."""
    body = unpack(with_dims(placements(parts)))
    top = body.groupBy("assembly_id").agg(F.max("y").alias("max_y"))
    mass = F.col("w") * F.col("h") * F.col("d") * F.col("copies")
    base = F.abs(F.col("y") - F.col("max_y")) <= 12.0
    edges = {}
    for axis, side in (("x", "w"), ("z", "d")):
        edges[f"lo_{axis}"] = F.min(F.when(base, F.col(axis) - F.col(side) / 2))
        edges[f"hi_{axis}"] = F.max(F.when(base, F.col(axis) + F.col(side) / 2))
    sums = body.join(top, "assembly_id").groupBy("assembly_id").agg(
        F.sum(mass).alias("m"),
        F.sum(mass * F.col("x")).alias("mx"),
        F.sum(mass * F.col("z")).alias("mz"),
        *[e.alias(n) for n, e in edges.items()],
    )
    inside = [
        (F.col(f"m{a}") / F.col("m")).between(F.col(f"lo_{a}") - 2.0, F.col(f"hi_{a}") + 2.0)
        for a in "xz"
    ]
    return sums.select("assembly_id", (inside[0] & inside[1]).alias("com_stable"))


def interlock_score(parts: DataFrame) -> DataFrame:
    """Parts whose sockets meet studs of two or more parts exactly one level below."""
    level = (F.rint(F.col("y") / 24.0) * 24).cast("int")
    body = bodies(parts).withColumn("level", level)
    near = box_pairs(body, body, ["owner", "copies", "level", *SHAPE], pad=PLACING).filter("a_level = b_level + 24")
    held = (
        anchor_hits(near, "a_", "b_", PLACING, ["assembly_id", "a_owner", "a_copies", "b_owner", "b_copies"])
        .drop("stud_idx", "socket_idx")
        .distinct()
        .groupBy("assembly_id", "b_owner", "b_copies")
        .agg(F.sum("a_copies").alias("below"))
        .filter("below >= 2")
        .groupBy("assembly_id")
        .agg(F.sum("b_copies").alias("score"))
    )
    sizes = parts.groupBy("assembly_id").agg(F.count(F.lit(1)).alias("n"))
    return sizes.join(held, "assembly_id", "left").select(
        "assembly_id",
        F.when(F.col("n") < 3, 0.0).otherwise(F.coalesce("score", F.lit(0))).cast("double").alias("interlock"),
    )


def vehicle_metrics(parts: DataFrame, symmetry: bool = True) -> DataFrame:
    """Wheel, cabin and symmetry metrics with neutral defaults; one aggregation pass."""
    p = unpack(parts.select("assembly_id", "part_id", "transform"))
    pid = F.lower("part_id")
    wheel, cabin = pid.isin(WHEEL_PARTS), pid.isin(CABIN_PARTS)
    agg = p.groupBy("assembly_id").agg(
        F.count_if(wheel).alias("wheel_count"),
        F.count_if(cabin).alias("cabins"),
        F.max("y").alias("max_y"),
        F.min(F.when(wheel, F.col("y"))).alias("wheel_top"),
        F.avg(F.when(wheel, F.col("y"))).alias("wheel_avg"),
        F.max(F.when(cabin, F.col("y"))).alias("cabin_low"),
        F.max(F.when(cabin, F.abs("x"))).alias("cabin_off"),
    )
    judged = (F.col("wheel_count") > 0) & (F.col("cabins") > 0)
    out = agg.select(
        "assembly_id",
        "wheel_count",
        F.coalesce(F.abs(F.col("wheel_top") - F.col("max_y")) <= 15.0, F.lit(True)).alias("wheels_at_bottom"),
        F.when(judged, F.col("cabin_low") < F.col("wheel_avg") - 8.0).otherwise(True).alias("cabin_height_valid"),
        F.when(judged, F.col("cabin_off") <= 10.0).otherwise(True).alias("cabin_centered"),
        (F.col("cabins") > 0).alias("has_cabin_parts"),
    )
    if symmetry:
        out = out.join(symmetry_score(parts), "assembly_id")
    return out


def symmetry_score(parts: DataFrame) -> DataFrame:
    """Share of parts on the centre line or with a greedily matched mirror partner."""
    matched = mirror_match(parts).groupBy("assembly_id").agg(F.sum("matched").alias("matched"))
    p = unpack(parts.select("assembly_id", "transform"))
    sizes = p.groupBy("assembly_id").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.abs("x") < 6.0).alias("central")
    )
    return sizes.join(matched, "assembly_id", "left").select(
        "assembly_id",
        ((F.col("central") + F.coalesce("matched", F.lit(0))) / F.col("n")).alias("symmetry_score"),
    )


def vehicle_reward(parts: DataFrame, base: float = 10.0, stable: DataFrame | None = None) -> DataFrame:
    """Reward of a vehicle; -10 when it does not stand. ``stable`` reuses a gravity check."""
    stable = gravity_check(parts) if stable is None else stable
    w = F.col("wheel_count")
    wheels = F.when(w == 4, 15.0).when(w == 2, 4.0).otherwise(-10.0)
    bottom = F.when(w == 0, 0.0).when(F.col("wheels_at_bottom"), 5.0).otherwise(-5.0)
    good = F.col("cabin_height_valid") & F.col("cabin_centered")
    cabin = F.when(~F.col("has_cabin_parts"), 0.0).when(good, 5.0).otherwise(-5.0)
    total = F.lit(base) + wheels + bottom + 10.0 * F.col("symmetry_score") + cabin
    return (
        stable.join(vehicle_metrics(parts), "assembly_id")
        .select("assembly_id", F.when(~F.col("stable"), -10.0).otherwise(total).alias("reward"))
    )


def stability_reward(parts: DataFrame) -> DataFrame:
    """10 + 5 per interlocking part when stable, else -5."""
    return (
        gravity_check(parts)
        .join(interlock_score(parts), "assembly_id")
        .select(
            "assembly_id",
            F.when(~F.col("stable"), -5.0).otherwise(10.0 + 5.0 * F.col("interlock")).alias("reward"),
        )
    )


def with_empty(reward: DataFrame, assemblies: DataFrame, value: float) -> DataFrame:
    """Give assemblies without parts their fixed reward."""
    return assemblies.join(reward, "assembly_id", "left").withColumn(
        "reward", F.coalesce("reward", F.lit(value))
    )


def text_reward(parts: DataFrame, assemblies: DataFrame, vehicle: bool = False) -> DataFrame:
    """+1 / -1 for parsed texts, or the clipped vehicle reward; texts without parts give -1."""
    parts = durable(parts)  # several checks read them, and parsing costs more than keeping them
    if vehicle:
        reward = vehicle_reward(parts).withColumn(
            "reward", F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.col("reward") / 15.0))
        )
    else:
        reward = (
            gravity_check(parts)
            .join(com_stable(parts), "assembly_id")
            .select(
                "assembly_id",
                F.when(F.col("stable") & F.col("com_stable"), 1.0).otherwise(-1.0).alias("reward"),
            )
        )
    return with_empty(reward, assemblies, -1.0)
