"""Greedy left/right partner matching without walking an assembly part by part.

Parts with equal id and position form a class, and a part's possible partners depend only on its class. Classes that face the
same classes (and those faced by the same) form a type. Where takers of one type and givers of one type face only one
another, the walk gives the k-th taker the k-th giver. The other types meet as runs: takers of one type that follow one another in list order,
against givers that do so. Partners of whole runs follow from their ranks, so the work depends on how often the list changes between
types, not on the number of copies.
"""

from __future__ import annotations

from collections import deque

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brickloom.functions.geometry import unpack
from brickloom.operators.scans import ordinal, scan
from brickloom.operators.spatial import all_small, gathered, join_by
from brickloom.session import durable

_CELL = 16.0


def _classes(parts: DataFrame) -> DataFrame:
    p = unpack(parts.select("assembly_id", "part_index", "part_id", "transform"))
    return p.groupBy("assembly_id", "part_id", "x", "y", "z").agg(
        F.min("part_index").alias("cls"), F.count(F.lit(1)).alias("copies")
    )


def facing_classes(parts: DataFrame) -> DataFrame:
    """Classes (|x| >= 6) with the classes that mirror them: |x1+x2| < 8, |dy| < 5, |dz| < 5.

    Those of small assemblies meet on the assembly where it lies; in larger ones they meet in grid cells.
    """
    small = all_small(parts)
    classes = _classes(gathered(parts) if small else parts)
    seek = classes.filter(F.abs("x") >= 6.0)
    # |x| >= 6 puts a class at least 12 away from its own mirror image, so none faces itself
    close = (
        (F.abs(F.col("a_x") + F.col("b_x")) < 8.0)
        & (F.abs(F.col("a_y") - F.col("b_y")) < 5.0)
        & (F.abs(F.col("a_z") - F.col("b_z")) < 5.0)
    )
    named = ("cls", "copies", "x", "y", "z")
    give = classes
    joint = ["assembly_id", "part_id"]
    if not small:
        seek = seek.withColumn("mx", -F.col("x"))
        for axis, reach in (("mx", 8.0), ("y", 5.0), ("z", 5.0)):
            low, high = (F.floor((F.col(axis) + d) / _CELL) for d in (-reach, reach))
            seek = seek.withColumn(f"g_{axis[-1]}", F.explode(F.sequence(low, high)))
        give = classes.withColumns({f"g_{a}": F.floor(F.col(a) / _CELL) for a in "xyz"})
        joint = [*joint, "g_x", "g_y", "g_z"]
    left = seek.select(*joint, *[F.col(c).alias(f"a_{c}") for c in named])
    right = give.select(*joint, *[F.col(c).alias(f"b_{c}") for c in named])
    return join_by(left, right, {c: c for c in joint[1:]}, small).filter(close).select(
        "assembly_id", "part_id", "a_cls", "a_copies", "a_x", "a_y", "a_z",
        "b_cls", "b_copies", "b_x", "b_y", "b_z",
    )


def mirror_exists(parts: DataFrame) -> DataFrame:
    """Parts (|x| >= 6) for which some mirrored partner exists."""
    found = facing_classes(parts).select(
        "assembly_id", "part_id", F.col("a_x").alias("x"), F.col("a_y").alias("y"), F.col("a_z").alias("z")
    )
    p = unpack(parts.select("assembly_id", "part_index", "part_id", "transform"))
    return p.join(found, ["assembly_id", "part_id", "x", "y", "z"], "left_semi").select(
        "assembly_id", "part_index"
    )


def _types(faces: DataFrame) -> DataFrame:
    """faces with the types of both classes: a_type and b_type, digests of the set of classes on the other side."""
    def kind(own, other):
        h = F.xxhash64("part_id", other)
        digest = F.struct(F.count(F.lit(1)).alias("n"), F.sum(h.cast("decimal(20, 0)")).alias("s"), F.bit_xor(F.hash(other, h)).alias("x"))
        return faces.groupBy("assembly_id", "part_id", f"{own}_cls").agg(digest.alias("d")).select(
            "assembly_id", "part_id", f"{own}_cls", F.sha2(F.to_json("d"), 256).alias(f"{own}_type")
        )

    return faces.join(kind("a", "b_cls"), ["assembly_id", "part_id", "a_cls"]).join(kind("b", "a_cls"), ["assembly_id", "part_id", "b_cls"])


def _sides(parts: DataFrame, typed: DataFrame, prefix: str) -> DataFrame:
    """Parts of the classes of one side: assembly_id, part_id, type, part_index and the rank within the type."""
    spot, small = ["assembly_id", "part_id", "x", "y", "z"], all_small(parts)
    own = typed.select("assembly_id", "part_id", *[F.col(f"{prefix}_{c}").alias(c) for c in ("x", "y", "z", "type")]).distinct()
    p = unpack((gathered(parts) if small else parts).select("assembly_id", "part_index", "part_id", "transform")).select(*spot, "part_index")
    met = join_by(p, own, {c: c for c in spot[1:]}, small).select("assembly_id", "part_id", "type", "part_index")
    return ordinal(met, ["assembly_id", "part_id", "type"], ["part_index"], "rank", small)


def _runs(side: DataFrame) -> DataFrame:
    """Stretches of one type in list order: assembly_id, part_id, type, first part_index, first rank, length."""
    key = ["assembly_id", "part_id"]
    change = scan(side, key, ["part_index"], lags={"before": F.col("type")})
    numbered = scan(change, key, ["part_index"], sums={"run": F.when(F.col("before") == F.col("type"), 0).otherwise(1)})
    return numbered.groupBy(*key, "run", "type").agg(
        F.min("part_index").alias("first"), F.min("rank").alias("rank"), F.count(F.lit(1)).alias("n")
    ).drop("run")


def _meet(takers: pd.DataFrame, givers: pd.DataFrame, faces: pd.DataFrame) -> list[tuple]:
    """Intervals (taker type, first rank, giver type, first rank, length) of the walk over the takers' runs."""
    queues = {t: deque(g.sort_values("first")[["first", "rank", "n"]].values.tolist()) for t, g in givers.groupby("type")}
    choice = {t: f["b_type"].tolist() for t, f in faces.groupby("a_type")}
    out = []
    for kind, rank, n in takers.sort_values("first")[["type", "rank", "n"]].itertuples(index=False):
        while n:
            open_ = [t for t in choice[kind] if queues[t]]
            if not open_:
                break
            best = min(open_, key=lambda t: queues[t][0][0])
            head = queues[best][0]
            # a run of givers has no other giver in between, so it is taken as a whole
            took = min(n, head[2])
            out.append((kind, rank, best, head[1], took))
            rank, n = rank + took, n - took
            if took == head[2]:
                queues[best].popleft()
            else:
                # the next one is behind this one and before the next run
                queues[best][0] = [head[0], head[1] + took, head[2] - took]
    return out


def _intervals(parts: DataFrame, tangled: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Matched intervals of the tangled types, and both sides' parts with their ranks."""
    key = ["assembly_id", "part_id"]
    takers, givers = durable(_sides(parts, tangled, "a")), durable(_sides(parts, tangled, "b"))
    runs = _runs(takers).withColumn("side", F.lit("a")).unionByName(_runs(givers).withColumn("side", F.lit("b")))
    # aliases: both sides of the cogroup come from one table
    edges = tangled.select(*[F.col(c).alias(c) for c in (*key, "a_type", "b_type")]).distinct()
    ddl = ", ".join(f"{c} {parts.schema[c].dataType.simpleString()}" for c in key)

    def walk(k, rows: pd.DataFrame, faces: pd.DataFrame) -> pd.DataFrame:
        found = _meet(rows[rows["side"] == "a"], rows[rows["side"] == "b"], faces)
        frame = pd.DataFrame(found, columns=["a_type", "a_rank", "b_type", "b_rank", "n"])
        return frame.assign(assembly_id=k[0], part_id=k[1])[[*key, "a_type", "a_rank", "b_type", "b_rank", "n"]]

    met = runs.groupBy(*key).cogroup(edges.groupBy(*key)).applyInPandas(
        walk, f"{ddl}, a_type string, a_rank long, b_type string, b_rank long, n long"
    )
    return met, takers, givers


def _split(parts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Faces between types that face only one another, and those of the tangled types."""
    # stored before their types are found, which reads them three times: few classes face another, but all are looked at
    typed = durable(_types(durable(facing_classes(parts))))
    pairs = typed.select("assembly_id", "part_id", "a_type", "b_type").distinct()
    degree = lambda t, name: pairs.groupBy("assembly_id", "part_id", t).agg(F.count(F.lit(1)).alias(name))
    ranked = typed.join(degree("a_type", "outs"), ["assembly_id", "part_id", "a_type"]).join(degree("b_type", "ins"), ["assembly_id", "part_id", "b_type"])
    alone = (F.col("outs") == 1) & (F.col("ins") == 1)
    return ranked.filter(alone), ranked.filter(~alone)


def mirror_match(parts: DataFrame) -> DataFrame:
    """assembly_id, matched: how many parts the greedy walk gives a partner, in rows that add up per assembly."""
    simple, tangled = _split(parts)
    size = lambda p: simple.select("assembly_id", "part_id", "a_type", "b_type", f"{p}_cls", f"{p}_copies").distinct().groupBy(
        "assembly_id", "part_id", "a_type", "b_type").agg(F.sum(f"{p}_copies").alias(f"{p}_n"))
    direct = size("a").join(size("b"), ["assembly_id", "part_id", "a_type", "b_type"]).select("assembly_id", F.least("a_n", "b_n").alias("matched"))
    if tangled.isEmpty():
        return direct
    return direct.unionByName(_intervals(parts, tangled)[0].select("assembly_id", F.col("n").alias("matched")))


def mirror_partners(parts: DataFrame) -> DataFrame:
    """assembly_id, part_index, partner_index: the partner that the greedy walk gives each part; parts without one have no row."""
    simple, tangled = _split(parts)
    key = ["assembly_id", "part_id"]
    pairs = simple.select(*key, "a_type", "b_type").distinct()
    meet = pairs.join(_named(_sides(parts, simple, "a"), "a"), [*key, "a_type"]).withColumnRenamed("a_rank", "b_rank")
    walked = None
    if not tangled.isEmpty():
        met, takers, givers = _intervals(parts, tangled)
        each = met.withColumn("step", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)))
        each = each.select(*key, "a_type", (F.col("a_rank") + F.col("step")).alias("a_rank"), "b_type", (F.col("b_rank") + F.col("step")).alias("b_rank"))
        walked = each.join(_named(takers, "a"), [*key, "a_type", "a_rank"]).join(_named(givers, "b"), [*key, "b_type", "b_rank"])
    direct = meet.join(_named(_sides(parts, simple, "b"), "b"), [*key, "b_type", "b_rank"])
    columns = ["assembly_id", F.col("a_index").alias("part_index"), F.col("b_index").alias("partner_index")]
    out = direct.select(*columns)
    return out if walked is None else out.unionByName(walked.select(*columns))


def _named(side: DataFrame, prefix: str) -> DataFrame:
    names = {"type": f"{prefix}_type", "rank": f"{prefix}_rank", "part_index": f"{prefix}_index"}
    return side.select("assembly_id", "part_id", *[F.col(c).alias(n) for c, n in names.items()])
