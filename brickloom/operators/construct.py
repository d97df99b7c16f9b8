"""Voxel packing, candidate placements, beam steps, snapping and disassembly planning."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from brickloom.functions.geometry import (
    anchors, identity, solids, transform_from, unpack, with_dims, yaw_rotation,
)
from brickloom.operators.grouped import map_groups
from brickloom.operators.scans import first_per_key, fits, group_sizes, ordinal, scan, top_per_key
from brickloom.operators.spatial import (
    SMALL, all_small, blocked_pairs, clear_placements, gathered, join_by, placement_members, placements,
)
from brickloom.session import durable

STUD, BRICK = 20.0, 24.0
PITCH = {"x": STUD, "y": BRICK, "z": STUD}


# --- voxels ---------------------------------------------------------------------------------------


def voxel_bins(points: DataFrame) -> DataFrame:
    """Points (model_id, x, y, z) -> distinct integer voxels counted from the model's minimum."""
    ends = points.groupBy("model_id").agg(
        *[F.min(a).alias(f"lo_{a}") for a in PITCH], *[F.max(a).alias(f"hi_{a}") for a in PITCH]
    )
    index = []
    for a, pitch in PITCH.items():
        cells = F.greatest(F.lit(1), F.ceil((F.col(f"hi_{a}") - F.col(f"lo_{a}")) / pitch))
        index.append(F.least(F.floor((F.col(a) - F.col(f"lo_{a}")) / pitch), cells - 1).cast("int").alias(a))
    return points.distinct().join(ends, "model_id").select("model_id", *index).distinct()


def _blocks(voxels: DataFrame, dx: int, dz: int) -> tuple[DataFrame, DataFrame]:
    """Full dx x dz blocks on the layer's shifted grid, and the voxels left over."""
    shift = F.pmod("y", F.lit(2))
    keyed = voxels.withColumns({"bx": F.floor((F.col("x") - shift) / dx), "bz": F.floor((F.col("z") - shift) / dz)})
    key = ["model_id", "y", "bx", "bz"]
    inside = (F.col("bx") >= 0) & (F.col("bz") >= 0)
    full = keyed.filter(inside).groupBy(*key).agg(
        F.count(F.lit(1)).alias("n"), F.min("x").alias("x"), F.min("z").alias("z")
    ).filter(F.col("n") == dx * dz)
    rest = keyed.join(full.select(*key), key, "left_anti").select("model_id", "x", "y", "z")
    return full.select("model_id", "x", "y", "z"), rest


def _pairs(voxels: DataFrame, along: str, fixed: str) -> tuple[DataFrame, DataFrame]:
    """Neighbours paired from the start of every unbroken run; a window holds one grid line at most."""
    line = Window.partitionBy("model_id", "y", fixed).orderBy(along)
    runs = voxels.withColumn("run", F.col(along) - F.row_number().over(line))
    run = Window.partitionBy("model_id", "y", fixed, "run")
    runs = runs.withColumns({"pos": F.row_number().over(run.orderBy(along)), "size": F.count(F.lit(1)).over(run)})
    odd = F.col("pos") % 2 == 1
    head = odd & (F.col("pos") < F.col("size"))
    columns = ["model_id", "x", "y", "z"]
    return runs.filter(head).select(*columns), runs.filter(odd & (F.col("pos") == F.col("size"))).select(*columns)


def voxel_pack(voxels: DataFrame, origin: DataFrame | None = None) -> DataFrame:
    """Bricks for every layer: 2x4, 4x2, 1x2, 2x1, then single ones.

    The greedy scan over a layer equals a count per grid block and a pairing of runs, so no layer has
    to be walked. origin: model_id, min_x, min_y, min_z (zero when missing).
    """
    voxels = durable(voxels.select("model_id", "x", "y", "z").distinct())
    long, rest = _blocks(voxels, 2, 4)
    wide, rest = _blocks(durable(rest), 4, 2)
    deep, rest = _pairs(durable(rest), "z", "x")
    across, single = _pairs(durable(rest), "x", "z")
    # part, yaw, and the centre shift in studs of each kind
    kinds = [
        (long, "3001.dat", 0, 1.5, 2.5), (wide, "3001.dat", 1, 2.5, 1.5), (deep, "3004.dat", 0, 0.5, 1.5),
        (across, "3004.dat", 1, 1.5, 0.5), (single, "3005.dat", 0, 0.5, 0.5),
    ]
    bricks = None
    for phase, (df, part, yaw, sx, sz) in enumerate(kinds):
        one = df.select(
            "model_id", F.lit(phase).alias("phase"), F.col("x").alias("gx"), F.col("y").alias("layer"), F.col("z").alias("gz"),
            F.lit(part).alias("part_id"), F.lit(yaw).alias("yaw"),
            ((F.col("x") + sx) * STUD).alias("px"), ((F.col("z") + sz) * STUD).alias("pz"),
        )
        bricks = one if bricks is None else bricks.unionByName(one)
    layers = ordinal(voxels.select("model_id", F.col("y").alias("layer")).distinct(), ["model_id"], ["layer"], "k")
    out = bricks.join(layers, ["model_id", "layer"])
    corner = {a: F.lit(0.0) for a in "xyz"}
    if origin is not None:
        out = out.join(origin, "model_id", "left")
        corner = {a: F.coalesce(f"min_{a}", F.lit(0.0)) for a in "xyz"}
    y = -(corner["y"] + (F.col("layer") + 1) * BRICK)
    return out.select(
        "model_id", "phase", "gx", "layer", "gz", "part_id", F.lit(14).alias("color"),
        (F.col("k") + 1).cast("int").alias("step_id"),
        transform_from(F.col("px") + corner["x"], y, F.col("pz") + corner["z"], yaw_rotation(F.col("yaw"))).alias("transform"),
    )


# --- beam search ----------------------------------------------------------------------------------


def topn_candidates(scores: DataFrame, n: int, wanted: DataFrame | None = None) -> DataFrame:
    """Best n of every group by log-probability plus the wanted ones (group_id, item).

    scores: group_id, item, logp.
    """
    top = top_per_key(scores, ["group_id"], [F.desc("logp"), F.desc("item")], n, "rank").select("group_id", "item", "logp")
    if wanted is None:
        return top
    extra = scores.join(wanted.select("group_id", "item").distinct(), ["group_id", "item"], "left_semi")
    return top.unionByName(extra.select("group_id", "item", "logp")).distinct()


# placed parts whose candidates one task tries; each gives up to a hundred poses per candidate part
_STATE_ROWS = 10_000


def _hooked(state: DataFrame, candidates: DataFrame) -> DataFrame:
    """Distinct poses of ``candidate_placements`` as assembly_id, part_id, x, y, z, yaw.

    The poses of an assembly are made in one task and never move, so that task must not hold too many: rows are dealt
    by assembly into as many tasks as there are placed parts for. States beyond ``SMALL`` parts shuffle their poses instead.
    """
    largest, total = group_sizes(state, ["assembly_id"])
    small = largest <= SMALL
    host = state.select("assembly_id", "part_id", "transform")
    guest = candidates.select("assembly_id", "part_id").filter(F.col("part_id").isNotNull())
    if small:
        spark = state.sparkSession
        tasks = max(spark.sparkContext.defaultParallelism, -(-total // _STATE_ROWS))
        # with just the usual number Spark drops the step as one that changes nothing, and then joins small tasks
        tasks += tasks == int(spark.conf.get("spark.sql.shuffle.partitions"))
        host, guest = host.repartition(tasks, "assembly_id"), guest.repartition(tasks, "assembly_id")
    kinds = F.explode(F.array(F.lit("stud"), F.lit("socket")))
    p = anchors(solids(host.distinct()).withColumn("kind", kinds), F.col("kind"), ["assembly_id", "kind"], 2).select(
        "assembly_id", F.when(F.col("kind") == "stud", "socket").otherwise("stud").alias("kind"),
        F.col("ax").alias("px"), F.col("ay").alias("py"), F.col("az").alias("pz"),
    ).distinct()
    flat = unpack(with_dims(guest).withColumn("transform", identity())).drop("transform")
    met = p.join(flat.hint("shuffle_hash") if small else flat, "assembly_id")
    spot = ["ax", "ay", "az"]
    rows = anchors(met, F.col("kind"), ["assembly_id", "part_id", "px", "py", "pz"], 2)
    rows = rows.withColumn("yaw", F.explode(F.sequence(F.lit(0), F.lit(3))))
    rot = yaw_rotation(F.col("yaw"))
    turned = [sum((rot[3 * i + k] * F.col(spot[k]) for k in range(3)), F.lit(0.0)) for i in range(3)]
    at = [(F.col(f"p{a}") - turned[i] + 0.0).alias(a) for i, a in enumerate("xyz")]
    poses = rows.select("assembly_id", "part_id", *at, "yaw")
    return (poses if small else poses.repartition(*poses.columns)).distinct()


def candidate_placements(state: DataFrame, candidates: DataFrame) -> DataFrame:
    """Every way to hook a candidate part onto the first two anchors of a placed part.

    state: placed parts of small states keyed by assembly_id; candidates: assembly_id, part_id.
    Gives assembly_id, part_id, transform (distinct), not yet checked.
    """
    rot = [r + 0.0 for r in yaw_rotation(F.col("yaw"))]
    pose = transform_from(F.col("x"), F.col("y"), F.col("z"), rot)
    return _hooked(state, candidates).select("assembly_id", "part_id", pose.alias("transform"))


def valid_placements(state: DataFrame, placed: DataFrame) -> DataFrame:
    """Candidates that pass the placement check, with a stable id per assembly."""
    # they hang on an anchor by construction, so only collisions are left to check
    return clear_placements(state, placed.withColumn("candidate_id", F.xxhash64("part_id", "transform")))


def part_signature(part: Column, color: Column, transform: Column) -> Column:
    """Part, colour and pose rounded to two decimals."""
    return F.concat_ws(" ", part, color.cast("string"), _pose_text(transform))


def _pose_text(transform: Column) -> Column:
    """The sixteen rounded values of a pose; those that every quarter turn has are not formatted, which is most of them."""

    def text(v: Column) -> Column:
        whole = F.when(v == 0.0, "0.0").when(v == 1.0, "1.0").when(v == -1.0, "-1.0")
        return whole.otherwise((F.rint(v * 100) / 100 + 0.0).cast("string"))

    return F.concat_ws(" ", *[text(F.get(transform, F.lit(i))) for i in range(16)])


def inventory_bias(have: Column, target: Column) -> Column:
    return F.when(target.isNull(), 0.0).when(target > 0, F.when(have < target, 2.0).otherwise(-10.0)).otherwise(-20.0)


def beam_topk(rows: DataFrame, width: int) -> DataFrame:
    """Best ``width`` distinct states per group: group_id, state_id, signature, score, ... -> + rank.

    Equal states count once with their best score; ties go by signature.
    """
    best = first_per_key(rows.withColumn("_neg", -F.col("score")), ["group_id", "signature"], ["_neg", "state_id"]).drop("_neg")
    return top_per_key(best, ["group_id"], [F.desc("score"), F.asc("signature")], width, "rank")


def beam_step(states: DataFrame, parts: DataFrame, part_scores: DataFrame, color_scores: DataFrame,
              width: int, inventory: DataFrame | None = None) -> DataFrame:
    """One placement step of every beam.

    states: group_id, state_id, signature, score; parts: placed parts with assembly_id = state_id;
    part_scores: state_id, part_id, logp; color_scores: state_id, color, logp; inventory: group_id,
    part_id, target. Gives the next states with the part that was added.
    """
    wanted = part_scores.select(F.col("state_id").alias("assembly_id"), "part_id")
    valid = valid_placements(parts, candidate_placements(parts, wanted)).select(
        F.col("assembly_id").alias("state_id"), "part_id", "transform"
    )
    # poses of one state and part differ in the end of their signature only, so just the first ``width`` of them can be among the best
    key = ["state_id", "part_id"]
    ahead = Window.partitionBy(*key).orderBy("_text")
    first = valid.withColumn("_text", _pose_text(F.col("transform"))).withColumn("_r", F.dense_rank().over(ahead)).filter(F.col("_r") <= width)
    poses = first.groupBy(*key).agg(F.collect_list(F.struct("_text", "transform")).alias("_poses"))
    rows = part_scores.withColumnRenamed("logp", "_pl").join(states, "state_id")
    bias = F.lit(0.0)
    if inventory is not None:
        counts = parts.groupBy(F.col("assembly_id").alias("state_id"), "part_id").agg(F.count(F.lit(1)).alias("_have"))
        limited = inventory.select("group_id").distinct().withColumn("_limited", F.lit(True))
        rows = (
            rows.join(counts, key, "left")
            .join(inventory, ["group_id", "part_id"], "left")
            .join(limited, "group_id", "left")
        )
        target = F.when(F.col("_limited"), F.coalesce("target", F.lit(0)))
        bias = inventory_bias(F.coalesce("_have", F.lit(0)), target)
    rows = rows.withColumn("_bias", bias).select("group_id", *key, "signature", "score", "_pl", "_bias")
    rows = rows.join(poses, key).join(color_scores.withColumnRenamed("logp", "_cl"), "state_id").withColumn(
        "score", F.col("score") + F.col("_pl") + F.col("_cl") + F.col("_bias")
    )
    # a part and colour give a state signatures that no other ones give it, so those behind ``width`` better ones cannot be among the best;
    # rows that repeat a part and colour count once, and like in ``beam_topk`` without a score if one of them has none
    state = ["group_id", "state_id", "signature"]
    same = Window.partitionBy(*state, "part_id", "color")
    rows = rows.withColumn("_best", F.when(F.count("score").over(same) == F.count(F.lit(1)).over(same), F.max("score").over(same)))
    better = Window.partitionBy(*state, F.col("color").isNull()).orderBy(F.desc("_best"), "part_id", "color")
    rows = rows.withColumn("_r", F.dense_rank().over(better)).filter((F.col("_r") <= width) | F.col("_best").isNull())
    grown = rows.withColumn("_pose", F.explode("_poses")).select(
        "group_id", "state_id", "part_id", "color", F.col("_pose.transform").alias("transform"),
        F.concat_ws("|", "signature", F.concat_ws(" ", "part_id", F.col("color").cast("string"), "_pose._text")).alias("signature"),
        "score",
    )
    return beam_topk(grown, width)


def beam_search(starts: DataFrame, part_scores: DataFrame, color_scores: DataFrame, width: int, steps: int,
                inventory: DataFrame | None = None) -> DataFrame:
    """Grow all beams together, one joint round per placed part.

    starts: group_id, part_id, color, transform, one state each; part_scores: group_id, part_id, logp; color_scores: group_id,
    color, logp; inventory as in ``beam_step``. A part is stored once, in the state that placed it; a state is its own part and
    the list of states it came from, which grows by one row a round. Signatures are digests, so they keep their size. A group
    that finds no place keeps its states, and is not tried again. Gives the parts of the last states of every group: group_id,
    rank, score, step_id, part_id, color, transform.
    """
    own = part_signature(F.col("part_id"), F.col("color"), F.col("transform"))
    rows = starts.select("group_id", "part_id", "color", "transform", own.alias("signature"), F.lit(0.0).alias("score"), F.lit("").alias("state_id"))
    placed, line, ended = None, None, None
    for step in range(steps + 1):
        if step:
            of_group = states.select("group_id", "state_id")
            parts = line.join(placed, "node").select(F.col("state_id").alias("assembly_id"), "part_id", "color", "transform").withColumn("part_index", F.col("assembly_id"))
            grown = beam_step(
                states, parts, of_group.join(part_scores, "group_id").drop("group_id"), of_group.join(color_scores, "group_id").drop("group_id"), width, inventory
            )
        else:
            grown = beam_topk(rows, width)
        grown = durable(grown.withColumns({
            "parent": F.col("state_id"), "state_id": F.concat_ws("/", "group_id", F.lit(step), "rank"), "signature": F.sha2("signature", 256), "step_id": F.lit(step),
        }))
        if step:
            stuck = states.join(grown.select("group_id").distinct(), "group_id", "left_anti")
            ended = stuck if ended is None else ended.unionByName(stuck)
        if step and grown.isEmpty():
            states = grown.select("group_id", "state_id", "signature", "score", "rank")
            break
        new = grown.select(F.col("state_id").alias("node"), "step_id", "part_id", "color", "transform")
        itself = grown.select("state_id", F.col("state_id").alias("node"))
        if step:
            before = grown.select("state_id", "parent").join(line.withColumnRenamed("state_id", "parent"), "parent").select("state_id", "node")
            # lines of stuck states stay for the result
            kept = line.join(ended.select("state_id"), "state_id", "left_semi")
            line, placed = durable(itself.unionByName(before).unionByName(kept)), placed.unionByName(new)
        else:
            line, placed = itself, new
        states = grown.select("group_id", "state_id", "signature", "score", "rank")
    last = states if ended is None else states.unionByName(ended)
    return last.join(line, "state_id").join(placed, "node").select("group_id", "rank", "score", "step_id", "part_id", "color", "transform")


# --- snapping -------------------------------------------------------------------------------------


def _studs(side: str) -> Column:
    return F.greatest(F.lit(1), F.rint(F.col(side) / STUD).cast("int"))


def _odd_shift(count: Column, before: Column) -> Column:
    """Offset of the first grid that lines up: none for equal parity, else half a stud to the left.

    The search list starts 0, -10; two grids always line up on one of the two.
    """
    return F.when((count - before) % 2 == 0, 0.0).otherwise(-10.0)


def _sized(parts: DataFrame) -> DataFrame:
    sized = with_dims(parts.select("assembly_id", "part_index", "part_id", "color", "step_id"))
    return sized.withColumns({"_nx": _studs("w"), "_nz": _studs("d")})


def snap_stack(parts: DataFrame) -> DataFrame:
    """Pile parts in list order, each on the previous one at the first offset that connects.

    With upright parts that offset depends only on the two stud counts, so the pile is a running sum.
    Starts at x = z = 10.
    """
    small = fits(parts, ["assembly_id"])
    df = scan(_sized(parts), ["assembly_id"], ["part_index"], sums={"_top": F.col("h")},
              lags={"_px": F.col("_nx"), "_pz": F.col("_nz")}, bounded=small)
    moves = {
        f"_d{a}": F.when(F.col(f"_p{a}").isNull(), 0.0).otherwise(_odd_shift(F.col(f"_n{a}"), F.col(f"_p{a}")))
        for a in "xz"
    }
    df = scan(df.withColumns(moves), ["assembly_id"], ["part_index"], sums={"_x": F.col("_dx"), "_z": F.col("_dz")}, bounded=small)
    return df.select("assembly_id", "part_index", "part_id", "color", "step_id", (F.col("_x") + 10.0).alias("x"),
                     (F.col("h") - F.col("_top")).alias("y"), (F.col("_z") + 10.0).alias("z"))


_LISTED = [8.0, 16.0, 24.0]


def snap_search(parts: DataFrame) -> DataFrame:
    """Variant that also searches heights and looks back over earlier parts.

    A height from the search list connects a part with any earlier one; a part of another height needs
    an earlier part with a listed one, the latest of which it hangs on without carrying others. Until
    such a part exists, parts pile up on the previous height. Positions are sums along that chain.
    """
    listed = F.col("h").isin(_LISTED)
    small = fits(parts, ["assembly_id"])
    df = _sized(parts).withColumn("_good", listed)
    me = F.struct(F.col("h").alias("h"), F.col("_nx").alias("nx"), F.col("_nz").alias("nz"))
    df = scan(df, ["assembly_id"], ["part_index"], rank="_k", lags={"_prev": me, "_prev_good": F.col("_good")},
              lasts={"_last_good": F.when(F.col("_good"), F.struct(F.col("part_index").alias("i"), me.alias("v")))}, bounded=small)
    df = scan(df, ["assembly_id"], [F.col("part_index").desc()], lags={"_next_good": F.col("_good")}, bounded=small)
    df = scan(df, ["assembly_id"], ["part_index"], lags={"_earlier": F.col("_last_good")}, bounded=small)
    first, good = F.col("_k") == 0, F.col("_good")
    hangs = ~good & F.col("_earlier").isNotNull()
    base = F.when(hangs, F.col("_earlier.v")).otherwise(F.col("_prev"))
    # stud of the earlier part under this one, or this one's stud under the earlier part
    up, down = base["h"], F.col("h")
    ups, downs = up.isin(_LISTED), down.isin(_LISTED)
    dy = F.when(ups & (~downs | (up <= down)), -up).when(downs, down)
    linked = ~first & (good | hangs)
    step_y = F.when(first, 0.0).when(linked, dy).otherwise(-base["h"])
    step = {
        "_dx": F.when(linked, _odd_shift(F.col("_nx"), base["nx"])).otherwise(0.0),
        "_dy": step_y,
        "_dz": F.when(linked, _odd_shift(F.col("_nz"), base["nz"])).otherwise(0.0),
        "_carries": ~hangs | F.coalesce("_next_good", F.lit(False)),
    }
    df = df.withColumns(step)
    carried = {f"_c{a}": F.when(F.col("_carries"), F.col(f"_d{a}")).otherwise(0.0) for a in "xyz"}
    df = scan(df.withColumns(carried), ["assembly_id"], ["part_index"], sums={f"_s{a}": F.col(f"_c{a}") for a in "xyz"}, bounded=small)
    own = {a: F.col(f"_s{a}") + F.when(F.col("_carries"), 0.0).otherwise(F.col(f"_d{a}")) for a in "xyz"}
    return df.select("assembly_id", "part_index", "part_id", "color", "step_id", (own["x"] + 10.0).alias("x"),
                     own["y"].alias("y"), (own["z"] + 10.0).alias("z"))


# --- disassembly ----------------------------------------------------------------------------------

_EDGES = [f"{e}_{a}" for a in "xyz" for e in ("min", "max")]


def _layers(box: np.ndarray, mean_y: np.ndarray) -> np.ndarray:
    """Removal number of every part of one small assembly (rows in list order).

    Parts leave in layers: all that nothing holds any more, by the number of the last part that held them and then by list
    order. Where every part is held, the highest one is a layer of its own. box columns: min and max of x, y, z.
    """
    lo_x, hi_x, lo_y, hi_y, lo_z, hi_z = box.T
    holds = lo_y[None, :] < hi_y[:, None] - 0.1  # [part, holder]
    for lo, hi in ((lo_x, hi_x), (lo_z, hi_z)):
        holds &= (lo[:, None] - 0.1 <= hi[None, :]) & (hi[:, None] + 0.1 >= lo[None, :])
    np.fill_diagonal(holds, False)
    number = np.full(len(box), -1)
    last = np.full(len(box), -1)
    while (number < 0).any():
        inside = number < 0
        open_ = inside & ~(holds & inside[None, :]).any(axis=1)
        if not open_.any():
            open_[np.flatnonzero(inside)[np.argmin(mean_y[inside])]] = True
        layer = np.flatnonzero(open_)
        layer = layer[np.argsort(last[layer], kind="stable")]
        number[layer] = (~inside).sum() + np.arange(len(layer))
        last = np.maximum(last, np.where(holds[:, layer], number[layer][None, :], -1).max(axis=1))
    return number


def _layer_frame(frame: pd.DataFrame) -> pd.DataFrame:
    starts = np.flatnonzero(frame["assembly_id"].ne(frame["assembly_id"].shift()).to_numpy())
    box, mean_y = frame[_EDGES].to_numpy(), frame["mean_y"].to_numpy()
    number = np.empty(len(frame), dtype=np.int32)
    for lo, hi in zip(starts, [*starts[1:], len(frame)]):
        number[lo:hi] = _layers(box[lo:hi], mean_y[lo:hi])
    return pd.DataFrame({"assembly_id": frame["assembly_id"], "part_index": frame["part_index"], "remove_no": number})


def disassembly_order(parts: DataFrame, small: int = 2000) -> DataFrame:
    """remove_no and build_no per part. Assemblies above ``small`` parts leave in joint rounds."""
    key = parts.schema["assembly_id"].dataType.simpleString()
    sizes = parts.groupBy("assembly_id").agg(F.count(F.lit(1)).alias("n_parts"))
    sized = parts.join(sizes, "assembly_id")
    body = solids(sized.select("assembly_id", "part_index", "part_id", "transform", "n_parts"))
    tight = body.filter(F.col("n_parts") <= small).select("assembly_id", "part_index", "mean_y", *_EDGES)
    schema = f"assembly_id {key}, part_index int, remove_no int"
    order = map_groups(tight, "assembly_id", ["part_index"], _layer_frame, schema)
    large = sized.filter(F.col("n_parts") > small).drop("n_parts")
    if not large.isEmpty():
        order = order.unionByName(_epoch_rounds(large))
    return order.join(sizes, "assembly_id").select(
        "assembly_id", "part_index", "remove_no", (F.col("n_parts") - 1 - F.col("remove_no")).cast("int").alias("build_no")
    )


def _ranks(parts: DataFrame) -> DataFrame:
    """assembly_id, part_index, part (its placement), rank from the highest part on (1, 2, ...); equal heights in list order."""
    height = solids(placements(parts).select("assembly_id", "part_id", "transform", F.col("owner").alias("part"))).select("assembly_id", "part", "mean_y")
    members = placement_members(parts).withColumnRenamed("owner", "part").join(height, ["assembly_id", "part"])
    ranked = ordinal(members, ["assembly_id"], ["mean_y", "part_index"], "rank")
    return ranked.select("assembly_id", "part_index", "part", (F.col("rank") + 1).alias("rank"))


def _released(nodes: DataFrame, blocks: DataFrame) -> DataFrame:
    """nodes with ``epoch``: the rank of the part whose forced removal lets the last copy of a placement go (0: none has to).

    A part stays while, among the parts below a rank, a chain of holders from it runs into a cycle. So its epoch is the best that
    such chains have as their least rank: its own rank, or, if that comes first, the greatest epoch among its holders. Copies
    hold one another, hence ``before``: the rank of the last copy but one. Rounds end with the longest cascade of parts that go
    without force; how many parts block each other plays no part.
    """
    at = durable(nodes.withColumn("epoch", F.col("rank")))
    while True:
        holder = at.select("assembly_id", F.col("part").alias("blocker"), F.col("epoch").alias("theirs"))
        held = blocks.join(holder, ["assembly_id", "blocker"]).groupBy("assembly_id", "part").agg(F.max("theirs").alias("theirs"))
        until = F.least("rank", F.greatest("before", F.coalesce("theirs", F.lit(0))))
        step = durable(at.join(held, ["assembly_id", "part"], "left").select(*nodes.columns, until.alias("epoch"), F.col("epoch").alias("old")))
        at = step.drop("old")
        if step.filter("epoch <> old").isEmpty():
            return at


def _epoch_rounds(parts: DataFrame) -> DataFrame:
    """Removal numbers for assemblies of any size, in joint rounds over all assemblies and epochs."""
    ranks = durable(_ranks(parts))
    last = ranks.groupBy("assembly_id", "part").agg(F.max(F.struct("rank", "part_index")).alias("last"))
    last = last.select("assembly_id", "part", "last.rank", "last.part_index")
    others = ranks.join(last.select("assembly_id", "part_index", F.lit(True).alias("is_last")), ["assembly_id", "part_index"], "left").filter("is_last IS NULL")
    before = others.groupBy("assembly_id", "part").agg(F.max("rank").alias("before"))
    nodes = last.join(before, ["assembly_id", "part"], "left").withColumn("before", F.coalesce("before", F.lit(0)))
    blocks = durable(blocked_pairs(parts).filter("part <> blocker").select("assembly_id", "part", "blocker"))
    at = durable(_released(nodes, blocks))
    # forced parts open their epoch; all other copies but the last are forced one by one
    forced = at.filter("epoch = rank").select("assembly_id", "part_index", F.col("rank").alias("epoch")).unionByName(
        others.select("assembly_id", "part_index", F.col("rank").alias("epoch"))
    ).withColumn("place", F.lit(0))
    left = at.filter("epoch < rank").select("assembly_id", "part", "part_index", "epoch")
    holder = left.select("assembly_id", F.col("part").alias("blocker"), F.col("epoch").alias("theirs"))
    inner = durable(
        blocks.join(left.select("assembly_id", "part", "epoch"), ["assembly_id", "part"]).join(holder, ["assembly_id", "blocker"])
        .filter("epoch = theirs").select("assembly_id", "part", "blocker")
    )
    left, done = durable(left), None
    first = F.when(F.col("epoch") > 0, 0).otherwise(-1)
    while not left.isEmpty():
        waiting = inner.join(left.select("assembly_id", F.col("part").alias("blocker")), ["assembly_id", "blocker"], "left_semi")
        free = left.join(waiting.select("assembly_id", "part").distinct(), ["assembly_id", "part"], "left_anti")
        if done is None:
            ready = free.withColumns({"held": first, "base": first + 1})
        else:
            gone = done.select("assembly_id", F.col("part").alias("blocker"), "place")
            held = inner.join(gone, ["assembly_id", "blocker"]).groupBy("assembly_id", "part").agg(F.max("place").alias("held"))
            base = done.groupBy("assembly_id", "epoch").agg(F.count(F.lit(1)).alias("n"))
            ready = free.join(held, ["assembly_id", "part"], "left").join(base, ["assembly_id", "epoch"], "left")
            ready = ready.withColumns({"held": F.coalesce("held", first), "base": first + 1 + F.coalesce("n", F.lit(0))}).drop("n")
        numbered = ordinal(durable(ready), ["assembly_id", "epoch"], ["held", "part_index"], "k")
        layer = numbered.select("assembly_id", "part", "part_index", "epoch", (F.col("base") + F.col("k")).cast("int").alias("place"))
        done = durable(layer if done is None else done.unionByName(layer))
        left = durable(left.join(done.select("assembly_id", "part"), ["assembly_id", "part"], "left_anti"))
    if done is not None:
        forced = forced.unionByName(done.select("assembly_id", "part_index", "epoch", "place"))
    return ordinal(forced, ["assembly_id"], ["epoch", "place"], "remove_no").select("assembly_id", "part_index", "remove_no")


def _peel(frame: pd.DataFrame) -> pd.DataFrame:
    """Levels of all placements of whole small assemblies; rows are a part with a blocker, or once without."""
    group, groups = pd.factorize(frame["assembly_id"])
    held = frame["blocker"].notna().to_numpy()
    names, name = np.unique(np.concatenate([frame["part"], frame["blocker"][held].astype(frame["part"].dtype)]), return_inverse=True)
    codes, node = np.unique(group.astype(np.int64) * len(names) + name[: len(frame)], return_inverse=True)
    part, by = node[held], np.searchsorted(codes, group[held].astype(np.int64) * len(names) + name[len(frame) :])
    level = np.zeros(len(codes), dtype=np.int64)
    level[part] = -1
    step = 0
    while True:
        step += 1
        ready = level < 0
        ready[part[level[by] < 0]] = False
        if not ready.any():
            break
        level[ready] = step
    found = pd.Series(level, dtype="Int32").mask(level < 0)
    return pd.DataFrame({"assembly_id": groups[codes // len(names)], "part": names[codes % len(names)], "level": found})


def _small_levels(nodes: DataFrame, blocks: DataFrame) -> DataFrame:
    """Levels of small assemblies, batch by batch where they lie; what belongs to no assembly has none."""
    key = ", ".join(f"{c} {nodes.schema[c].dataType.simpleString()}" for c in ("assembly_id", "part"))
    near = gathered(nodes)
    held = join_by(near, blocks, {"part": "part"}, True, "left").select("assembly_id", "part", "blocker")
    levels = map_groups(held, "assembly_id", [], _peel, f"{key}, level int")
    loose = nodes.filter("assembly_id IS NULL").withColumn("level", F.lit(None).cast("int"))
    return join_by(near, levels, {"part": "part"}, True, "left").unionByName(loose)


def disassembly_levels(parts: DataFrame) -> DataFrame:
    """Peel level of every placement; NULL for those in or under a blocking cycle."""
    blocks = blocked_pairs(parts).select("assembly_id", "part", "blocker")
    nodes = placements(parts).select("assembly_id", F.col("owner").alias("part"))
    if all_small(parts):
        return _small_levels(nodes, blocks)
    blocks = durable(blocks)
    done = durable(
        nodes.join(blocks.select("assembly_id", "part").distinct(), ["assembly_id", "part"], "left_anti")
        .withColumn("level", F.lit(0))
    )
    level = 0
    while True:
        level += 1
        known = done.select("assembly_id", F.col("part").alias("blocker"), F.lit(True).alias("_k"))
        ready = (
            blocks.join(done.select("assembly_id", "part"), ["assembly_id", "part"], "left_anti")
            .join(known, ["assembly_id", "blocker"], "left")
            .groupBy("assembly_id", "part")
            .agg(F.min(F.col("_k").isNotNull()).alias("free"))
            .filter("free")
            .select("assembly_id", "part", F.lit(level).alias("level"))
        )
        ready = durable(ready)
        if ready.isEmpty():
            break
        done = durable(done.unionByName(ready))
    return nodes.join(done, ["assembly_id", "part"], "left")
