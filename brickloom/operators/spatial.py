"""Spatial joins between placed parts, always through grid cells and never as a cross join.

Parts with the same id and pose are one *placement* with a number of copies. Pair results are
given between placements with both copy counts, which is lossless and keeps a pile of coincident
copies from turning into all of its pairs; ``expand_pairs`` lists part pairs where that is wanted.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from brickloom.functions.geometry import (
    BOX,
    SHAPE,
    STUD,
    relative_matrix,
    relative_transform,
    solids,
)
from brickloom.operators.scans import all_of, fits, group_sizes, opaque, ordinal, scan
from brickloom.session import durable

CONTACT = 1.0
PLACING = 5.0
_CELL = {"x": 60.0, "y": 24.0, "z": 60.0}


def placements(parts: DataFrame) -> DataFrame:
    """One row per distinct (part, pose): ``owner`` is its first part_index."""
    return parts.groupBy("assembly_id", "part_id", "transform").agg(
        F.min("part_index").alias("owner"), F.count(F.lit(1)).alias("copies")
    )


SMALL = 48


def all_small(rows: DataFrame, key: str = "assembly_id") -> bool:
    """True when no key has more than ``SMALL`` rows, so that rows of one key may meet on it alone, where they lie."""
    return group_sizes(rows, [key])[0] <= SMALL


def gathered(rows: DataFrame, key: str = "assembly_id") -> DataFrame:
    """Rows dealt by their key; Spark drops the step where they lie so already. Rows without a key are left out."""
    return rows.filter(F.col(key).isNotNull()).repartition(key)


def bodies(parts: DataFrame, stored: bool = False) -> DataFrame:
    """Placements as solids, with ``crowd``: the number of parts in their assembly.

    Stored once, since every pair join reads it at least twice. Where all assemblies are small nothing is stored, unless wanted,
    and there is no ``crowd``: solids are worked out wherever they are read, from parts that lie with their assembly.
    """
    if not stored and all_small(parts):
        return solids(placements(gathered(parts)))
    sizes = parts.groupBy("assembly_id").agg(F.count(F.lit(1)).alias("crowd"))
    return durable(solids(placements(parts).join(sizes, "assembly_id")))


def placement_members(parts: DataFrame, places: DataFrame | None = None, pose: bool = False) -> DataFrame:
    """assembly_id, owner, part_index for every part, with its transform for ``pose``."""
    keys = ["assembly_id", "part_id", "transform"]
    named = ["assembly_id", "owner", "part_index", *(["transform"] if pose else [])]
    if places is None and fits(parts, ["assembly_id"]):
        return owned(parts).select(*named)
    places = placements(parts) if places is None else places
    return parts.select(*keys, "part_index").join(
        places.select(*keys, "owner"), keys
    ).select(*named)


def owned(parts: DataFrame) -> DataFrame:
    """Parts with the ``owner`` of their placement, for assemblies that fit a task."""
    keys = ["assembly_id", "part_id", "transform"]
    known = gathered(parts).filter("part_id IS NOT NULL AND transform IS NOT NULL")
    return known.withColumn("owner", F.min("part_index").over(Window.partitionBy(*keys)))


def join_by(rows: DataFrame, others: DataFrame, on: dict[str, str], small: bool, how: str = "inner", key: str = "assembly_id") -> DataFrame:
    """``rows`` with the ``others`` of the same assembly whose columns (values of ``on``) equal theirs (keys of ``on``).

    Those of ``small`` assemblies meet on the assembly alone, so that neither side moves if it lies with its assembly.
    """
    names = {key: "_key", **{v: f"_on_{v}" for v in on.values()}}
    others = others.withColumnsRenamed(names)
    pairs = [(F.col(k), F.col(f"_on_{v}")) for k, v in on.items()]
    # written as a range, or the planner would deal both sides out by these columns too
    same = [(a <= b) & (a >= b) if small else a == b for a, b in pairs]
    met = rows.join(others, all_of([F.col(key) == F.col("_key"), *same]), how)
    return met if how in ("left_semi", "left_anti") else met.drop(*names.values())


def anchor_hits(pairs: DataFrame, stud: str, socket: str, reach: float, keep: list[str], gap: str | None = None) -> DataFrame:
    """Stud/socket meetings within pairs of solids: ``keep`` plus stud_idx, socket_idx and the squared distance as ``gap``.

    ``stud`` and ``socket`` are the column prefixes of both solids. Only the studs are listed. Sockets
    lie on a 20-unit grid, so in the socket solid's own frame the one within ``reach`` (at most 5) is
    the rounded grid point; distorted poses try every socket. Studs and sockets of upright solids lie on one
    level each, so levels too far apart are dropped before any stud is listed.
    """
    p, k = (lambda c: F.col(f"{stud}{c}")), (lambda c: F.col(f"{socket}{c}"))
    level = p("r11") * -p("h") + p("y") - k("y")
    upright = all_of([q(c) == 0.0 for q in (p, k) for c in ("r10", "r12")])
    rows = pairs.filter(~opaque(upright & (level * level >= reach * reach)))
    rows = rows.withColumn("stud_idx", F.explode(F.sequence(F.lit(0), p("nx") * p("nz") - 1)))

    def spot(q, index: Column, height: Column) -> list[Column]:
        lx = STUD * F.floor(index / q("nz")) - 10.0 * (q("nx") - 1)
        lz = STUD * (index % q("nz")) - 10.0 * (q("nz") - 1)
        return [q(f"r{i}0") * lx + q(f"r{i}1") * height + q(f"r{i}2") * lz + q(a) for i, a in enumerate("xyz")]

    rows = rows.withColumns(dict(zip(("_ax", "_ay", "_az"), spot(p, F.col("stud_idx"), -p("h")))))

    def grid(axis: int, count: Column) -> Column:
        local = sum((k(f"r{i}{axis}") * (F.col(f"_a{a}") - k(a)) for i, a in enumerate("xyz")), F.lit(0.0))
        at = F.rint((local + 10.0 * (count - 1)) / STUD)
        return F.greatest(F.lit(0.0), F.least(at, count - 1.0)).cast("int")

    nearest = grid(0, k("nx")) * k("nz") + grid(2, k("nz"))
    every = F.sequence(F.lit(0), k("nx") * k("nz") - 1)
    # listed and filtered as rows: a filter inside the array runs a lambda per stud outside generated code
    rows = rows.withColumn("socket_idx", F.explode(F.when(k("rigid"), F.array(nearest)).otherwise(every)))
    off = [F.col(f"_a{a}") - v for a, v in zip("xyz", spot(k, F.col("socket_idx"), F.lit(0.0)))]
    rows = rows.withColumn("_gap", off[0] * off[0] + off[1] * off[1] + off[2] * off[2]).filter(opaque(F.col("_gap") < reach * reach))
    return rows.select(*keep, "stud_idx", "socket_idx", *([F.col("_gap").alias(gap)] if gap else []))


def _vertical_touch(p: str, q: str, slack: float = 2.0) -> Column:
    return (F.abs(F.col(f"{p}max_y") - F.col(f"{q}min_y")) < slack) | (
        F.abs(F.col(f"{q}max_y") - F.col(f"{p}min_y")) < slack
    )


def contact_pairs(parts: DataFrame) -> DataFrame:
    """Touching placements: vertical faces meet and some stud meets some socket.

    part_a < part_b are the first part indexes of both placements.
    """
    body = bodies(parts)
    return _contacts(body)


def _contacts(body: DataFrame) -> DataFrame:
    near = box_pairs(body, body, ["owner", "copies", *SHAPE], pad=CONTACT).filter(
        opaque((F.col("a_owner") != F.col("b_owner")) & _vertical_touch("a_", "b_"))
    )
    owners = ["assembly_id", "a_owner", "b_owner", "a_copies", "b_copies"]
    forward = F.col("a_owner") < F.col("b_owner")
    return anchor_hits(near, "a_", "b_", CONTACT, owners).select(
        "assembly_id",
        F.least("a_owner", "b_owner").alias("part_a"),
        F.greatest("a_owner", "b_owner").alias("part_b"),
        F.when(forward, F.col("a_copies")).otherwise(F.col("b_copies")).alias("copies_a"),
        F.when(forward, F.col("b_copies")).otherwise(F.col("a_copies")).alias("copies_b"),
    ).distinct()


def expand_pairs(pairs: DataFrame, parts: DataFrame) -> DataFrame:
    """Placement pairs -> part pairs (src < dst)."""
    members = placement_members(parts)
    a = members.select("assembly_id", F.col("owner").alias("part_a"), F.col("part_index").alias("i"))
    b = members.select("assembly_id", F.col("owner").alias("part_b"), F.col("part_index").alias("j"))
    rows = pairs.join(a, ["assembly_id", "part_a"]).join(b, ["assembly_id", "part_b"])
    return rows.filter((F.col("part_a") != F.col("part_b")) | (F.col("i") < F.col("j"))).select(
        "assembly_id", F.least("i", "j").alias("src"), F.greatest("i", "j").alias("dst")
    )


def contact_edges_directed(parts: DataFrame) -> DataFrame:
    """Both directions of every contact with the 12-value edge feature."""
    body = bodies(parts)
    pairs = _contacts(body)
    both = pairs.select("assembly_id", F.col("part_a").alias("src"), F.col("part_b").alias("dst"),
                        F.col("copies_a").alias("src_copies"), F.col("copies_b").alias("dst_copies"))
    both = both.unionByName(
        both.select("assembly_id", F.col("dst").alias("src"), F.col("src").alias("dst"),
                    F.col("dst_copies").alias("src_copies"), F.col("src_copies").alias("dst_copies"))
    )
    pose = body.select("assembly_id", "owner", "transform")
    src = pose.select("assembly_id", F.col("owner").alias("src"), F.col("transform").alias("ta"))
    dst = pose.select("assembly_id", F.col("owner").alias("dst"), F.col("transform").alias("tb"))
    return (
        both.join(src, ["assembly_id", "src"])
        .join(dst, ["assembly_id", "dst"])
        .select("assembly_id", "src", "dst", "src_copies", "dst_copies",
                relative_transform("ta", "tb").alias("edge_attr"))
    )


# --- box joins -----------------------------------------------------------------------------------


def _box_tests(axis: str, pad: float) -> list[Column]:
    low, high = F.col(f"a_min_{axis}") - pad, F.col(f"a_max_{axis}") + pad
    return [low <= F.col(f"b_max_{axis}"), high >= F.col(f"b_min_{axis}")]


def box_pairs(a: DataFrame, b: DataFrame, keep: list[str], axes: str = "xyz", pad: float = 0.0) -> DataFrame:
    """Pairs of one assembly whose boxes (grown by ``pad``) overlap on ``axes``. Prefixes: ``a_``, ``b_``.

    Assemblies with few parts (``crowd``; all of them where there is none) meet on the assembly alone, which needs no further
    shuffle and has a fixed bound on pairs. In larger ones each box goes to every cell it covers; a pair is
    kept only in the cell that holds the lower corner of the overlap, so no distinct is needed.
    """
    named = list(dict.fromkeys([*keep, *BOX]))
    tests, corners = [], []
    for axis in axes:
        tests += _box_tests(axis, pad)
        corners.append(F.floor(F.greatest(F.col(f"a_min_{axis}") - pad, F.col(f"b_min_{axis}")) / _CELL[axis]) == F.col(f"g{axis}"))

    def side(df, prefix, extra=()):
        return df.select("assembly_id", *extra, *[F.col(c).alias(f"{prefix}{c}") for c in named])

    few, many = (lambda df: df.filter(F.col("crowd") <= SMALL) if "crowd" in df.columns else df), F.col("crowd") > SMALL
    near = side(few(a), "a_").join(side(few(b), "b_"), "assembly_id").filter(opaque(all_of(tests)))

    def spread(df, grow):
        for axis in axes:
            low = F.floor((F.col(f"min_{axis}") - grow) / _CELL[axis])
            high = F.floor((F.col(f"max_{axis}") + grow) / _CELL[axis])
            df = df.withColumn(f"g{axis}", F.explode(F.sequence(low, high)))
        return df

    if "crowd" not in a.columns or a.filter(many).isEmpty():
        return near
    cells = [f"g{axis}" for axis in axes]
    left, right = side(spread(a.filter(many), pad), "a_", cells), side(spread(b.filter(many), 0.0), "b_", cells)
    far = left.join(right, ["assembly_id", *cells]).filter(opaque(all_of([*tests, *corners]))).drop(*cells)
    return near.unionByName(far)


def _quarter_turn(p: str) -> Column:
    """Rotation about Y by a multiple of 90 degrees."""
    zero = [F.col(f"{p}r{ij}") == 0.0 for ij in ("01", "10", "12", "21")]
    unit = (F.col(f"{p}r11") == 1.0) & (F.abs(f"{p}r00") == F.abs(f"{p}r22")) & (
        F.abs(f"{p}r02") == F.abs(f"{p}r20")
    )
    one = ((F.abs(f"{p}r00") == 1.0) & (F.col(f"{p}r02") == 0.0)) | (
        (F.col(f"{p}r00") == 0.0) & (F.abs(f"{p}r02") == 1.0)
    )
    return all_of([*zero, unit, one])


def _aligned_overlap() -> Column:
    tests = []
    for axis, slack in (("x", 0.2), ("y", 0.02), ("z", 0.2)):
        tests.append(F.col(f"a_min_{axis}") <= F.col(f"b_max_{axis}") - slack)
        tests.append(F.col(f"b_min_{axis}") <= F.col(f"a_max_{axis}") - slack)
    return all_of(tests)


def _turned_overlap() -> Column:
    """Separating-axis test over 15 axes as one compact array predicate."""

    def vec(p):
        return F.struct(*[v.alias(n) for v, n in zip(p, "xyz")])

    def dot(u, v):
        return u["x"] * v["x"] + u["y"] * v["y"] + u["z"] * v["z"]

    def cross(u, v):
        return vec([u["y"] * v["z"] - u["z"] * v["y"], u["z"] * v["x"] - u["x"] * v["z"],
                    u["x"] * v["y"] - u["y"] * v["x"]])

    def axes(p):
        return F.array(*[vec([F.col(f"{p}r{i}{j}") for i in range(3)]) for j in range(3)])

    def halves(p):
        return [F.col(f"{p}w") / 2 - 0.1, F.col(f"{p}h") / 2 - 0.01, F.col(f"{p}d") / 2 - 0.1]

    def reach(p, axis):
        half = halves(p)
        return sum(
            (half[k] * F.abs(sum((F.col(f"{p}r{i}{k}") * axis[n] for i, n in enumerate("xyz")), F.lit(0.0)))
             for k in range(3)),
            F.lit(0.0),
        )

    def gap(axis):
        return F.abs(sum(((F.col(f"b_c{n}") - F.col(f"a_c{n}")) * axis[n] for n in "xyz"), F.lit(0.0)))

    def face(p, other):
        # a face normal counts its own box with the plain half extent, without the axis length
        sides = F.arrays_zip(axes(p).alias("v"), F.array(*halves(p)).alias("own"))
        return F.forall(sides, lambda s: gap(s["v"]) <= s["own"] + reach(other, s["v"]))

    crossed = F.flatten(F.transform(axes("a_"), lambda u: F.transform(axes("b_"), lambda v: cross(u, v))))
    # both sides scale with the axis length, so the axis only has to be long enough
    edges = F.forall(
        crossed,
        lambda s: (dot(s, s) < 1e-10) | (gap(s) <= reach("a_", s) + reach("b_", s)),
    )
    return face("a_", "b_") & face("b_", "a_") & edges


def oriented_overlap() -> Column:
    """True when no axis separates the boxes; quarter turns take the plain comparison."""
    plain = _quarter_turn("a_") & _quarter_turn("b_")
    return F.when(plain, _aligned_overlap()).otherwise(_turned_overlap())


_OBB = ["owner", "copies", "w", "h", "d", "cx", "cy", "cz", *[f"r{i}{j}" for i in range(3) for j in range(3)]]


def collision_pairs(parts: DataFrame) -> DataFrame:
    """Overlapping placements; a placement with several copies also collides with itself."""
    body = bodies(parts)
    hits = box_pairs(body, body, _OBB).filter(F.col("a_owner") < F.col("b_owner"))
    apart = hits.filter(opaque(oriented_overlap())).select(
        "assembly_id",
        F.col("a_owner").alias("part_a"),
        F.col("b_owner").alias("part_b"),
        F.col("a_copies").alias("copies_a"),
        F.col("b_copies").alias("copies_b"),
    )
    stacked = body.filter("copies > 1").select(
        "assembly_id", F.col("owner").alias("part_a"), F.col("owner").alias("part_b"),
        F.col("copies").alias("copies_a"), F.col("copies").alias("copies_b"),
    )
    return apart.unionByName(stacked)


def axis_aligned_collisions(parts: DataFrame) -> DataFrame:
    """The quarter-turn special case: box overlap after the clearance is taken off."""
    body = bodies(parts)
    hits = box_pairs(body, body, ["owner", "copies"]).filter(F.col("a_owner") < F.col("b_owner"))
    return hits.filter(_aligned_overlap()).select(
        "assembly_id",
        F.col("a_owner").alias("part_a"),
        F.col("b_owner").alias("part_b"),
        F.col("a_copies").alias("copies_a"),
        F.col("b_copies").alias("copies_b"),
    )


def blocked_pairs(parts: DataFrame) -> DataFrame:
    """``part`` cannot be lifted before ``blocker``: footprints overlap and the blocker reaches higher.

    A placement with several copies blocks itself too.
    """
    body = bodies(parts)
    hits = box_pairs(body, body, ["owner", "copies"], axes="xz", pad=0.1)
    higher = F.col("b_min_y") < F.col("a_max_y") - 0.1
    # copies of one placement block one another, hence the self pair when there is more than one
    real = (F.col("a_owner") != F.col("b_owner")) | (F.col("a_copies") > 1)
    return hits.filter(higher & real).select(
        "assembly_id",
        F.col("a_owner").alias("part"),
        F.col("b_owner").alias("blocker"),
        F.col("a_copies").alias("part_copies"),
        F.col("b_copies").alias("blocker_copies"),
    )


# --- placement checks ----------------------------------------------------------------------------


def clear_placements(state: DataFrame, candidates: DataFrame) -> DataFrame:
    """Candidates (assembly_id, candidate_id, part_id, transform) that collide with no part of the state.

    For candidates known to hang on the state. Those of small states stay where they are and look at their state's parts
    until one is hit; those of large ones meet in grid cells.
    """
    held = placements(state)
    largest = group_sizes(state, ["assembly_id"])[0]
    named = list(dict.fromkeys([*_OBB[2:], *BOX]))
    loose = candidates
    if largest > SMALL:
        sizes = state.groupBy("assembly_id").agg(F.count(F.lit(1)).alias("crowd"))
        held = held.join(sizes.filter(F.col("crowd") <= SMALL).drop("crowd"), "assembly_id", "left_semi")
        large = sizes.filter(F.col("crowd") > SMALL)
        loose = candidates.join(large, "assembly_id", "left_anti")
    tried = solids(loose)
    side = lambda df, p, *keep: df.select(*keep, *[F.col(c).alias(f"{p}{c}") for c in named])
    tests = [t for axis in "xyz" for t in _box_tests(axis, 0.0)]
    body = side(solids(held), "a_", F.col("assembly_id").alias("_of")).hint("shuffle_hash")
    meets = (F.col("assembly_id") == F.col("_of")) & opaque(all_of(tests)) & opaque(oriented_overlap())
    clear = side(tried, "b_", *candidates.columns).join(body, meets, "left_anti").select(*candidates.columns)
    if largest <= SMALL:
        return clear
    rest = durable(candidates.join(large, "assembly_id"))
    fresh = durable(solids(rest.withColumnRenamed("candidate_id", "owner").withColumn("copies", F.lit(1))))
    near = box_pairs(bodies(state.join(large.drop("crowd"), "assembly_id", "left_semi")), fresh, _OBB)
    hit = near.filter(opaque(oriented_overlap())).select("assembly_id", F.col("b_owner").alias("candidate_id")).distinct()
    return clear.unionByName(rest.drop("crowd").join(hit, ["assembly_id", "candidate_id"], "left_anti"))


def placement_check(state: DataFrame, candidates: DataFrame) -> DataFrame:
    """Add ``valid`` to candidates (assembly_id, candidate_id, part_id, transform).

    Valid: collides with nothing, and the state is empty or a stud meets a socket within 5.
    """
    placed = bodies(state)
    sizes = state.groupBy("assembly_id").agg(F.count(F.lit(1)).alias("crowd"))
    fresh = durable(solids(
        candidates.select("assembly_id", F.col("candidate_id").alias("owner"), "part_id", "transform")
        .join(sizes, "assembly_id")
        .withColumn("copies", F.lit(1))
    ))
    keys = ["assembly_id", "candidate_id"]
    columns = list(dict.fromkeys([*_OBB, *SHAPE]))
    near = box_pairs(placed, fresh, columns, pad=PLACING)
    who = F.col("b_owner").alias("candidate_id")
    hit = near.filter(opaque(oriented_overlap())).select("assembly_id", who).distinct()
    owner = ["assembly_id", "b_owner"]
    held = (
        anchor_hits(near, "a_", "b_", PLACING, owner)
        .unionByName(anchor_hits(near, "b_", "a_", PLACING, owner))
        .select("assembly_id", who)
        .distinct()
    )
    used = sizes.select("assembly_id", F.lit(True).alias("_used"))
    marks = hit.withColumn("mark", F.lit("hit")).unionByName(held.withColumn("mark", F.lit("held")))
    marks = marks.groupBy(*keys).agg(
        F.bool_or(F.col("mark") == "hit").alias("_hit"), F.bool_or(F.col("mark") == "held").alias("_held")
    )
    valid = ~F.coalesce("_hit", F.lit(False)) & (F.coalesce("_held", F.lit(False)) | F.col("_used").isNull())
    return (
        candidates.join(marks, keys, "left")
        .join(used, "assembly_id", "left")
        .withColumn("valid", valid)
        .drop("_hit", "_held", "_used")
    )


def best_anchor(parts: DataFrame, stored: bool = True) -> DataFrame:
    """First matching anchor pair of every contact, in both directions: p and c are the parent and child
    placements. Parent studs against child sockets come first, then parent sockets against child studs.

    One pass finds the contacts and the anchors: what touches within CONTACT also meets within PLACING. ``stored``: solids are
    stored for it, else only those of large assemblies.
    """
    return _anchored(bodies(parts, stored))


def _anchored(body: DataFrame) -> DataFrame:
    close = box_pairs(body, body, ["owner", *SHAPE], pad=PLACING).filter(
        opaque((F.col("a_owner") != F.col("b_owner")) & _vertical_touch("a_", "b_"))
    )
    tight = all_of([t for axis in "xyz" for t in _box_tests(axis, CONTACT)])
    near = anchor_hits(close.withColumn("_tight", opaque(tight)), "a_", "b_", PLACING, ["assembly_id", "a_owner", "b_owner", "_tight"], "_gap")

    def first(i: str, j: str) -> Column:
        return F.min(F.shiftleft(F.col(i).cast("long"), 32) + F.col(j))

    # a number for (parent anchor, child anchor) keeps the least one a plain hash aggregate
    met = near.groupBy("assembly_id", "a_owner", "b_owner").agg(
        first("stud_idx", "socket_idx").alias("down"), first("socket_idx", "stud_idx").alias("up"),
        F.max(F.col("_tight") & (F.col("_gap") < CONTACT * CONTACT)).alias("touch"),
    )
    none = F.lit(None).cast("long")
    ways = F.array(
        F.struct(F.col("a_owner").alias("p"), F.col("b_owner").alias("c"), F.col("down"), none.alias("up")),
        F.struct(F.col("b_owner").alias("p"), F.col("a_owner").alias("c"), none.alias("down"), F.col("up")),
    )
    best = (
        met.select("assembly_id", "touch", F.explode(ways).alias("w")).select("assembly_id", "touch", "w.*")
        .groupBy("assembly_id", "p", "c").agg(F.min("down").alias("down"), F.min("up").alias("up"), F.max("touch").alias("touch"))
        .filter("touch")
    )
    at = F.coalesce("down", "up")
    parent, child = F.shiftright(at, 32).cast("string"), F.shiftright(F.shiftleft(at, 32), 32).cast("string")
    low = F.col("down").isNotNull()
    return best.select(
        "assembly_id", "p", "c",
        F.concat(F.when(low, "stud_").otherwise("socket_"), parent).alias("parent_anchor"),
        F.concat(F.when(low, "socket_").otherwise("stud_"), child).alias("child_anchor"),
    )


def parent_connections(parts: DataFrame) -> DataFrame:
    """Contacts with earlier parts, the first matching anchor pair and the relative matrix of each."""
    named, small = best_anchor(parts, stored=False), all_small(parts)
    # the pose of a part is that of its placement, so it comes along instead of being joined by part again
    members = placement_members(parts, pose=True)
    parent = members.select("assembly_id", "owner", F.col("part_index").alias("parent_index"), F.col("transform").alias("tp"))
    child = members.select("assembly_id", "owner", "part_index", F.col("transform").alias("tc"))
    return (
        join_by(join_by(named, child, {"c": "owner"}, small), parent, {"p": "owner"}, small)
        .filter("parent_index < part_index")
        .select("assembly_id", "part_index", "parent_index", "parent_anchor", "child_anchor",
                relative_matrix("tp", "tc").alias("relative_transform"))
    )


def ranked_members(parts: DataFrame) -> DataFrame:
    """assembly_id, owner, part_index, rank: the copies of every placement, numbered from 0 in list order."""
    return ordinal(placement_members(parts), ["assembly_id", "owner"], ["part_index"], "rank", fits(parts, ["assembly_id"]))


def _copy_runs(parts: DataFrame) -> DataFrame:
    """assembly_id, owner, first (part_index), n, before: copies that follow each other without another placement between them."""
    bounded = fits(parts, ["assembly_id"])
    members = scan(placement_members(parts), ["assembly_id"], ["part_index"], lags={"_prev": F.col("owner")}, bounded=bounded)
    starts = (~F.col("owner").eqNullSafe(F.col("_prev"))).cast("int")
    members = scan(members, ["assembly_id"], ["part_index"], sums={"_run": starts}, bounded=bounded)
    runs = members.groupBy("assembly_id", "owner", "_run").agg(F.min("part_index").alias("first"), F.count(F.lit(1)).alias("n"))
    runs = scan(runs, ["assembly_id", "owner"], ["first"], sums={"_end": F.col("n")}, bounded=bounded)
    return runs.select("assembly_id", "owner", "first", "n", (F.col("_end") - F.col("n")).alias("before"))


def connection_ranges(parts: DataFrame) -> DataFrame:
    """Contacts with earlier parts as ranges of copies, which say the same as ``parent_connections`` in far fewer rows.

    p and c are parent and child placements; the copies of c with ranks ``child_from`` to ``child_to`` (see ``ranked_members``)
    have the first ``n_parents`` copies of p before them. Runs of copies of two placements never overlap in the list, so one
    ordered scan per linked pair over their runs counts the parents of every run, and piles of copies cost a row each.
    """
    body, small = bodies(parts), all_small(parts)
    links = durable(_anchored(body))
    runs = _copy_runs(parts) if small else durable(_copy_runs(parts))
    key = ["assembly_id", "p", "c"]
    zero = F.lit(0).cast("long")
    giving = join_by(links.select(*key), runs, {"p": "owner"}, small).select(
        *key, "first", F.col("n").alias("_given"), zero.alias("n"), zero.alias("before")
    )
    taking = join_by(links.select(*key), runs, {"c": "owner"}, small).select(*key, "first", zero.alias("_given"), "n", "before")
    counted = scan(giving.unionByName(taking), key, ["first"], sums={"n_parents": F.col("_given")}, bounded=small)
    ranges = counted.filter("n > 0 AND n_parents > 0").groupBy(*key, "n_parents").agg(
        F.min("before").alias("child_from"), F.max(F.col("before") + F.col("n") - 1).alias("child_to")
    )
    pose = body.select("assembly_id", "owner", "transform")
    named = join_by(links, pose.withColumnRenamed("transform", "tp"), {"p": "owner"}, small)
    named = join_by(named, pose.withColumnRenamed("transform", "tc"), {"c": "owner"}, small)
    return (
        named.select(*key, "parent_anchor", "child_anchor", relative_matrix("tp", "tc").alias("relative_transform"))
        .join(ranges, key)
        .select(*key, "child_from", "child_to", "n_parents", "parent_anchor", "child_anchor", "relative_transform")
    )


def child_connections(parts: DataFrame, ranges: DataFrame) -> DataFrame:
    """assembly_id, part_index, p, n_parents, anchors and matrix: one row per part and parent placement, parents still counted."""
    listed = ranges.withColumn("rank", F.explode(F.sequence(F.col("child_from").cast("int"), F.col("child_to").cast("int"))))
    return join_by(listed, ranked_members(parts), {"c": "owner", "rank": "rank"}, all_small(parts)).select(
        "assembly_id", "part_index", "p", "n_parents", "parent_anchor", "child_anchor", "relative_transform"
    )
