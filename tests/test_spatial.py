import hashlib
import itertools
import re

import numpy as np
import pytest
from pyspark.sql import functions as F
from helpers import DIMS, anchors, at, meets, overlap, parts_df, pose, touch

from brickloom.operators import construct, graph, manual, metrics, mirror, spatial
from brickloom.session import durable


def turn(rng):
    q, _ = np.linalg.qr(rng.normal(size=(3, 3)))
    return q


def random_assemblies(seed, count, size, rotated=True):
    rng = np.random.default_rng(seed)
    ids = [p[:-4] for p in list(DIMS)[:32]]
    out = {}
    for a in range(count):
        parts = []
        for _ in range(size):
            rot = turn(rng) if rotated and rng.random() < 0.5 else None
            x, y, z = rng.integers(-3, 4) * 10, -rng.integers(0, 5) * 8, rng.integers(-3, 4) * 10
            parts.append(at(rng.choice(ids), float(x), float(y), float(z), rot=rot))
        out[f"a{a}"] = parts
    return out


def pairs_of(df):
    return {(r.assembly_id, r.part_a, r.part_b) for r in df.collect()}


@pytest.mark.parametrize("count,size", [(6, 8), (1, 60)])
def test_contacts_and_collisions_match_brute_force(spark, count, size):
    """60 parts take the cell join, 8 the plain one."""
    data = random_assemblies(size, count, size)
    df = parts_df(spark, data)
    every = [(k, i, j) for k, ps in data.items() for i in range(len(ps)) for j in range(i + 1, len(ps))]
    assert pairs_of(spatial.contact_pairs(df)) == {t for t in every if touch(data[t[0]][t[1]], data[t[0]][t[2]])}
    assert pairs_of(spatial.collision_pairs(df)) == {t for t in every if overlap(data[t[0]][t[1]], data[t[0]][t[2]])}


def test_anchor_pairs_come_from_one_join_without_lambdas(spark):
    """Contacts and anchors were two pair joins each, with a lambda for every listed stud."""
    data = random_assemblies(5, 4, 9)
    best = spatial.best_anchor(parts_df(spark, data))
    plan = best._jdf.queryExecution().executedPlan().toString()
    assert len(re.findall(r"\w+Join\b", plan)) == 1 and "lambda" not in plan

    def first(one, other):
        near = np.argwhere(np.linalg.norm(one[:, None] - other[None], axis=2) < 5.0)
        return tuple(near[0]) if len(near) else None

    want = set()
    for key, parts in data.items():
        for i, j in itertools.permutations(range(len(parts)), 2):
            if not touch(parts[i], parts[j]):
                continue
            (si, ki), (sj, kj) = anchors(parts[i][0], parts[i][3]), anchors(parts[j][0], parts[j][3])
            down, up = first(si, kj), first(ki, sj)
            names = (f"stud_{down[0]}", f"socket_{down[1]}") if down else (f"socket_{up[0]}", f"stud_{up[1]}")
            want.add((key, i, j, *names))
    assert want and {tuple(r) for r in best.collect()} == want


def test_distorted_pose_tries_every_socket(spark):
    squeezed = np.diag([0.2, 1.0, 1.0])
    data = {"a": [at("3001", 0, 0, 0, rot=squeezed), at("3001", 0, -24, 0), at("3001", 7, -24, 0)]}
    want = {("a", i, j) for i in range(3) for j in range(i + 1, 3) if touch(data["a"][i], data["a"][j])}
    assert pairs_of(spatial.contact_pairs(parts_df(spark, data))) == want


def test_golden_cases(spark):
    data = {
        "stack": [at("3005", 0, 0, 0), at("3005", 0, -24, 0)],
        "overlap": [at("3003", 0, 0, 0), at("3003", 10, 0, 10)],
        "floating": [at("3005", 0, 0, 0), at("3005", 100, -100, 100)],
        "bridge": [at("3001", 0, 0, 0), at("3001", 0, 0, 40), at("3001", 0, -24, 20)],
        "sunk": [at("3005", 0, 5, 0)],
    }
    df = parts_df(spark, data)
    hit = {r[0] for r in spatial.collision_pairs(df).select("assembly_id").distinct().collect()}
    assert "overlap" in hit and not hit & {"stack", "floating", "sunk"}
    stable = {r.assembly_id: r.stable for r in graph.gravity_check(df).collect()}
    assert stable["stack"] and stable["bridge"] and not stable["floating"] and not stable["sunk"]
    lock = {r.assembly_id: r.interlock for r in metrics.interlock_score(df).collect()}
    assert lock["bridge"] >= 1 and lock["stack"] == 0
    reward = {r.assembly_id: r.reward for r in metrics.stability_reward(df).collect()}
    assert reward["bridge"] >= 15 and reward["floating"] == -5


def test_placement_tolerance(spark):
    state = parts_df(spark, {"s": [at("3001", 0, 0, 0)]})
    tries = parts_df(spark, {"s": [at("3001", x, -24, 0) for x in (0, 3, 6)], "empty": [at("3001", 9, 9, 9)]})
    out = spatial.placement_check(state, tries.withColumnRenamed("part_index", "candidate_id"))
    got = {(r.assembly_id, r.candidate_id): r.valid for r in out.collect()}
    assert got == {("s", 0): True, ("s", 1): True, ("s", 2): False, ("empty", 0): True}


def test_components_rounds_equal_batches(spark):
    rng = np.random.default_rng(3)
    edges = [("k%d" % (i % 3), int(a), int(b)) for i in range(150) for a, b in [sorted(rng.choice(80, 2, replace=False))]]
    df = spark.createDataFrame(edges, "assembly_id string, part_a int, part_b int")
    batch = {tuple(r) for r in graph._label_batches(df).collect()}
    rounds = {tuple(r) for r in graph._label_rounds(df).collect()}
    assert batch == rounds and len(batch) > 100


def test_copies_without_contact_stay_apart(spark):
    df = parts_df(spark, {"a": [at("3005", 0, 0, 0), at("3005", 0, 0, 0), at("3001", 500, 0, 0)]})
    assert [r.parts_count for r in graph.subassemblies(df).collect()] == [1, 1, 1]


def test_vehicle_golden(spark):
    car = [at("42610", x, 0, z) for x in (-20, 20) for z in (-40, 40)] + [at("3020", 0, -16, 0), ("3829.dat", 4, 0, at("3005", 0, -24, 0)[3])]
    row = metrics.vehicle_metrics(parts_df(spark, {"car": car})).first()
    assert row.wheel_count == 4 and row.symmetry_score >= 0.8 and row.cabin_height_valid and row.cabin_centered


def mirror_walk(parts):
    """Part by part in list order: the first partner not taken yet."""
    used, found = set(), {}
    for i, p in enumerate(parts):
        a = p[3][:3, 3]
        if abs(a[0]) < 6:
            continue
        for j, q in enumerate(parts):
            b = q[3][:3, 3]
            if i != j and j not in used and p[0] == q[0] and abs(a[0] + b[0]) < 8 and abs(a[1] - b[1]) < 5 and abs(a[2] - b[2]) < 5:
                used.add(j)
                found[i] = j
                break
    return found


def test_mirror_partners_equal_the_walk(spark):
    rng = np.random.default_rng(9)
    data = {}
    for k in range(6):
        n, wide, spots = 60, int(rng.integers(1, 8)), int(rng.integers(2, 9))
        places = [(float(rng.choice([-1, 1]) * rng.integers(4, 16)), float(rng.integers(0, wide)), float(rng.integers(0, wide))) for _ in range(spots)]
        data[f"m{k}"] = [at(str(rng.choice(["3005", "3004"])), *places[int(rng.integers(spots))]) for _ in range(n)]
    df = parts_df(spark, data)
    got = {(r.assembly_id, r.part_index): r.partner_index for r in mirror.mirror_partners(df).collect()}
    want = {(k, i): j for k, parts in data.items() for i, j in mirror_walk(parts).items()}
    assert got == want and len(want) > 80
    score = {r.assembly_id: r.symmetry_score for r in metrics.symmetry_score(df).collect()}
    for k, parts in data.items():
        central = sum(abs(p[3][0, 3]) < 6 for p in parts)
        assert score[k] == pytest.approx((len(mirror_walk(parts)) + central) / len(parts))


def test_mirror_runs_do_not_depend_on_copies(spark):
    """Ten thousand copies a place, in a chain of places that each face two: a handful of intervals."""
    spots = [(-20.0, 0.0), (20.0, 4.0), (-20.0, 8.0), (20.0, 12.0), (-20.0, 16.0)]
    rows = spark.range(50_000).selectExpr("'c' AS assembly_id", "CAST(id AS INT) AS part_index", "'3005.dat' AS part_id", "CAST(id DIV 10000 AS INT) AS spot")
    poses = spark.createDataFrame([(i, [float(v) for v in pose(x, y, 0.0).flatten()]) for i, (x, y) in enumerate(spots)], "spot int, transform array<double>")
    df = rows.join(poses, "spot").drop("spot")
    met, _, _ = mirror._intervals(df, mirror._split(df)[1])
    assert met.count() <= 10
    got = mirror.mirror_partners(df)
    small = [at("3005", x, y, 0) for x, y in spots for _ in range(3)]
    want = {(i // 3, j // 3) for i, j in mirror_walk(small).items()}
    assert {(r.a, r.b) for r in got.selectExpr("part_index DIV 10000 AS a", "partner_index DIV 10000 AS b").distinct().collect()} == want
    assert got.count() == got.select("partner_index").distinct().count() == 10_000 * len(want)


def test_disassembly_rounds_equal_peel(spark):
    data = random_assemblies(5, 4, 9, rotated=False)
    rng = np.random.default_rng(11)
    for k in range(6):  # crowded: copies, cycles of blocking parts and free cascades after forced removals
        spots = [(str(rng.choice(["3001", "3005", "3022"])), *(float(v) for v in rng.integers(-2, 3, 3) * [20, 8, 20])) for _ in range(9)]
        data[f"c{k}"] = [at(*spots[int(rng.integers(9))]) for _ in range(14)]
    df = parts_df(spark, data)
    fast = {tuple(r) for r in construct.disassembly_order(df).collect()}
    slow = {tuple(r) for r in construct.disassembly_order(df, small=0).collect()}
    assert fast == slow and len(fast) == 36 + 6 * 14


def test_mutually_blocking_parts_take_few_rounds(spark, monkeypatch):
    """5,000 copies that all hold one another, and 40 parts that overlap: forced one by one, but not in a round each."""
    rounds = []
    monkeypatch.setattr(construct, "durable", lambda df: rounds.append(1) or durable(df))
    copies = spark.range(5000).selectExpr("'c' AS assembly_id", "CAST(id AS INT) AS part_index", "'3001.dat' AS part_id").withColumn(
        "transform", F.array(*[F.lit(float(v)) for v in pose().flatten()])
    )
    crowd = parts_df(spark, {"d": [at("3001", 0, float(k), 0) for k in range(40)]}).select(copies.columns)
    got = construct.disassembly_order(copies.unionByName(crowd), small=0).collect()
    assert sorted((r.remove_no, r.part_index) for r in got if r.assembly_id == "c") == [(i, i) for i in range(5000)]
    assert sorted((r.remove_no, r.part_index) for r in got if r.assembly_id == "d") == [(i, i) for i in range(40)]
    assert len(rounds) < 20


def test_parent_connections_golden(spark):
    df = parts_df(spark, {"h": [at("42610", -10, 0, 10), at("42610", 10, 0, 10), at("3020", 0, -16, 0)]})
    rows = spatial.parent_connections(df).filter("part_index = 2").collect()
    assert len(rows) == 2 and all(len(r.relative_transform) == 16 for r in rows)


@pytest.mark.parametrize("limited", [False, True])
def test_ranges_of_copies_say_the_same_as_all_pairs(spark, limited, request):
    r = np.random.default_rng(5)
    spots = [(0, 0, 0), (0, -24, 0), (0, -48, 0), (20, -24, 0), (500, 0, 0)]
    df = parts_df(spark, {a: [at("3005", *spots[k]) for k in r.integers(0, len(spots), 40)] for a in ("i", "j")})
    want = sorted((x.assembly_id, x.part_index, x.parent_index, x.parent_anchor, x.child_anchor, tuple(x.relative_transform)) for x in spatial.parent_connections(df).collect())
    if limited:
        request.getfixturevalue("tiny_groups")
    ranges = spatial.connection_ranges(df).cache()
    members = {}
    for x in spatial.ranked_members(df).collect():
        members.setdefault((x.assembly_id, x.owner), {})[x.rank] = x.part_index
    got = [
        (x.assembly_id, members[x.assembly_id, x.c][k], members[x.assembly_id, x.p][j], x.parent_anchor, x.child_anchor, tuple(x.relative_transform))
        for x in ranges.collect() for k in range(x.child_from, x.child_to + 1) for j in range(x.n_parents)
    ]
    assert want and sorted(got) == want
    assert spatial.child_connections(df, ranges).selectExpr("sum(n_parents) AS n").first().n == len(want)


def test_piles_of_copies_stay_small(spark):
    rows = spark.range(20_000).select(
        F.lit("p").alias("assembly_id"), F.col("id").cast("int").alias("part_index"), F.lit("3005.dat").alias("part_id"), F.lit(4).alias("color"), F.lit(0).alias("step_id"),
        F.when(F.col("id") < 10_000, F.array(*[F.lit(float(v)) for v in pose(0, 0, 0).flatten()]))
        .otherwise(F.array(*[F.lit(float(v)) for v in pose(0, -24, 0).flatten()])).alias("transform"),
    )
    assert [(x.p, x.c, x.child_from, x.child_to, x.n_parents) for x in spatial.connection_ranges(rows).collect()] == [(0, 10_000, 0, 9_999, 10_000)]


def test_expand_pairs_lists_copies(spark):
    df = parts_df(spark, {"e": [at("3005", 0, 0, 0), at("3005", 0, 0, 0), at("3005", 0, -24, 0)]})
    got = {tuple(r) for r in spatial.expand_pairs(spatial.contact_pairs(df), df).collect()}
    assert got == {("e", 0, 2), ("e", 1, 2)}


def beam_walk(start, part_logp, color_logp, width, steps, target):
    """The search state by state; a part is (id, color, step, pose)."""
    def signed(p):
        pose_ = [float(np.round(v * 100) / 100 + 0.0) for v in p[3].flatten()]
        return f"{p[0]} {p[1]} " + " ".join(str(v) for v in pose_)

    digest = lambda t: hashlib.sha256(t.encode()).hexdigest()
    beams = [([start], 0.0, digest(signed(start)))]
    for step in range(1, steps + 1):
        found = {}
        for parts, score, sig in beams:
            for pid, pl in part_logp.items():
                poses = set()
                for host in parts:
                    ends, own = anchors(host[0], host[3]), anchors(pid, np.eye(4))
                    for p, c, yaw in itertools.product([0, 1], [0, 1], range(4)):
                        co, si = [(1, 0), (0, 1), (-1, 0), (0, -1)][yaw]
                        rot = np.array([[co, 0, si], [0, 1, 0], [-si, 0, co]], float)
                        for a, b in ((ends[0], own[1]), (ends[1], own[0])):
                            if p < len(a) and c < len(b):
                                poses.add(tuple(np.round(pose(*(a[p] - rot @ b[c]), rot), 9).flatten() + 0.0))
                for at_ in poses:
                    new = (pid, None, step, np.array(at_).reshape(4, 4))
                    if any(overlap(q, new) for q in parts):
                        continue
                    have, want = sum(q[0] == pid for q in parts), target.get(pid, 0)
                    bias = 0.0 if not target else (2.0 if have < want else -10.0) if want else -20.0
                    for color, cl in color_logp.items():
                        part = (pid, color, step, new[3])
                        total = score + pl + cl + bias
                        key = f"{sig}|{signed(part)}"
                        found[key] = max(found.get(key, (-1e9, None)), (total, [*parts, part]), key=lambda v: v[0])
        if not found:
            break
        best = sorted(found.items(), key=lambda kv: (-kv[1][0], kv[0]))[:width]
        beams = [(parts, total, digest(key)) for key, (total, parts) in best]
    return beams


def test_beam_search_equals_the_walk(spark):
    begin = {"g": at("3001", 0, 0, 0), "h": at("3005", 0, 0, 0, color=2)}
    logp = {"g": {"3004.dat": -0.5, "3005.dat": -0.25, "3001.dat": -0.75}, "h": {"3005.dat": -0.125, "3022.dat": -1.0}}
    colors, target = {4: -0.5, 7: -0.25}, {"h": {"3005.dat": 2}}
    starts = spark.createDataFrame([(g, p[0], p[1], [float(v) for v in p[3].flatten()]) for g, p in begin.items()], "group_id string, part_id string, color int, transform array<double>")
    ps = spark.createDataFrame([(g, p, v) for g, d in logp.items() for p, v in d.items()], "group_id string, part_id string, logp double")
    cs = spark.createDataFrame([(g, c, v) for g in begin for c, v in colors.items()], "group_id string, color int, logp double")
    inv = spark.createDataFrame([(g, p, n) for g, d in target.items() for p, n in d.items()], "group_id string, part_id string, target int")
    got = construct.beam_search(starts, ps, cs, 3, 3, inv).collect()
    for g in begin:
        want = beam_walk(begin[g], logp[g], colors, 3, 3, target.get(g, {}))
        for rank, (parts, score, _) in enumerate(want, 1):
            own = sorted((r for r in got if r.group_id == g and r.rank == rank), key=lambda r: r.step_id)
            assert [(r.part_id, r.color) for r in own] == [p[:2] for p in parts]
            assert np.allclose([r.transform for r in own], [p[3].flatten() for p in parts])
            assert own[0].score == pytest.approx(score)
        assert {r.rank for r in got if r.group_id == g} == set(range(1, len(want) + 1))


def test_beam_keeps_inventory_and_validity(spark):
    state = parts_df(spark, {"s": [at("3001", 0, 0, 0)]})
    states = spark.createDataFrame([("g", "s", "start", 0.0)], "group_id string, state_id string, signature string, score double")
    ps = spark.createDataFrame([("s", "3004.dat", -1.0), ("s", "3001.dat", -0.5)], "state_id string, part_id string, logp double")
    cs = spark.createDataFrame([("s", 4, -0.1)], "state_id string, color int, logp double")
    inv = spark.createDataFrame([("g", "3001.dat", 1), ("g", "3004.dat", 1)], "group_id string, part_id string, target int")
    best = construct.beam_step(states, state, ps, cs, 3, inv).collect()
    assert len(best) == 3 and {r.part_id for r in best} == {"3004.dat"}
    for r in best:
        m = np.array(r.transform).reshape(4, 4)
        new, base = ("3004.dat", 4, 1, m), at("3001", 0, 0, 0)
        assert not overlap(base, new) and meets(base, new, 5.0)


def test_beam_step_moves_no_poses(spark, monkeypatch):
    """poses are made, checked and cut where their assembly lies; none is stored on the way."""
    parts = {f"s{i}": [at("3001", 0, 0, 0), at("3004", 20.0 * i, -24.0, 0)] for i in range(3)}
    state = parts_df(spark, parts)
    wanted = spark.createDataFrame([(s, p) for s in parts for p in ("3004.dat", "3001.dat", None)], "assembly_id string, part_id string")

    def stored(df):
        raise AssertionError("poses are stored")

    monkeypatch.setattr(construct, "durable", stored)
    monkeypatch.setattr(spatial, "durable", stored)
    tried = construct.candidate_placements(state, wanted)
    valid = {(r.assembly_id, r.part_id, tuple(r.transform)) for r in construct.valid_placements(state, tried).collect()}
    all_of_them = {(r.assembly_id, r.part_id, tuple(r.transform)) for r in tried.collect()}
    clear = {t for t in all_of_them if not any(overlap(p, (t[1], 0, 0, np.array(t[2]).reshape(4, 4))) for p in parts[t[0]])}
    assert valid == clear and 0 < len(valid) < len(all_of_them)


def test_large_states_are_checked_like_small_ones(spark):
    parts = random_assemblies(5, 1, 60) | {"small": random_assemblies(6, 1, 4)["a0"]}
    state = parts_df(spark, parts)
    wanted = spark.createDataFrame([(s, "3004.dat") for s in parts], "assembly_id string, part_id string")
    tried = construct.candidate_placements(state, wanted)
    valid = {(r.assembly_id, tuple(r.transform)) for r in construct.valid_placements(state, tried).collect()}
    rows = [(r.assembly_id, tuple(r.transform)) for r in tried.collect()]
    assert len(set(rows)) == len(rows)
    assert valid == {t for t in rows if not any(overlap(p, ("3004.dat", 0, 0, np.array(t[1]).reshape(4, 4))) for p in parts[t[0]])}


@pytest.mark.parametrize("crowded", [False, True])
def test_box_containment_lists_cells_of_crowded_pages_only(spark, crowded):
    """boxes of pages with few quantities meet them on the page, without a row per grid cell."""
    rng = np.random.default_rng(7)
    sizes = {1: 3, 2: 5, 3: 100 if crowded else 4}
    boxes = [(p, i, *map(float, rng.integers(0, 300, 2)), *map(float, rng.integers(300, 700, 2)), 0.4, 0.4) for p in sizes for i in range(6)]
    points = [(p, *map(float, rng.integers(0, 800, 2))) for p, n in sizes.items() for _ in range(n)]
    drawings = spark.createDataFrame(boxes, "page_id int, box_id int, x0 double, y0 double, x1 double, y1 double, fill_r double, fill_g double")
    quantities = spark.createDataFrame(points, "page_id int, qx double, qy double")
    pages = spark.createDataFrame([(p, 600.0, 800.0) for p in sizes], "page_id int, width double, height double")
    got = manual.box_containment(drawings, quantities, pages)
    assert ("Generate" in got._jdf.queryExecution().optimizedPlan().toString()) == crowded
    want = {
        (p, i) for p, i, x0, y0, x1, y1, *_ in boxes if 20 < x1 - x0 < 420 and 20 < y1 - y0 < 560
        and any(q == p and x0 - 5 <= x <= x1 + 5 and y0 - 5 <= y <= y1 + 5 for q, x, y in points)
    }
    assert sorted((r.page_id, r.box_id) for r in got.collect()) == sorted(want) and want
