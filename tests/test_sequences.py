import numpy as np
from helpers import DIMS, anchors, at, parts_df, pose
from pyspark.sql import functions as F

from brickloom.functions.numbers import fixed_text
from brickloom.functions import text as t
from brickloom.operators import construct, scans, sequencing
from brickloom.sinks import ldraw as out
from brickloom.sources import ldraw as src
from brickloom.streaming import events as e


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_scan_ranges_equal_plain(spark, tiny_groups):
    rng = np.random.default_rng(1)
    data = [("k%d" % rng.integers(3), i, float(rng.integers(9)), None if rng.random() < 0.5 else int(rng.integers(99))) for i in range(300)]
    df = spark.createDataFrame(data, "k string, i int, v double, w int")
    args = dict(rank="r", sums={"s": F.col("v")}, lags={"g": F.col("v"), "n": F.col("w")}, lasts={"l": F.col("w")})
    hot = scans.scan(df, ["k"], ["v", "i"], **args)
    plain = scans.scan(df, ["k"], ["v", "i"], bounded=True, **args)
    key = lambda r: (r[0], r[1])
    assert sorted(map(tuple, hot.collect()), key=key) == sorted(map(tuple, plain.collect()), key=key)


def walk_steps(ys):
    step, held, prev, got = 0, 0, None, []
    for y in ys:
        if (prev is not None and abs(y - prev) > 8) or held >= 5:
            step, held = step + 1, 0
        prev, held = y, held + 1
        got.append(step)
    return got


def test_std_steps_equal_walk_even_for_large_groups(spark, tiny_groups):
    rng = np.random.default_rng(2)
    ys = [float(-8 * rng.integers(0, 4)) for _ in range(60)]
    df = parts_df(spark, {"a": [at("3005", 0, y, 0) for y in ys]})
    got = [r.std_step for r in sequencing.std_steps(df, "part_index").orderBy("part_index").collect()]
    assert got == walk_steps(ys)


def linked(pid_a, pos_a, pid_b, pos_b):
    (sa, ka), (sb, kb) = anchors(pid_a, pose(*pos_a)), anchors(pid_b, pose(*pos_b))
    return (np.linalg.norm(sa[:, None] - kb[None], axis=2) < 1).any() or (np.linalg.norm(sb[:, None] - ka[None], axis=2) < 1).any()


DX = [0, -10, 10, -20, 20, -30, 30]
DZ = DX + [-40, 40]
DY = [0, -8, 8, -16, 16, -24, 24]


def walk_stack(ids):
    px, pz, y, got = 10.0, 10.0, 0.0, []
    for k, pid in enumerate(ids):
        if k:
            hit = next(((dx, dz) for dx in DX for dz in DZ if linked(ids[k - 1], got[-1], pid, (px + dx, y, pz + dz))), (0, 0))
            px, pz = px + hit[0], pz + hit[1]
        got.append((px, y, pz))
        y -= DIMS[pid][1]
    return got


def walk_search(ids):
    x, y, z, got = 10.0, 0.0, 10.0, []
    for k, pid in enumerate(ids):
        for j in range(k - 1, -1, -1):
            bx, by, bz = got[j]
            spots = ((bx + dx, by + dy, bz + dz) for dy in DY for dx in DX for dz in DZ)
            hit = next((s for s in spots if linked(ids[j], got[j], pid, s)), None)
            if hit:
                x, y, z = hit
                break
        got.append((x, y, z))
        y -= DIMS[pid][1]
    return got


def test_snapping_equals_the_walks(spark):
    rng = np.random.default_rng(4)
    names = ["3005", "3004", "3001", "3024", "3023", "4274", "28697", "42610", "3002"]
    data = {f"a{i}": [f"{rng.choice(names)}.dat" for _ in range(9)] for i in range(6)}
    df = parts_df(spark, {k: [(p, 4, 0, pose()) for p in v] for k, v in data.items()})
    for fn, walk in ((construct.snap_stack, walk_stack), (construct.snap_search, walk_search)):
        got = {(r.assembly_id, r.part_index): (r.x, r.y, r.z) for r in fn(df).collect()}
        want = {(k, i): p for k, ids in data.items() for i, p in enumerate(walk(ids))}
        assert got == want


def greedy_layer(cells, odd, nx, nz):
    used, bricks = set(), []

    def take(kind, xs, zs, w, d):
        for x in xs:
            for z in zs:
                block = [(x + i, z + j) for i in range(w) for j in range(d)]
                if all(c in cells and c not in used for c in block):
                    used.update(block)
                    bricks.append((kind, x, z))

    take(0, range(odd, nx - 1, 2), range(odd, nz - 3, 4), 2, 4)
    take(1, range(odd, nx - 3, 4), range(odd, nz - 1, 2), 4, 2)
    take(2, range(nx), range(nz - 1), 1, 2)
    take(3, range(nx - 1), range(nz), 2, 1)
    take(4, range(nx), range(nz), 1, 1)
    return bricks


def test_voxel_pack_equals_greedy_scan(spark):
    rng = np.random.default_rng(7)
    data, want = [], set()
    for model in range(6):
        for layer in range(3):
            cells = {(x, z) for x in range(11) for z in range(13) if rng.random() < 0.8}
            data += [(model, x, layer, z) for x, z in cells]
            want |= {(model, kind, x, layer, z) for kind, x, z in greedy_layer(cells, layer % 2, 11, 13)}
    df = spark.createDataFrame(data, "model_id int, x int, y int, z int")
    got = {(r.model_id, r.phase, r.gx, r.layer, r.gz) for r in construct.voxel_pack(df).collect()}
    assert got == want


def test_cadence_pieces_equal_walk(spark, tiny_groups):
    rng = np.random.default_rng(11)
    acts = ["success" if rng.random() < 0.8 else "failure" for _ in range(120)]
    df = spark.createDataFrame([("c", i, i, a) for i, a in enumerate(acts)], "crawler string, ts long, seq long, action string")
    delay, streak, want = 3.0, 0, []
    for a in acts:
        if a == "failure":
            delay, streak = min(60.0, delay * 2), 0
        else:
            streak += 1
            if streak >= 3:
                delay, streak = max(1.0, delay - 1.0), 0
        want.append((delay, streak))
    got = [(r.delay, r.streak) for r in e.cadence_state(df).orderBy("seq").collect()]
    assert got == want


def test_fixed_text_rounds_like_printf(spark):
    rng = np.random.default_rng(13)
    values = [0.125, 0.375, 0.015, 0.005, -0.005, -0.001, -0.125, 2.675, 1.005, 0.0, -0.0, *(rng.normal(size=200) * 10).tolist()]
    df = spark.createDataFrame([(i, float(v)) for i, v in enumerate(values)], "i int, v double")
    for digits in (2, 3, 6):
        got = [r.s for r in df.select("i", fixed_text(F.col("v"), digits).alias("s")).orderBy("i").collect()]
        assert got == [f"{v:.{digits}f}" for v in values]


TEXT = "0 comment\n1 14 0 0 0 1 0 0 0 1 0 0 0 1 3005.dat\n0 STEP\n1 14 0 -24 0 1 0 0 0 1 0 0 0 1 3005.DAT\n1 15 20 -24 0 1 0 0 0 1 0 0 0 1 3024.dat\n0 STEP PAGE 9\n1 4 0 -32 0 1 0 0 0 1 0 0 0 1 3003.dat\n"


def test_flat_file(spark):
    lines = src.text_lines(spark.createDataFrame([("m", TEXT)], "assembly_id string, text string"))
    got = [(r.part_id, r.color, r.step_id, r.page_num) for r in src.ldraw_parts(lines).orderBy("part_index").collect()]
    assert got == [("3005.dat", 14, 0, 0), ("3005.dat", 14, 1, 1), ("3024.dat", 15, 1, 1), ("3003.dat", 4, 2, 9)]


def test_multi_part_file(spark):
    text = ("0 FILE main.ldr\n1 16 10 20 30 1 0 0 0 1 0 0 0 1 sub.ldr\n0 STEP\n1 14 0 -24 0 1 0 0 0 1 0 0 0 1 3005.dat\n"
            "0 FILE sub.ldr\n1 15 0 0 0 1 0 0 0 1 0 0 0 1 3001.dat\n1 16 0 0 0 1 0 0 0 1 0 0 0 1 main.ldr\n")
    lines = src.text_lines(spark.createDataFrame([("m", text)], "assembly_id string, text string"))
    got = [(r.part_id, r.color, r.step_id, r.transform[3], r.transform[7], r.transform[11]) for r in src.mpd_flatten(lines).orderBy("part_index").collect()]
    assert got == [("3001.dat", 15, 0, 10.0, 20.0, 30.0), ("3005.dat", 14, 1, 0.0, -24.0, 0.0)]


def test_skipped_steps_give_one_marker_each(spark):
    df = parts_df(spark, {"w": [at("3005", 0, 0, 0, step=0), at("3005", 0, -24, 0, step=3)]})
    lines = [r.line for r in out.to_ldraw(df).orderBy("ord", "sub").collect()]
    assert lines.count("0 STEP") == 3 and lines[1] == "1 4 0.0 0.0 0.0 1.0 0.0 0.0 0.0 1.0 0.0 0.0 0.0 1.0 3005.dat"


def test_token_ids(spark):
    text = "0 note\n  1 14 10.4 24 30.5 1 0 0 0 1 0 0 0 1 3005.dat\n0 step"
    row = spark.createDataFrame([(text,)], "text string").select(t.ldraw_normalize(F.col("text")).alias("n"), t.ldraw_encode(F.col("text")).alias("e")).first()
    assert row.n == "1 14 10 24 30 1.00 0.00 0.00 0.00 1.00 0.00 0.00 0.00 1.00 3005.dat\n0 STEP"
    words = t.token_vocabulary()
    last = {w: i for i, w in enumerate(words)}
    want = [2]
    for line in row.n.split("\n"):
        want += [last.get(w, 1) for w in line.split()] + [1]
    assert row.e == want + [3]


def plan_of(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_counting_lines_of_assemblies_writes_no_text(spark):
    parts = parts_df(spark, {"w": [at("3005", 0, 0, 0, step=0), at("3005", 0, -24, 0, step=3)]})
    marked = parts.withColumns({"ord": F.col("part_index"), "new_step": F.col("part_index") == 1})
    for lines, n in ((out.to_ldraw(parts), 6), (out.to_ldraw_paged(parts, ["0 X"]), 4), (out.to_ldraw_marked(marked, "0 X"), 4)):
        sizes = lines.groupBy("assembly_id").count()
        assert "concat_ws" not in plan_of(sizes) and [r["count"] for r in sizes.collect()] == [n]
        # header and parts both list the assemblies, but only one of them writes texts
        assert plan_of(lines).count("concat_ws") == 1


def test_fixed_text_beyond_whole_units(spark):
    values = [999999.9995, -999999.9996, 1e15, -123456789012345680.0, 12345678.0, 0.0004, -0.0004, float("nan")]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v double")
    got = [r.s for r in df.select("i", fixed_text(F.col("v"), 3).alias("s")).orderBy("i").collect()]
    assert got == [f"{v:.3f}" for v in values[:-1]] + ["NaN"]


def test_lines_are_split_once(spark):
    lines = src.text_lines(spark.createDataFrame([("m", TEXT)], "assembly_id string, text string"))
    for df in (src.ldraw_parts(lines), src.ldraw_lines(lines), src.failed_files(lines)):
        assert plan_of(df).count(r"split(trim(") == 1


FILES = [
    ("a", "0 before\n1 1 0 0 0 1 0 0 0 1 0 0 0 1 lost.dat\n0 FILE Main.ldr\n1 16 1 0 0 1 0 0 0 1 0 0 0 1 sub.ldr\n0 STEP\n1 16 0 5 0 0 0 1 0 1 0 -1 0 0 SUB.LDR\n"
          "1 16 0 0 0 1 0 0 0 1 0 0 0 1 empty.ldr\n\n0 FILE sub.ldr\n1 9 0 0 0 1 0 0 0 1 0 0 0 1 old.dat\n0 FILE deep.ldr\n1 3 0.1 0 0 1 0 0 0 1 0 0 0 1 3003.dat\n"
          "0 FILE empty.ldr\n0 FILE Sub.ldr\n0 STEP\n1 4 1 2 3 1 0 0 0 1 0 0 0 1 3001.dat\n1 16 0 0 7 1 0 0 0 1 0 0 0 1 deep.ldr\n1 16 0 0 0 1 0 0 0 1 0 0 0 1 main.ldr\n1 x 0 0 0 1 0 0 0 1 0 0 0 1 bad.dat"),
    ("b", "0 comment\n0 file low.ldr\n1 2 0 0 0 1 0 0 0 1 0 0 0 1 3004.dat\n0 STEP\n1 2 0 0 0 1 0 0 0 1 0 0 0 1 __main__\n1 2 0 8 0 1 0 0 0 1 0 0 0 1 a long name.dat"),
    ("c", "0 FILE hollow.ldr\n0 FILE full.ldr\n1 2 0 0 0 1 0 0 0 1 0 0 0 1 3004.dat\n0 FILE full.ldr"),
    (None, "0 FILE x\n1 2 0 0 0 1 0 0 0 1 0 0 0 1 3004.dat"), ("d", None), ("e", "\n \n"),
]


def test_multi_part_files_of_any_size_flatten_alike(spark):
    lines = src.text_lines(spark.createDataFrame(FILES, "assembly_id string, text string"))
    got = []
    for limit in ("1000000", "4"):
        spark.conf.set("spark.brickloom.maxGroupRows", limit)
        try:
            got.append([
                sorted(map(str, df.collect()))
                for keep in (True, False)
                for df in (src.mpd_submodels(lines, keep), src.mpd_flatten(lines, keep_empty=keep))
            ])
        finally:
            spark.conf.unset("spark.brickloom.maxGroupRows")
    assert got[0] == got[1]
    flat = src.mpd_flatten(lines).orderBy("assembly_id", "part_index").collect()
    assert [(r.assembly_id, r.part_id, r.step_id, r.transform[3], r.transform[7], r.transform[11]) for r in flat if r.assembly_id in "ab"] == [
        ("a", "3001.dat", 1, 2.0, 2.0, 3.0), ("a", "3003.dat", 1, 1.0 + float(np.float32(0.1)), 0.0, 7.0),
        ("a", "3001.dat", 2, 3.0, 7.0, -1.0), ("a", "3003.dat", 2, 7.0, 5.0, -float(np.float32(0.1))),
        ("b", "3004.dat", 0, 0.0, 0.0, 0.0), ("b", "a long name.dat", 1, 0.0, 8.0, 0.0),
    ]


def test_files_without_faults_are_not_joined(spark):
    from brickloom.operators import ingest

    lines = src.text_lines(spark.createDataFrame([("m", TEXT)], "assembly_id string, text string"))
    assert ingest.good_lines(lines) is lines
    broken = lines.union(spark.createDataFrame([("n", 0, "1 x 0 0 0 1 0 0 0 1 0 0 0 1 3005.dat")], "a string, n int, l string"))
    assert {r.assembly_id for r in ingest.good_lines(broken).select("assembly_id").distinct().collect()} == {"m"}


def test_text_reward_reads_parsed_parts(spark):
    from brickloom.operators import metrics

    lines = src.text_lines(spark.createDataFrame([("m", TEXT)], "assembly_id string, text string"))
    reward = metrics.text_reward(src.ldraw_parts(lines), spark.createDataFrame([("m",), ("n",)], "assembly_id string"))
    assert "split(" not in plan_of(reward)
    assert {r.assembly_id: r.reward for r in reward.collect()}["n"] == -1.0
