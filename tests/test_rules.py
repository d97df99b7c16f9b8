"""Cases in which a plausible shortcut gives another result."""

import os
from datetime import datetime, timedelta

import numpy as np
import pytest
from helpers import SCHEMA
from pyspark.sql import functions as F

from brickloom.operators import catalog, construct, manual, scans
from brickloom.sinks.ldraw import to_ldraw_paged
from brickloom.sources import documents
from brickloom.streaming import events as e
from brickloom.streaming.jobs import fold_stream

EVENTS = "model_id int, crawler int, ts timestamp, seq long, action string, error string"


def events(spark, actions, key=1):
    rows = [(key, key, datetime(2024, 1, 1) + timedelta(seconds=i), i, a, err) for i, (a, err) in enumerate(actions)]
    return spark.createDataFrame(rows, EVENTS)


def test_adaptive_claim_clears_the_error(spark):
    rows = [("enqueue", None), ("claim", None), ("failure", "File is Encrypted"), ("claim", None)]
    r = e.queue_state(events(spark, rows), adaptive=True).first()
    assert (r.status, r.attempts, r.error_msg) == ("downloading", 3, None)
    r = e.queue_state(events(spark, rows[:3]), adaptive=True).first()
    assert (r.status, r.attempts, r.error_msg) == ("failed", 2, "File is Encrypted")


def walked(actions, rule):
    delay, streak, out = rule.start, 0, []
    for a in actions:
        if a == "failure":
            delay, streak = min(rule.cap, delay * 2), 0
        else:
            streak += 1
            if streak == rule.streak:
                delay, streak = max(rule.floor, delay - rule.step), 0
        out.append((delay, streak))
    return out


def test_cadence_in_pieces_equals_the_walk(spark):
    actions = ["failure" if x else "success" for x in np.random.default_rng(2).random(2600) < 0.45] + ["failure"] * 1100
    df = events(spark, [(a, None) for a in actions])
    spark.conf.set("spark.brickloom.maxGroupRows", "1200")
    try:
        for rule in (e.ADAPTIVE, e.SHARED, e.PROFILER):
            got = e.cadence_state(df, rule).orderBy("seq").collect()
            assert [(r.delay, r.streak) for r in got] == walked(actions, rule)
    finally:
        spark.conf.unset("spark.brickloom.maxGroupRows")


def test_pages_are_marked_once_per_new_highest_step(spark):
    pose = [float(v) for v in np.eye(4).flatten()]
    rows = [("a", i, "3001.dat", 4, s, s, pose) for i, s in enumerate([0, 2, 1, 2, 3])]
    lines = to_ldraw_paged(spark.createDataFrame(rows, SCHEMA), ["0 X"]).collect()
    assert [r.line for r in sorted(lines, key=lambda r: (r.ord, r.sub)) if "PAGE" in r.line] == ["0 STEP PAGE 2", "0 STEP PAGE 3"]


def test_last_result_of_a_set_wins(spark):
    sets = spark.createDataFrame([("s1", "n")], "set_id string, name string")
    sets = sets.select("set_id", "name", *[F.lit(None).cast("string").alias(c) for c in catalog.CLASSIFICATION])
    results = spark.createDataFrame([("s1", "a"), ("s1", "b")], "set_id string, v string").select("set_id", *[F.col("v").alias(c) for c in catalog.CLASSIFICATION])
    official = spark.createDataFrame([], "set_num string, name string, year int, img_url string, num_parts int")
    got = catalog.catalog_update_columns(sets, results, official).collect()
    assert len(got) == 1 and got[0][catalog.CLASSIFICATION[0]] == "b"


def queue_order(box, mean_y):
    """First in, first out over the parts that nothing holds; the highest of the rest when none is free."""
    n = len(box)
    lo, hi = box[:, ::2], box[:, 1::2]
    holds = [
        {b for b in range(n) if b != a and lo[b, 1] < hi[a, 1] - 0.1 and all(lo[a, k] - 0.1 <= hi[b, k] and hi[a, k] + 0.1 >= lo[b, k] for k in (0, 2))}
        for a in range(n)
    ]
    line, gone = [a for a in range(n) if not holds[a]], []
    while len(gone) < n:
        if not line:
            line.append(min((mean_y[a], a) for a in range(n) if a not in gone)[1])
        part = line.pop(0)
        gone.append(part)
        line += [a for a in range(n) if a not in gone and a not in line and holds[a] and holds[a] <= set(gone)]
    return gone


def test_layers_give_the_queue_order():
    r = np.random.default_rng(4)
    for _ in range(200):
        n = int(r.integers(1, 14))
        low = r.integers(0, 6, (n, 3)) * 10.0
        high = low + r.integers(1, 4, (n, 3)) * 10.0
        box = np.stack([low, high], 2).reshape(n, 6)
        assert np.argsort(construct._layers(box, box[:, 2:4].mean(1))).tolist() == queue_order(box, box[:, 2:4].mean(1))


def test_studio_parts_of_real_xml(spark):
    text = '<S><!-- <Part design="no"/> --><G><Part/><Part design="a&amp;b" color="3" tx="1.5"></Part></G></S>'
    deep = """<?xml version="1.0"?><Part design="root"><A x='>'><Parts/><B><![CDATA[<Part design="no"/>]]><Part design='x"y'\n tx="-2" m00="&#48;" color=""/></B></A></Part>"""
    rows = [("m", text), ("broken", "<S><Part"), ("open", "<S><Part></S>"), ("none", None), ("empty", ""), ("root", '<Part design="alone"/>'), ("deep", deep)]
    got = documents.studio_xml_parts(spark.createDataFrame(rows, "assembly_id string, text string")).collect()
    assert [(r.assembly_id, r.part_index, r.part_id, r.color, r.transform[3]) for r in got] == [
        ("m", 0, "None.dat", 14, 0.0), ("m", 1, "a&b.dat", 3, 1.5), ("deep", 0, 'x"y.dat', 14, -2.0),
    ]
    assert got[2].transform[0] == 0.0
    long = "<S>" + '<Part design="3001" color="4"/>' * 20_000 + "</S>"
    assert documents.studio_xml_parts(spark.createDataFrame([("long", long)] * 2, "assembly_id string, text string")).count() == 40_000


def test_nearest_template_in_blocks_equals_all_pairs(spark):
    rng = np.random.default_rng(8)
    rows = [(int(m), i, [float(v) for v in rng.integers(-2, 3, 3)]) for i, m in enumerate(rng.integers(0, 3, 240))]
    rows += [(7, 300, [1.0, 0.0, 0.0]), (8, 301, [0.0, 0.0, 0.0]), (8, 302, [1.0, 1.0, 0.0]), (9, 303, [1.0, 0.0, 0.0]), (9, 304, [-1.0, 0.0, 0.0])]
    given = [r for r in rows if r[1] % 4 == 0 and r[0] != 7] + [(8, 999, [0.0, 0.0, 0.0])]
    given = [r for r in given if r[0] != 9] + [(9, 304, [-1.0, 0.0, 0.0])]
    queries = spark.createDataFrame(rows, "manual_id int, query_id long, embedding array<double>")
    templates = spark.createDataFrame(given, "manual_id int, template_id long, embedding array<double>")
    want = {}
    for m, q, v in rows:
        best = (-1.0, None)
        for n, t, u in sorted(given, key=lambda r: r[1]):
            if n == m:
                norm = np.linalg.norm(v) * np.linalg.norm(u)
                s = round(float(np.dot(v, u) / norm), 12) if norm > 0 else 0.0
                best = max(best, (s, t), key=lambda b: b[0])
        if best[1] is not None:
            want[m, q] = best
    for size in (5, 1000):
        got = {(r.manual_id, r.query_id): (pytest.approx(r.score), r.template_id) for r in manual.nearest_template(queries, templates, size).collect()}
        assert got == want and (9, 303) not in want and (7, 300) not in want


def test_as_of_on_a_hot_key(spark, tiny_groups):
    rng = np.random.default_rng(12)
    times = rng.permutation(60)
    events = spark.createDataFrame([("k" if t % 5 else "o", int(t), f"e{t}") for t in times[:40]], "key string, at int, name string")
    states = spark.createDataFrame([("k" if t % 5 else "o", int(t), None if t % 7 == 0 else float(t)) for t in times[30:]], "key string, at int, level double")
    held = states.collect()
    for r in scans.as_of(events, states, ["key"], ["at"], ["level"]).collect():
        before = [s for s in held if s.key == r.key and s.at < r.at]
        assert r.level == (max(before, key=lambda s: s.at).level if before else None) and r.name == f"e{r.at}"


def test_streams_in_several_batches_equal_the_folds(spark, tiny_groups, tmp_path):
    """Files in time order, one a micro-batch; one model and crawler holds most rows."""
    rng = np.random.default_rng(21)
    actions = rng.choice(["enqueue", "claim", "success", "failure"], 90, p=[0.1, 0.3, 0.35, 0.25])
    rows = [
        (int(k), int(k), datetime(2024, 1, 1) + timedelta(seconds=i // 2), i, str(a), "File is Encrypted" if i % 3 else f"timeout {i}")
        for i, (a, k) in enumerate(zip(actions, np.where(rng.random(90) < 0.7, 1, rng.integers(2, 5, 90)), strict=True))
    ]
    for k in range(3):
        spark.createDataFrame(rows[30 * k : 30 * k + 30], EVENTS).coalesce(1).write.parquet(f"{tmp_path}/in/f{k}")
    whole = spark.createDataFrame(rows, EVENTS)
    files = sorted(tmp_path.glob("in/f*/*.parquet"), key=lambda f: f.parent.name)
    for k, f in enumerate(files):
        os.utime(f, (1_700_000_000 + k, 1_700_000_000 + k))
    stream = lambda: spark.readStream.schema(whole.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*")
    for adaptive in (False, True):
        got = fold_stream(stream(), lambda b, s, a=adaptive: e.queue_fold(b, s, a), e.QUEUE_STATE.format(key="int"), "model_id")
        want = e.queue_state(whole, adaptive).drop("settled")
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    got = fold_stream(stream(), e.cadence_fold, e.CADENCE_STATE.format(key="int"), "crawler")
    want = e.cadence_state(whole).groupBy("crawler").agg(F.max_by(F.struct("delay", "streak"), "seq").alias("r")).select("crawler", "r.*")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_changes_of_rules_without_a_common_grid(spark):
    rule = e.Cadence(start=3.0, floor=0.7, cap=61.3, streak=2, step=0.37)
    effects = np.random.default_rng(3).choice([-1, 0, 1], 400, p=[0.6, 0.2, 0.2])
    delay = rule.start
    for n, x in enumerate(effects, 1):
        delay = min(rule.cap, delay * 2) if x == 1 else max(rule.floor, delay - rule.step) if x == -1 else delay
        assert e._changed(e._reduced(effects[:n], rule), rule.start) == pytest.approx(delay)
