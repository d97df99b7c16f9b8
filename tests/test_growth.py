"""Steps whose work must not outgrow their input."""

import datetime as dt

from brickloom.llm import fingerprint
from brickloom.llm.common import stored
from brickloom.operators import manual
from brickloom.streaming import events


def test_element_pieces_have_lengths_of_design_ids_only(spark):
    elements = ["300123", "4211", "12", "", None, "300130"]
    templates = spark.createDataFrame([(k, e) for k in (1, 2) for e in elements], "manual_id long, element_id string")
    rows = [(1, 2, "3001.dat"), (1, 1, "0123.dat"), (1, 0, "9999.dat"), (2, 0, ".dat"), (2, 1, "21.dat"), (2, 2, None), (3, 0, "1.dat")]
    candidates = spark.createDataFrame(rows, "manual_id long, item_no long, part_id string")
    design = candidates.selectExpr("manual_id", "substring_index(part_id, '.', 1) AS piece")
    pieces = [r.piece for r in manual.element_pieces(templates, design).filter("manual_id = 1").collect()]
    assert sorted(pieces) == ["0012", "0013", "0123", "0130", "3001", "3001", "4211"]
    got = {(r.manual_id, r.element_id): r.part_id for r in manual.substring_match(templates, candidates).collect()}
    want = {}
    for k, e in got:
        mine = sorted((n, p) for m, n, p in rows if m == k and p)
        own = [p for _, p in mine if e is not None and p.split(".")[0] in e and (p.split(".")[0] or not e)]
        want[k, e] = own[0] if own else mine[0][1]
    assert len(got) == 12 and got == want


def test_cadence_fold_runs_as_aggregates(spark, tiny_groups):
    outcomes = {k: [(k * i * i + i) % 7 < 2 for i in range(12 + k)] for k in range(6)}
    rows = [(k, dt.datetime(2024, 1, 1, 0, 0, i), i, "failure" if bad else "success") for k, o in outcomes.items() for i, bad in enumerate(o)]
    rows += [(None, *rows[0][1:]), (7, dt.datetime(2024, 1, 1), 0, "claim")]
    batch = spark.createDataFrame(rows, "crawler int, ts timestamp, seq long, action string")
    state = spark.createDataFrame([(0, 11.5, 2), (3, 1.0, 0)], "crawler int, delay double, streak int")
    rule = events.Cadence(3.0, 1.0, 20.0, 3, 0.5)
    new = events.cadence_fold(batch, state, rule)
    # no Python worker per crawler
    assert "Pandas" not in new._jdf.queryExecution().executedPlan().toString()
    want = {}
    for k, o in outcomes.items():
        delay, streak = {0: (11.5, 2), 3: (1.0, 0)}.get(k, (rule.start, 0))
        for bad in o:
            streak = 0 if bad else streak + 1
            if bad:
                delay = min(rule.cap, delay * 2)
            elif streak == rule.streak:
                delay, streak = max(rule.floor, delay - rule.step), 0
        want[k] = (delay, streak)
    assert {r.crawler: (r.delay, r.streak) for r in new.collect()} == want


def test_fingerprints_are_stored_as_bytes(spark, monkeypatch):
    kept = []
    monkeypatch.setattr(fingerprint, "stored", lambda df: kept.append(df) or stored(df))
    docs = spark.createDataFrame([(1, "a b c d e f g h"), (2, None), (3, "one two")], "doc_id long, text string")
    rows = fingerprint.fingerprints(docs).collect()
    prints = dict(kept[-1].dtypes)
    assert {prints[c] for c in ("edited_sha256", "fingerprint", "edited_fingerprint")} == {"binary"}
    assert {r.doc_id: (len(r.fingerprint), len(r.edited_sha256)) for r in rows} == {1: (256, 64), 2: (0, 64), 3: (256, 64)}
    assert all(r.fingerprint == r.fingerprint.lower() for r in rows)
