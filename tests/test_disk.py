"""What is stored, moved and sorted on the way must stay small beside the input."""

import json

import numpy as np
import pytest
from helpers import at, parts_df
from pyspark.sql import functions as F

from brickloom.operators import construct, graph, ingest, manual, metrics, mirror, spatial
from brickloom.session import durable
from brickloom.sinks import ldraw as sink
from brickloom.sources import ldraw


def test_beam_step_lists_only_colours_that_can_win(spark, monkeypatch):
    ranked = []
    topk = construct.beam_topk
    monkeypatch.setattr(construct, "beam_topk", lambda rows, width: ranked.append(rows) or topk(rows, width))
    state = parts_df(spark, {"a": [at("3001", 0, 0, 0)], "b": [at("3005", 0, 0, 0)]})
    states = spark.createDataFrame([("g", "a", "start", 0.0), ("g", "b", "start", -1.0)], "group_id string, state_id string, signature string, score double")
    parts = spark.createDataFrame([(k, p, s) for k in "ab" for p, s in (("3001.dat", 0.0), ("3005.dat", -0.5))], "state_id string, part_id string, logp double")
    colours = spark.createDataFrame([(k, c, -c / 4) for k in "ab" for c in range(12)] + [("a", 0, -9.0), ("a", None, None)], "state_id string, color int, logp double")
    best = construct.beam_step(states, state, parts, colours, 3).collect()
    rows = ranked[-1].collect()
    # per state: three best of part and colour, a repeated one and those without a score, each with its first poses
    assert len(rows) <= 3 * (4 + 3 + 2) and {r.color for r in rows} <= {0, 1, 2, None}
    assert sorted((r.score, r.color, r.rank) for r in best) == [(0.0, 0, 1), (0.0, 0, 2), (0.0, 0, 3)]
    signatures = [r.signature for r in sorted(best, key=lambda r: r["rank"])]
    assert signatures == sorted(signatures) and all(s.startswith("start|3001.dat 0 -1.0 0.0 0.0 ") for s in signatures)
    text = spark.range(1).select(construct._pose_text(F.array(*[F.lit(v) for v in (1.0, -0.0, -1.0, 0.001, -0.004, 2.346, *[float(i) for i in range(10)])])).alias("t")).first().t
    assert text == "1.0 0.0 -1.0 0.0 0.0 2.35 0.0 1.0 2.0 3.0 4.0 5.0 6.0 7.0 8.0 9.0"


def heap(spark):
    """Small assemblies on a lattice with copies, repeated list positions, and parts without an assembly, id or pose."""
    rng = np.random.default_rng(3)
    spot = lambda: [float(v) for v in (rng.integers(-2, 3) * 10, -8 * rng.integers(0, 5), rng.integers(-2, 3) * 10)]
    made = {k: [at(rng.choice(["3001", "3005", "3022", "3004"]), *spot()) for _ in range(n)] for k, n in (("a", 14), ("b", 9), ("c", 1), ("d", 30))}
    made["a"] += made["a"][:4]
    parts = parts_df(spark, made)
    odd = parts.filter("assembly_id = 'b' AND part_index < 3")
    for i, name in enumerate(("assembly_id", "part_id", "transform")):
        lost = odd.withColumn(name, F.lit(None).cast(parts.schema[name].dataType)).withColumn("part_index", F.col("part_index") + 10 * (i + 1))
        parts = parts.unionByName(lost)
    return durable(parts.unionByName(odd.filter("part_index = 1")))


def listed(df):
    return sorted(json.dumps(r.asDict(True), sort_keys=True) for r in df.collect())


def chunks(parts):
    names = parts.select("assembly_id").distinct().withColumns({"set_name": F.col("assembly_id"), "set_number": F.col("assembly_id")})
    return sink.homogenized_chunks(parts, spatial.child_connections(parts, spatial.connection_ranges(parts)), names, size=3)


def documents(parts):
    names = parts.select("assembly_id").distinct().withColumns({"set_name": F.col("assembly_id"), "set_number": F.col("assembly_id")})
    return sink.homogenized_documents(parts, spatial.parent_connections(parts), names)


def dedupe(parts):
    xyz = [F.get("transform", F.lit(i)) for i in (3, 7, 11)]
    boxes = parts.select(F.col("assembly_id").alias("page_id"), F.col("part_index").alias("box_id"), *[
        (v % 7).alias(n) for n, v in zip(("x0", "y0", "x1", "y1"), (xyz[0] / 10, xyz[1] / 8, xyz[2] / 10, xyz[0] / 10))])
    return manual.box_dedupe(boxes)


STEPS = {
    "F2 homogenized_chunks": (chunks, 1), "F6 connection_ranges": (spatial.connection_ranges, 1), "F7 disassembly_levels": (construct.disassembly_levels, 0),
    "F8 mirror_match": (mirror.mirror_partners, 2), "F12 subassemblies": (graph.subassemblies, 0), "F13 vehicle_metrics": (metrics.vehicle_metrics, 2),
    "F14 symmetry_score": (metrics.symmetry_score, 2), "F15 set_connectivity": (lambda p: graph.set_connectivity(graph.subassemblies(p)), 0),
    "F16 to_homogenized_json": (documents, 0), "F17 box_dedupe": (dedupe, 0),
}


@pytest.mark.parametrize("name", STEPS)
def test_small_assemblies_stay_where_they_lie(spark, monkeypatch, name):
    """Same rows as by the way of large assemblies; less is stored, and what is stored are pairs or types and never the parts."""
    parts, (step, most) = heap(spark), STEPS[name]
    stored = []
    for module in (spatial, graph, construct, mirror, manual):
        monkeypatch.setattr(module, "durable", lambda df: stored.append(df) or durable(df))
    out = step(parts)
    got = listed(out)
    assert len(stored) <= most and not any({"transform", "n"} & set(df.columns) for df in stored)
    monkeypatch.setattr(spatial, "SMALL", 0)
    assert got == listed(step(parts)) and got
    assert len(stored) > most


def test_parts_of_an_assembly_are_dealt_out_once(spark):
    parts = heap(spark)
    plan = graph.subassemblies(parts)._jdf.queryExecution().executedPlan().toString()
    # the parts for the pairs (both sides and the parts that are counted), and the labels
    assert "SinglePartition" not in plan and "hashpartitioning(assembly_id, part_id" not in plan


def mpd(spark):
    files = {
        "a": ["0 FILE main", "1 4 0 0 0 1 0 0 0 1 0 0 0 1 sub", "0 STEP", "1 4 1 0 0 1 0 0 0 1 0 0 0 1 3001.dat", "1 5 0 8 0 1 0 0 0 1 0 0 0 1 SUB", "0 FILE sub", "1 7 3 0 0 1 0 0 0 1 0 0 0 1 3005.dat", "0 STEP", "1 7 4 0 0 1 0 0 0 1 0 0 0 1 main",
              *[f"1 {c} 5 0 0 1 0 0 0 1 0 0 0 1 3022.dat" for c in range(8)]],
        "b": ["0 plain", "1 4 0 0 0 1 0 0 0 1 0 0 0 1 3001.dat", "1 4 0 0 0 1 0 0 0 1 0 0 0 1 __main__"], "c": ["0 nothing"],
        "d": ["1 4 0 0 0 1 0 0 0 1 0 0 0 x 3001.dat"], "e": ["0 FILE one", "0 FILE two", "1 4 0 0 0 1 0 0 0 1 0 0 0 1 one"],
    }
    return spark.createDataFrame([(k, i, line) for k, v in files.items() for i, line in enumerate(v)], "assembly_id string, line_no int, line string")


@pytest.mark.parametrize("keep_empty", [True, False])
def test_short_files_store_no_plain_lines(spark, monkeypatch, keep_empty):
    """of short files only lines that name or mark a model, and one of each file, are stored."""
    lines = mpd(spark)
    stored = []
    monkeypatch.setattr(ldraw, "durable", lambda df: stored.append(durable(df)) or stored[-1])
    got = listed(ldraw.mpd_flatten(lines, keep_empty=keep_empty))
    heads = stored[0].collect()
    assert all(r.mark or r.is_model or r._lead for r in heads) and sum(r._lead for r in heads) <= 4
    assert sum(not r.mark and not r.is_model for r in heads) < 4 <= sum(not r.mark and not r.is_model for r in ldraw._references(lines, keep_empty, True).collect())
    monkeypatch.setattr(ldraw, "SMALL", 0)
    assert got == listed(ldraw.mpd_flatten(lines, keep_empty=keep_empty)) and got


def test_dataset_of_short_files_stores_no_parts(spark, monkeypatch):
    lines = mpd(spark)
    stored = []
    for module in (ingest, spatial):
        monkeypatch.setattr(module, "durable", lambda df: stored.append(df.columns) or durable(df))
    made = ingest.assembly_dataset(lines)
    got = {k: listed(df) for k, df in made.items()}
    assert stored == [["assembly_id"]]
    for module in (ingest, spatial, ldraw):
        monkeypatch.setattr(module, "SMALL", 0)
    assert got == {k: listed(df) for k, df in ingest.assembly_dataset(lines).items()} and got["documents"] and got["status"]
