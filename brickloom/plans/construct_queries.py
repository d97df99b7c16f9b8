"""Voxel, beam, snapping, disassembly and composition queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from brickloom.functions import geometry as g
from brickloom.operators import construct as k
from brickloom.operators import ingest, metrics
from brickloom.plans.assembly_queries import COM_SQL, GRAVITY_SQL, _component_sql
from brickloom.plans.bindings import P_SQL, PL_SQL, STACK_SQL, numbered_lines, placed_parts, stacked_parts, table
from brickloom.plans.catalog_queries import bind, duck
from brickloom.plans.registry import ORACLES, query
from brickloom.plans.sequence_queries import FLAT_SQL, HEAD, _mpd, _pose, _rendered
from brickloom.plans.source_queries import O_SQL, lines_sql
from brickloom.session import durable

VOX = """SELECT DISTINCT CAST(l_suppkey % 10 AS INT) AS model_id, CAST(l_partkey % 24 AS INT) AS x, CAST(l_linenumber AS INT) AS y, CAST(CAST(l_quantity AS INT) % 24 AS INT) AS z FROM {lineitem}"""
POINTS = "SELECT l_suppkey AS model_id, CAST(l_partkey % 701 AS DOUBLE) AS x, l_quantity * 3 AS y, l_discount * 10000 AS z FROM {lineitem}"


@query("voxel_bins", duck(t=POINTS) + """, e AS (SELECT model_id, min(x) lx, max(x) hx, min(y) ly, max(y) hy, min(z) lz, max(z) hz FROM t GROUP BY model_id)
SELECT DISTINCT model_id, CAST(least(floor((x - lx) / 20), greatest(1, ceil((hx - lx) / 20)) - 1) AS INTEGER) AS x,
  CAST(least(floor((y - ly) / 24), greatest(1, ceil((hy - ly) / 24)) - 1) AS INTEGER) AS y,
  CAST(least(floor((z - lz) / 20), greatest(1, ceil((hz - lz) / 20)) - 1) AS INTEGER) AS z FROM t JOIN e USING (model_id)""")
def voxel_bins(spark, sf):
    return k.voxel_bins(bind(spark, sf, POINTS))


def _pair_sql(src, along, fixed, n):
    return f""", r{n} AS (SELECT *, {along} - row_number() OVER (PARTITION BY model_id, y, {fixed} ORDER BY {along}) AS run FROM {src}),
s{n} AS (SELECT *, row_number() OVER (PARTITION BY model_id, y, {fixed}, run ORDER BY {along}) AS pos, count(*) OVER (PARTITION BY model_id, y, {fixed}, run) AS len FROM r{n}),
pr{n} AS (SELECT model_id, x, y, z FROM s{n} WHERE pos % 2 = 1 AND pos < len), rest{n} AS (SELECT model_id, x, y, z FROM s{n} WHERE pos % 2 = 1 AND pos = len)"""


def _block_sql(src, dx, dz, n):
    return f""", k{n} AS (SELECT *, floor((x - y % 2) / {dx}::DOUBLE) AS bx, floor((z - y % 2) / {dz}::DOUBLE) AS bz FROM {src}),
c{n} AS (SELECT *, count(*) OVER (PARTITION BY model_id, y, bx, bz) = {dx * dz} AND bx >= 0 AND bz >= 0 AS hit FROM k{n}),
pr{n} AS (SELECT model_id, min(x) AS x, y, min(z) AS z FROM c{n} WHERE hit GROUP BY model_id, y, bx, bz), rest{n} AS (SELECT model_id, x, y, z FROM c{n} WHERE NOT hit)"""


VOX_SQL = duck(t=VOX) + _block_sql("t", 2, 4, 1) + _block_sql("rest1", 4, 2, 2) + _pair_sql("rest2", "z", "x", 3) + _pair_sql("rest3", "x", "z", 4) + """,
al AS (SELECT 0 AS phase, *, '3001.dat' AS part_id, (x + 1.5) * 20 AS px, (z + 2.5) * 20 AS pz, 1.0 AS c FROM pr1 UNION ALL SELECT 1, *, '3001.dat', (x + 2.5) * 20, (z + 1.5) * 20, 0.0 FROM pr2
 UNION ALL SELECT 2, *, '3004.dat', (x + 0.5) * 20, (z + 1.5) * 20, 1.0 FROM pr3 UNION ALL SELECT 3, *, '3004.dat', (x + 1.5) * 20, (z + 0.5) * 20, 0.0 FROM pr4
 UNION ALL SELECT 4, *, '3005.dat', (x + 0.5) * 20, (z + 0.5) * 20, 1.0 FROM rest4)
SELECT model_id, phase, x AS gx, y AS layer, z AS gz, part_id, CAST(dense_rank() OVER (PARTITION BY model_id ORDER BY y) AS INTEGER) AS step_id,
  px::DOUBLE AS x, (-(y + 1) * 24)::DOUBLE AS y, pz::DOUBLE AS z, c::DOUBLE AS c FROM al"""


@query("voxel_pack", VOX_SQL)
def voxel_pack(spark, sf):
    return _pose(k.voxel_pack(bind(spark, sf, VOX)), "model_id", "phase", "gx", "layer", "gz", "part_id", "step_id").drop("s")


SCORES = "SELECT l_orderkey AS group_id, 'i' || (l_partkey % 50) AS item, CAST(max(-(l_suppkey % 16)) AS DOUBLE) / 8 AS logp FROM {lineitem} GROUP BY l_orderkey, l_partkey % 50"
WANTED = "SELECT l_orderkey AS group_id, 'i' || (l_partkey % 50) AS item FROM {lineitem} GROUP BY l_orderkey, l_partkey % 50 HAVING min(l_quantity) < 10"


@query("topn_candidates", duck(t=SCORES, w=WANTED) + """SELECT * FROM (SELECT * FROM t QUALIFY row_number() OVER (PARTITION BY group_id ORDER BY logp DESC, item DESC) <= 2)
UNION SELECT t.* FROM t JOIN w ON w.group_id = t.group_id AND w.item = t.item""")
def topn_candidates(spark, sf):
    return k.topn_candidates(bind(spark, sf, SCORES), 2, bind(spark, sf, WANTED))


BEAM = "SELECT l_suppkey AS group_id, l_orderkey AS state_id, 'g' || (l_partkey % 40) || '|' || l_linenumber AS signature, CAST(l_quantity AS DOUBLE) / 4 AS score FROM {lineitem}"


@query("beam_topk", duck(t=BEAM) + """, b AS (SELECT * FROM t QUALIFY row_number() OVER (PARTITION BY group_id, signature ORDER BY score DESC, state_id) = 1)
SELECT *, CAST(row_number() OVER (PARTITION BY group_id ORDER BY score DESC, signature) AS INTEGER) AS rank FROM b
QUALIFY row_number() OVER (PARTITION BY group_id ORDER BY score DESC, signature) <= 3""")
def beam_topk(spark, sf):
    return k.beam_topk(bind(spark, sf, BEAM), 3)


# states: the first one, two or three parts of every assembly; candidates: all different parts and colours that come later in it
FIRST = "1 + assembly_id % 3"
PLACE_SQL = f"""{P_SQL}, st AS (SELECT *, greatest(1, CAST(w / 20 AS INTEGER)) AS n, greatest(1, CAST(d / 20 AS INTEGER)) AS m FROM p WHERE part_index < {FIRST}),
cd AS (SELECT DISTINCT assembly_id, part_id, part_no, w, h, d, greatest(1, CAST(w / 20 AS INTEGER)) AS n, greatest(1, CAST(d / 20 AS INTEGER)) AS m FROM p WHERE part_index >= {FIRST}),
sa AS (SELECT DISTINCT assembly_id, h, y, c * (-10.0*(n-1) + 20*(i // m)) + s * (-10.0*(m-1) + 20*(i % m)) + x AS ax, -s * (-10.0*(n-1) + 20*(i // m)) + c * (-10.0*(m-1) + 20*(i % m)) + z AS az
  FROM (SELECT *, unnest(range(least(2, n * m))) AS i FROM st)),
ca AS (SELECT *, -10.0*(n-1) + 20*(i // m) AS lx, -10.0*(m-1) + 20*(i % m) AS lz FROM (SELECT *, unnest(range(least(2, n * m))) AS i FROM cd)),
yw(yaw, yc, ys) AS (VALUES (0, 1.0, 0.0), (1, 0.0, 1.0), (2, -1.0, 0.0), (3, 0.0, -1.0)),
cp AS MATERIALIZED (SELECT DISTINCT sa.assembly_id, ca.part_id, ca.part_no, ca.w AS cw, ca.h AS ch, ca.d AS cd,
  CAST(sa.ax - (yc * lx + ys * lz) AS DOUBLE) + 0.0 AS x, CAST(CASE WHEN up = 0 THEN sa.y - sa.h ELSE sa.y + ca.h END AS DOUBLE) + 0.0 AS y, CAST(sa.az - (-ys * lx + yc * lz) AS DOUBLE) + 0.0 AS z, CAST(yc AS DOUBLE) AS c, CAST(ys AS DOUBLE) AS s
  FROM sa JOIN ca ON ca.assembly_id = sa.assembly_id, yw, (VALUES (0), (1)) AS u(up))"""


def _beam_inputs(spark, sf):
    parts = placed_parts(spark, sf)
    later = parts.filter(f"part_index >= {FIRST}")
    return parts.filter(f"part_index < {FIRST}"), later


@query("candidate_placements", f"""WITH {PLACE_SQL} SELECT assembly_id, part_id, count(*) AS placements,
  sha256(string_agg(v, ',' ORDER BY v)) AS poses FROM (SELECT *, concat_ws(':', x, y, z, c, s) AS v FROM cp) GROUP BY assembly_id, part_id""")
def candidate_placements(spark, sf):
    """Number and digest of all poses of every candidate part, at most 96 a part."""
    state, later = _beam_inputs(spark, sf)
    posed = _pose(k.candidate_placements(state, later.select("assembly_id", "part_id").distinct()), "assembly_id", "part_id")
    text = F.concat_ws(":", *[F.col(c).cast("string") for c in ("x", "y", "z", "c", "s")])
    return posed.groupBy("assembly_id", "part_id").agg(
        F.count(F.lit(1)).alias("placements"), F.sha2(F.array_join(F.array_sort(F.collect_list(text)), ","), 256).alias("poses")
    )


STEP_SQL = f"""WITH {PLACE_SQL},
cb AS (SELECT *, x - (abs(c)*cw + abs(s)*cd)/2 AS min_x, x + (abs(c)*cw + abs(s)*cd)/2 AS max_x, z - (abs(s)*cw + abs(c)*cd)/2 AS min_z, z + (abs(s)*cw + abs(c)*cd)/2 AS max_z FROM cp),
sb AS (SELECT *, x - (abs(c)*w + abs(s)*d)/2 AS min_x, x + (abs(c)*w + abs(s)*d)/2 AS max_x, z - (abs(s)*w + abs(c)*d)/2 AS min_z, z + (abs(s)*w + abs(c)*d)/2 AS max_z FROM st),
hit AS (SELECT DISTINCT cb.assembly_id, cb.part_id, cb.x, cb.y, cb.z, cb.c, cb.s FROM cb JOIN sb ON sb.assembly_id = cb.assembly_id AND cb.min_x <= sb.max_x - 0.2 AND sb.min_x <= cb.max_x - 0.2
  AND cb.min_z <= sb.max_z - 0.2 AND sb.min_z <= cb.max_z - 0.2 AND cb.y - cb.ch <= sb.y - 0.02 AND sb.y - sb.h <= cb.y - 0.02),
ok AS (SELECT cp.* FROM cp ANTI JOIN hit USING (assembly_id, part_id, x, y, z, c, s)),
cl AS (SELECT DISTINCT assembly_id, color FROM p WHERE part_index >= {FIRST}),
nx AS (SELECT assembly_id, part_id, true AS wanted FROM p WHERE part_index = {FIRST}),
hv AS (SELECT assembly_id, part_id, count(*) AS have FROM st GROUP BY ALL),
sg AS (SELECT assembly_id AS group_id, part_id, color, x, y, z, c, s,
  -CAST(part_no AS DOUBLE) / 8 - CAST(color AS DOUBLE) / 4 + CASE WHEN assembly_id % 2 = 1 THEN 0 WHEN wanted IS NULL THEN -20 WHEN have >= 1 THEN -10 ELSE 2 END AS score,
  'start|' || part_id || ' ' || color || ' ' || CAST(c AS VARCHAR) || ' 0.0 ' || CAST(s AS VARCHAR) || ' ' || CAST(x AS VARCHAR) || ' 0.0 1.0 0.0 ' || CAST(y AS VARCHAR) || ' ' || CAST(0.0 - s AS VARCHAR) || ' 0.0 ' || CAST(c AS VARCHAR) || ' ' || CAST(z AS VARCHAR) || ' 0.0 0.0 0.0 1.0' AS signature
  FROM ok JOIN cl USING (assembly_id) LEFT JOIN nx USING (assembly_id, part_id) LEFT JOIN hv USING (assembly_id, part_id))
SELECT group_id, part_id, color, score, signature, CAST(row_number() OVER (PARTITION BY group_id ORDER BY score DESC, signature) AS INTEGER) AS rank FROM sg
QUALIFY row_number() OVER (PARTITION BY group_id ORDER BY score DESC, signature) <= 3"""


def _beam_scores(later, name):
    """Scores of all later parts and colours, by their numbers; ``name`` is the key's column in the result."""
    from brickloom.plans.bindings import ALLOWED_PARTS

    number = F.array_position(F.array(*[F.lit(p) for p in ALLOWED_PARTS]), F.col("part_id")) - 1
    parts = later.select(F.col("assembly_id").alias(name), "part_id").distinct().withColumn("logp", -number / 8)
    return parts, later.select(F.col("assembly_id").alias(name), "color").distinct().withColumn("logp", -F.col("color") / 4)


@query("beam_step", STEP_SQL)
def beam_step(spark, sf):
    """One step from the first one to three parts of every order; even orders ask for one of the part that comes next."""
    state, later = _beam_inputs(spark, sf)
    states = state.select(F.col("assembly_id").alias("group_id"), F.col("assembly_id").alias("state_id"), F.lit("start").alias("signature"), F.lit(0.0).alias("score")).distinct()
    part_scores, color_scores = _beam_scores(later, "state_id")
    inventory = later.filter(f"assembly_id % 2 = 0 AND part_index = {FIRST}").select(F.col("assembly_id").alias("group_id"), "part_id", F.lit(1).alias("target"))
    return k.beam_step(states, state, part_scores, color_scores, 3, inventory).select("group_id", "part_id", "color", "score", "signature", "rank")


SNAP_SQL = f"""WITH {STACK_SQL}, n AS (SELECT *, greatest(1, CAST(round_even(w / 20, 0) AS INTEGER)) AS nx, greatest(1, CAST(round_even(d / 20, 0) AS INTEGER)) AS nz FROM p),
mv AS (SELECT *, CASE WHEN (nx - lag(nx, 1, nx) OVER w1) % 2 = 0 THEN 0 ELSE -10 END AS dx, CASE WHEN (nz - lag(nz, 1, nz) OVER w1) % 2 = 0 THEN 0 ELSE -10 END AS dz FROM n WINDOW w1 AS (PARTITION BY assembly_id ORDER BY part_index)),
sn AS (SELECT assembly_id, part_index, h, CAST(10 + sum(dx) OVER w2 AS DOUBLE) AS x, y, CAST(10 + sum(dz) OVER w2 AS DOUBLE) AS z FROM mv WINDOW w2 AS (PARTITION BY assembly_id ORDER BY part_index))"""


@query("snap_stack", SNAP_SQL + " SELECT assembly_id, part_index, x, y, z FROM sn")
def snap_stack(spark, sf):
    return k.snap_stack(placed_parts(spark, sf)).select("assembly_id", "part_index", "x", "y", "z")


@query("snap_search", SNAP_SQL + """, hs AS (SELECT *, lag(h) OVER (PARTITION BY assembly_id ORDER BY part_index) AS ph FROM sn),
hd AS (SELECT *, CASE WHEN ph IS NULL THEN 0 WHEN ph <= h THEN -ph ELSE h END AS dy FROM hs)
SELECT assembly_id, part_index, x, CAST(sum(dy) OVER (PARTITION BY assembly_id ORDER BY part_index) AS DOUBLE) AS y, z FROM hd""")
def snap_search(spark, sf):
    return k.snap_search(placed_parts(spark, sf)).select("assembly_id", "part_index", "x", "y", "z")


ORDER_SQL = f"""WITH RECURSIVE {P_SQL}, bx AS MATERIALIZED (SELECT assembly_id, part_index AS i, y - h AS lo_y, y AS hi_y, y - h / 2 AS mean_y,
  x - (abs(c) * w + abs(s) * d) / 2 AS lo_x, x + (abs(c) * w + abs(s) * d) / 2 AS hi_x, z - (abs(s) * w + abs(c) * d) / 2 AS lo_z, z + (abs(s) * w + abs(c) * d) / 2 AS hi_z FROM p),
hd AS (SELECT a.assembly_id, a.i, a.mean_y, coalesce(list(q.i ORDER BY q.i) FILTER (q.i IS NOT NULL), []) AS holders FROM bx a LEFT JOIN bx q ON a.assembly_id = q.assembly_id AND a.i <> q.i
  AND a.lo_x - 0.1 <= q.hi_x AND a.hi_x + 0.1 >= q.lo_x AND a.lo_z - 0.1 <= q.hi_z AND a.hi_z + 0.1 >= q.lo_z AND q.lo_y < a.hi_y - 0.1 GROUP BY ALL),
st AS MATERIALIZED (SELECT assembly_id, list({{'i': i, 'holders': holders}} ORDER BY i) AS parts, list(i ORDER BY mean_y, i) AS heights FROM hd GROUP BY assembly_id),
-- each round removes everything that nothing holds, by the place of its last holder, else the highest part that is left
r AS (SELECT assembly_id, parts, heights, CAST([] AS INTEGER[]) AS done FROM st
UNION ALL SELECT assembly_id, parts, heights, list_concat(done, CASE WHEN len(free) > 0 THEN list_transform(list_sort(free), lambda f: f.i) ELSE list_filter(heights, lambda i: NOT list_contains(done, i))[1:1] END)
FROM (SELECT *, list_transform(list_filter(parts, lambda p: NOT list_contains(done, p.i) AND len(list_filter(p.holders, lambda h: NOT list_contains(done, h))) = 0),
  lambda p: {{'at': coalesce(list_max(list_transform(p.holders, lambda h: list_position(done, h))), 0), 'i': p.i}}) AS free FROM r WHERE len(done) < len(heights)))
SELECT assembly_id, unnest(done) AS part_index, CAST(unnest(range(len(done))) AS INTEGER) AS remove_no, CAST(len(done) - 1 - unnest(range(len(done))) AS INTEGER) AS build_no FROM r WHERE len(done) = len(heights)"""


@query("disassembly_order", ORDER_SQL)
def disassembly_order(spark, sf):
    return k.disassembly_order(placed_parts(spark, sf))


def _level_sql():
    blk = f"""WITH {P_SQL}{PL_SQL}, bk AS (SELECT a.assembly_id, a.owner AS part, q.owner AS blocker FROM b a JOIN b q ON a.assembly_id = q.assembly_id AND (a.owner <> q.owner OR a.copies > 1)
 AND a.min_x - 0.1 <= q.max_x AND a.max_x + 0.1 >= q.min_x AND a.min_z - 0.1 <= q.max_z AND a.max_z + 0.1 >= q.min_z AND q.min_y < a.max_y - 0.1),
l0 AS (SELECT assembly_id, owner AS part, 0 AS level FROM b WHERE (assembly_id, owner) NOT IN (SELECT (assembly_id, part) FROM bk))"""
    for i in range(1, 15):
        blk += f""",
l{i} AS (SELECT * FROM l{i-1} UNION ALL SELECT assembly_id, part, {i} FROM (SELECT bk.assembly_id, bk.part, bool_and(x.part IS NOT NULL) AS free FROM bk
  LEFT JOIN l{i-1} x ON x.assembly_id = bk.assembly_id AND x.part = bk.blocker LEFT JOIN l{i-1} d ON d.assembly_id = bk.assembly_id AND d.part = bk.part
  WHERE d.part IS NULL GROUP BY ALL) WHERE free)"""
    return blk.replace(" AS (SELECT a.assembly_id, a.owner", " AS MATERIALIZED (SELECT a.assembly_id, a.owner") + " SELECT b.assembly_id, b.owner AS part, level FROM b LEFT JOIN l14 ON l14.assembly_id = b.assembly_id AND l14.part = b.owner"


@query("disassembly_levels", _level_sql().replace("l0 AS (", "l0 AS MATERIALIZED (").replace(" AS (SELECT * FROM l", " AS MATERIALIZED (SELECT * FROM l"))
def disassembly_levels(spark, sf):
    return k.disassembly_levels(placed_parts(spark, sf))


# --- compositions ---------------------------------------------------------------------------------


@query("assembly_dataset", f"""WITH {FLAT_SQL}, n AS (SELECT assembly_id, count(*) AS n FROM flat GROUP BY assembly_id)
SELECT f.assembly_id, CAST(n AS INTEGER) AS num_parts, string_agg(part_id || ':' || step_id, ',' ORDER BY step_id, part_index) AS parts FROM flat f JOIN n ON n.assembly_id = f.assembly_id WHERE n < 100 GROUP BY f.assembly_id, n""")
def assembly_dataset(spark, sf):
    docs = ingest.assembly_dataset(_mpd(spark, sf))["documents"]
    parts = F.array_join(F.transform("parts", lambda p: F.concat_ws(":", p["part_id"], p["step_id"].cast("string"))), ",")
    return docs.select("assembly_id", "num_parts", parts.alias("parts"))


@query("catalog_scan", """SELECT o_orderkey AS assembly_id, 'Local' AS source, CASE WHEN o_orderstatus = 'O' THEN 'Unknown Lego Set' ELSE 'Plain ' || o_orderkey END AS name, CAST(1 AS BIGINT) AS pieces,
  CASE WHEN o_orderstatus <> 'O' THEN 'Late ' || o_orderkey WHEN o_orderpriority = '1-URGENT' THEN 'General' ELSE 'Plain ' || o_orderpriority END AS theme, 'Other' AS family FROM orders""")
def catalog_scan(spark, sf):
    return ingest.catalog_scan(bind(spark, sf, HEAD))


@query("catalog_index", duck(hd=HEAD) + r"""SELECT '' || o_orderkey AS set_id, CASE WHEN o_orderstatus <> 'F' THEN 'Model ' || o_orderstatus ELSE 'First ' || o_orderkey END AS name,
  CASE WHEN o_orderpriority <> '5-LOW' THEN o_orderpriority ELSE 'Unknown' END AS theme, 'Modeled by Unknown' AS description, CASE WHEN o_orderkey % 2 = 0 THEN 'BrickLink' ELSE 'OMR' END AS source,
  CASE WHEN o_orderkey % 3 = 0 THEN o_orderkey || '.ldr' WHEN o_orderkey % 3 = 1 THEN 'omr_' || o_orderkey || '.ldr' END AS normalized_file_path, 1 AS parts_count FROM orders""")
def catalog_index(spark, sf):
    lines = bind(spark, sf, HEAD).withColumn("assembly_id", F.col("assembly_id").cast("string"))
    key = F.col("o_orderkey")
    orders = table(spark, sf, "orders")
    files = orders.select(key.cast("string").alias("assembly_id"), F.concat(F.when(key % 2 == 0, "data/BrickLink_raw/").otherwise("data/raw/"), key).alias("file_path"))
    third = key % 3
    listing = orders.select(F.when(third == 0, F.concat(key, F.lit(".ldr"))).when(third == 1, F.concat(F.lit("omr_"), key, F.lit(".ldr"))).otherwise(F.concat(key, F.lit("-9.ldr"))).alias("file_name"))
    sets, _ = ingest.index_files(lines, files, listing)
    return sets.drop("file_path")


@query("text_reward", _component_sql(STACK_SQL) + GRAVITY_SQL + COM_SQL + """
SELECT o_orderkey AS assembly_id, CASE WHEN stable AND com_stable THEN 1.0::DOUBLE ELSE -1.0::DOUBLE END AS reward FROM orders LEFT JOIN (SELECT * FROM grav JOIN com USING (assembly_id)) g ON g.assembly_id = o_orderkey""")
def text_reward(spark, sf):
    """Texts of the towers, read back; orders without lines are empty texts."""
    from brickloom.sinks.ldraw import to_ldraw
    from brickloom.sources.ldraw import ldraw_parts

    lines = to_ldraw(stacked_parts(spark, sf)).select("assembly_id", (F.shiftleft(F.col("ord").cast("long"), 32) + F.col("sub")).alias("line_no"), "line")
    parts = ldraw_parts(lines)
    return metrics.text_reward(parts, table(spark, sf, "orders").select(F.col("o_orderkey").alias("assembly_id")))


@query("ingest_models", _component_sql(P_SQL) + """
SELECT 'x' || assembly_id AS set_id, count(*)::INTEGER AS parts_count, count(DISTINCT label)::INTEGER AS subassemblies_count, CAST(count(DISTINCT label) = 1 AS INTEGER) AS is_fully_connected, 'Studio MOC' AS theme, 'x' || assembly_id AS name FROM comp GROUP BY assembly_id""")
def ingest_models(spark, sf):
    named = F.concat(F.lit("x"), F.col("assembly_id"))
    lines = durable(_rendered(spark, sf).withColumn("assembly_id", named))  # the texts arrive as they are, and are read several times
    files = lines.select("assembly_id").distinct().withColumns({"file_path": F.col("assembly_id"), "source": F.lit("BrickLink")})
    return ingest.ingest_models(lines, files)["sets"].drop("source", "file_path")


@query("incremental_ingest", ORACLES["ingest_models"])
def incremental_ingest(spark, sf):
    """Texts of all assemblies arrive as a stream and end up in a catalog of batches."""
    from brickloom.sinks.ldraw import to_ldraw
    from brickloom.streaming.jobs import BatchCatalog, ingest_stream, scratch_folder

    lines = to_ldraw(placed_parts(spark, sf))
    ordered = F.array_sort(F.collect_list(F.struct("ord", "sub", "line")))
    texts = lines.groupBy("assembly_id").agg(F.array_join(F.transform(ordered, lambda v: v["line"]), "\n").alias("text"))
    named = F.concat(F.lit("x"), F.col("assembly_id"))
    models = texts.select(named.alias("assembly_id"), named.alias("file_path"), F.lit("BrickLink").alias("source"), "text")
    folder = scratch_folder(spark, "inbox")
    models.write.parquet(f"{folder}/models")
    catalog = BatchCatalog(spark, f"{folder}/catalog")
    ingest_stream(spark.readStream.schema(models.schema).parquet(f"{folder}/models"), catalog, f"{folder}/progress")
    return catalog.read("sets").drop("source", "file_path")
