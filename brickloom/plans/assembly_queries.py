"""Spatial, graph and metric queries over placed parts."""

from __future__ import annotations

from pyspark.sql import functions as F

from brickloom.functions.geometry import BOX, anchors, solids, with_dims
from brickloom.lookups import PART_NAMES, values_sql
from brickloom.operators import graph, metrics, mirror, spatial
from brickloom.plans.bindings import (
    ANCHOR_SQL,
    CONTACT_SQL,
    P_SQL,
    PL_SQL,
    STACK_SQL,
    placed_parts,
    stacked_parts,
    table,
)
from brickloom.plans.registry import ORACLES, query

DIMS_SQL = f"""
WITH ids AS (
  SELECT p_partkey, CASE p_partkey % 5
    WHEN 0 THEN (300 + p_size)::VARCHAR || (p_partkey % 10)::VARCHAR || '.dat'
    WHEN 1 THEN lower(replace(p_name, ' ', '_')) || '_plate_' || (p_size % 9 + 1)::VARCHAR || 'x4.dat'
    WHEN 2 THEN 'brick ' || (p_size % 7 + 1)::VARCHAR || ' x ' || (p_partkey % 3 + 1)::VARCHAR || '.dat'
    WHEN 3 THEN '302' || p_size::VARCHAR || 'z.dat'
    ELSE 'misc' || p_size::VARCHAR || '.dat' END AS part_id
  FROM part),
known AS (SELECT * FROM {{dims}}),
named AS (SELECT * FROM {values_sql(PART_NAMES, ['nid', 'nm'], 'nn')}),
j AS (
  SELECT ids.*, kw, kh, kd, lower(coalesce(nm, '')) AS nm, lower(part_id) AS pid
  FROM ids LEFT JOIN known ON kid = part_id LEFT JOIN named ON nid = part_id),
src AS (
  SELECT *, CASE WHEN regexp_matches(nm, '(\\d+)\\s*x\\s*(\\d+)') THEN nm
                 WHEN regexp_matches(pid, '(\\d+)\\s*x\\s*(\\d+)') THEN pid END AS src FROM j)
SELECT p_partkey, part_id,
  CASE WHEN kw IS NOT NULL THEN kw
       WHEN src IS NOT NULL THEN CAST(regexp_extract(src, '(\\d+)\\s*x\\s*(\\d+)', 1) AS DOUBLE) * 20
       ELSE 20.0::DOUBLE END AS w,
  CASE WHEN kh IS NOT NULL THEN kh
       WHEN src IS NOT NULL AND regexp_matches(pid || ' ' || nm, 'plate|tile') THEN 8.0::DOUBLE
       WHEN src IS NOT NULL THEN 24.0::DOUBLE
       WHEN pid LIKE '302%' OR pid LIKE '307%' THEN 8.0::DOUBLE ELSE 24.0::DOUBLE END AS h,
  CASE WHEN kd IS NOT NULL THEN kd
       WHEN src IS NOT NULL THEN CAST(regexp_extract(src, '(\\d+)\\s*x\\s*(\\d+)', 2) AS DOUBLE) * 20
       ELSE 20.0::DOUBLE END AS d
FROM src"""


def _dims_sql():
    from brickloom.lookups import PART_DIMENSIONS

    return DIMS_SQL.replace("{dims}", values_sql(PART_DIMENSIONS, ["kid", "kw", "kh", "kd"], "kk"))


@query("part_dims", _dims_sql())
def part_dims(spark, sf):
    key, size = F.col("p_partkey"), F.col("p_size")
    part_id = (
        F.when(key % 5 == 0, F.concat((300 + size).cast("string"), (key % 10).cast("string"), F.lit(".dat")))
        .when(key % 5 == 1, F.concat(F.lower(F.replace("p_name", F.lit(" "), F.lit("_"))), F.lit("_plate_"),
                                     (size % 9 + 1).cast("string"), F.lit("x4.dat")))
        .when(key % 5 == 2, F.concat(F.lit("brick "), (size % 7 + 1).cast("string"), F.lit(" x "),
                                     (key % 3 + 1).cast("string"), F.lit(".dat")))
        .when(key % 5 == 3, F.concat(F.lit("302"), size.cast("string"), F.lit("z.dat")))
        .otherwise(F.concat(F.lit("misc"), size.cast("string"), F.lit(".dat")))
    )
    return with_dims(table(spark, sf, "part").select("p_partkey", part_id.alias("part_id")))


@query("world_bounds", f"WITH {P_SQL}{PL_SQL} SELECT assembly_id, owner, copies, "
       "min_x, max_x, min_y, max_y, min_z, max_z, (min_y + max_y) / 2 AS mean_y FROM b")
def world_bounds(spark, sf):
    body = solids(spatial.placements(placed_parts(spark, sf)))
    return body.select("assembly_id", "owner", "copies", *BOX, "mean_y")


@query("anchors", f"""WITH {P_SQL}{PL_SQL}{ANCHOR_SQL}
SELECT assembly_id, owner, 'stud' AS kind, CAST(idx AS INTEGER) AS anchor_idx, ax, ay, az FROM studs
UNION ALL
SELECT assembly_id, owner, 'socket' AS kind, CAST(idx AS INTEGER) AS anchor_idx, ax, ay, az FROM sockets""")
def all_anchors(spark, sf):
    body = solids(spatial.placements(placed_parts(spark, sf)))
    parts = [
        anchors(body, kind, ["assembly_id", "owner"]).withColumn("kind", F.lit(kind))
        for kind in ("stud", "socket")
    ]
    return parts[0].unionByName(parts[1])


@query("contact_pairs", f"WITH {P_SQL}{PL_SQL}{ANCHOR_SQL}{CONTACT_SQL} SELECT * FROM touch")
def contact_pairs(spark, sf):
    return spatial.contact_pairs(placed_parts(spark, sf))


EDGES_SQL = f"""WITH {P_SQL}{PL_SQL}{ANCHOR_SQL}{CONTACT_SQL},
both_ways AS (
  SELECT assembly_id, part_a AS src, part_b AS dst, copies_a AS src_copies, copies_b AS dst_copies FROM touch
  UNION ALL
  SELECT assembly_id, part_b, part_a, copies_b, copies_a FROM touch)
SELECT e.assembly_id, src, dst, src_copies, dst_copies,
  j.x - i.x AS dx, j.y - i.y AS dy, j.z - i.z AS dz,
  i.c * j.c + i.s * j.s AS r00, i.c * j.s - i.s * j.c AS r02, 1.0::DOUBLE AS r11,
  i.s * j.c - i.c * j.s AS r20, i.s * j.s + i.c * j.c AS r22
FROM both_ways e JOIN pl i ON i.assembly_id = e.assembly_id AND i.owner = src
JOIN pl j ON j.assembly_id = e.assembly_id AND j.owner = dst"""


@query("contact_edges_directed", EDGES_SQL)
def contact_edges_directed(spark, sf):
    edges = spatial.contact_edges_directed(placed_parts(spark, sf))
    named = {"dx": 0, "dy": 1, "dz": 2, "r00": 3, "r02": 5, "r11": 7, "r20": 9, "r22": 11}
    return edges.select(
        "assembly_id", "src", "dst", "src_copies", "dst_copies",
        *[(F.get("edge_attr", F.lit(i)) + 0.0).alias(n) for n, i in named.items()],
    )


AABB_SQL = """
  FROM b a JOIN b b2 ON a.assembly_id = b2.assembly_id AND a.owner < b2.owner
   AND a.min_x <= b2.max_x - 0.2 AND b2.min_x <= a.max_x - 0.2
   AND a.min_y <= b2.max_y - 0.02 AND b2.min_y <= a.max_y - 0.02
   AND a.min_z <= b2.max_z - 0.2 AND b2.min_z <= a.max_z - 0.2"""
ALIGNED_SQL = f"""WITH {P_SQL}{PL_SQL}
SELECT a.assembly_id, a.owner AS part_a, b2.owner AS part_b, a.copies AS copies_a, b2.copies AS copies_b
{AABB_SQL}"""


@query("axis_aligned_collisions", ALIGNED_SQL)
def axis_aligned_collisions(spark, sf):
    return spatial.axis_aligned_collisions(placed_parts(spark, sf))


@query("collision_pairs", ALIGNED_SQL + """
UNION ALL SELECT assembly_id, owner, owner, copies, copies FROM b WHERE copies > 1""")
def collision_pairs(spark, sf):
    return spatial.collision_pairs(placed_parts(spark, sf))


@query("blocked_pairs", f"""WITH {P_SQL}{PL_SQL}
SELECT a.assembly_id, a.owner AS part, k.owner AS blocker, a.copies AS part_copies, k.copies AS blocker_copies
FROM b a JOIN b k ON a.assembly_id = k.assembly_id AND (a.owner <> k.owner OR a.copies > 1)
 AND a.min_x - 0.1 <= k.max_x AND a.max_x + 0.1 >= k.min_x
 AND a.min_z - 0.1 <= k.max_z AND a.max_z + 0.1 >= k.min_z AND k.min_y < a.max_y - 0.1""")
def blocked_pairs(spark, sf):
    return spatial.blocked_pairs(placed_parts(spark, sf))


@query("placement_check", f"""WITH {P_SQL}{PL_SQL.replace("FROM p GROUP BY ALL", "FROM p WHERE step_id = 0 GROUP BY ALL")}{ANCHOR_SQL},
st AS (SELECT * FROM b),
cand AS (
  SELECT *, x - (abs(c) * w + abs(s) * d) / 2 AS min_x, x + (abs(c) * w + abs(s) * d) / 2 AS max_x,
    y - h AS min_y, y AS max_y,
    z - (abs(s) * w + abs(c) * d) / 2 AS min_z, z + (abs(s) * w + abs(c) * d) / 2 AS max_z
  FROM p WHERE step_id > 0),
cgrid AS (
  SELECT *, greatest(1, CAST(w / 20 AS INTEGER)) AS n, greatest(1, CAST(d / 20 AS INTEGER)) AS m FROM cand),
cl AS (SELECT *, -10.0*(n-1) + 20.0*(idx // m) AS lx, -10.0*(m-1) + 20.0*(idx % m) AS lz
  FROM (SELECT *, unnest(range(n * m)) AS idx FROM cgrid)),
ca AS (SELECT assembly_id, part_index, c*lx + s*lz + x AS ax, -s*lx + c*lz + z AS az, y - h AS top, y AS bottom FROM cl),
held AS (
  SELECT DISTINCT k.assembly_id, k.part_index FROM ca k JOIN sockets q ON q.assembly_id = k.assembly_id
   AND (k.ax-q.ax)*(k.ax-q.ax) + (k.top-q.ay)*(k.top-q.ay) + (k.az-q.az)*(k.az-q.az) < 25.0
  UNION
  SELECT DISTINCT k.assembly_id, k.part_index FROM ca k JOIN studs q ON q.assembly_id = k.assembly_id
   AND (k.ax-q.ax)*(k.ax-q.ax) + (k.bottom-q.ay)*(k.bottom-q.ay) + (k.az-q.az)*(k.az-q.az) < 25.0),
hit AS (
  SELECT DISTINCT k.assembly_id, k.part_index FROM cand k JOIN st a ON a.assembly_id = k.assembly_id
   AND a.min_x <= k.max_x - 0.2 AND k.min_x <= a.max_x - 0.2
   AND a.min_y <= k.max_y - 0.02 AND k.min_y <= a.max_y - 0.02
   AND a.min_z <= k.max_z - 0.2 AND k.min_z <= a.max_z - 0.2)
SELECT cand.assembly_id, cand.part_index AS candidate_id,
  hit.part_index IS NULL AND held.part_index IS NOT NULL AS valid
FROM cand LEFT JOIN hit USING (assembly_id, part_index) LEFT JOIN held USING (assembly_id, part_index)""")
def placement_check(spark, sf):
    """State = parts of the first step; every later part is a candidate."""
    parts = placed_parts(spark, sf)
    later = parts.filter("step_id > 0").withColumnRenamed("part_index", "candidate_id")
    return spatial.placement_check(parts.filter("step_id = 0"), later).select(
        "assembly_id", "candidate_id", "valid"
    )


@query("parent_connections", f"""WITH {(P_SQL + PL_SQL + ANCHOR_SQL + CONTACT_SQL).replace(" AS (", " AS MATERIALIZED (")},
links AS MATERIALIZED (
  SELECT assembly_id, part_a AS po, part_b AS co FROM touch
  UNION ALL SELECT assembly_id, part_b, part_a FROM touch),
near AS MATERIALIZED (
  SELECT l.assembly_id, po, co, 0 AS mode, a.idx AS pi, k.idx AS ci FROM links l
  JOIN studs a ON a.assembly_id = l.assembly_id AND a.owner = po
  JOIN sockets k ON k.assembly_id = l.assembly_id AND k.owner = co
   AND (a.ax-k.ax)*(a.ax-k.ax) + (a.ay-k.ay)*(a.ay-k.ay) + (a.az-k.az)*(a.az-k.az) < 25.0
  UNION ALL
  SELECT l.assembly_id, po, co, 1, a.idx, k.idx FROM links l
  JOIN sockets a ON a.assembly_id = l.assembly_id AND a.owner = po
  JOIN studs k ON k.assembly_id = l.assembly_id AND k.owner = co
   AND (a.ax-k.ax)*(a.ax-k.ax) + (a.ay-k.ay)*(a.ay-k.ay) + (a.az-k.az)*(a.az-k.az) < 25.0),
best AS MATERIALIZED (
  SELECT * FROM near QUALIFY row_number() OVER (PARTITION BY assembly_id, po, co ORDER BY mode, pi, ci) = 1),
mem AS (SELECT p.assembly_id, p.part_index, pl.owner, p.x, p.y, p.z, p.c, p.s FROM p JOIN pl
  ON p.assembly_id = pl.assembly_id AND p.part_id = pl.part_id AND p.x = pl.x AND p.y = pl.y AND p.z = pl.z
  AND p.c = pl.c AND p.s = pl.s)
SELECT l.assembly_id, kid.part_index, par.part_index AS parent_index,
  CASE mode WHEN 0 THEN 'stud_' || pi WHEN 1 THEN 'socket_' || pi ELSE 'unknown' END AS parent_anchor,
  CASE mode WHEN 0 THEN 'socket_' || ci WHEN 1 THEN 'stud_' || ci ELSE 'unknown' END AS child_anchor,
  kid.x - par.x AS dx, kid.y - par.y AS dy, kid.z - par.z AS dz,
  par.c * kid.c + par.s * kid.s AS r00
FROM links l LEFT JOIN best USING (assembly_id, po, co)
JOIN mem kid ON kid.assembly_id = l.assembly_id AND kid.owner = co
JOIN mem par ON par.assembly_id = l.assembly_id AND par.owner = po
WHERE par.part_index < kid.part_index""")
def parent_connections(spark, sf):
    t = F.col("relative_transform")
    return spatial.parent_connections(placed_parts(spark, sf)).select(
        "assembly_id", "part_index", "parent_index", "parent_anchor", "child_anchor",
        t[3].alias("dx"), t[7].alias("dy"), t[11].alias("dz"), (t[0] + 0.0).alias("r00"),
    )


def _component_sql(source: str) -> str:
    """Least part index per component, on part level (not placements), by recursion."""
    return f"""WITH RECURSIVE {source}{PL_SQL}{ANCHOR_SQL}{CONTACT_SQL},
mem AS (SELECT p.*, pl.owner FROM p JOIN pl
  ON p.assembly_id = pl.assembly_id AND p.part_id = pl.part_id AND p.x = pl.x AND p.y = pl.y AND p.z = pl.z
  AND p.c = pl.c AND p.s = pl.s),
adj AS (
  SELECT assembly_id, part_a AS u, part_b AS v FROM touch
  UNION ALL SELECT assembly_id, part_b, part_a FROM touch),
reach AS (
  SELECT assembly_id, u AS node, u AS seen FROM adj
  UNION SELECT r.assembly_id, r.node, a.v FROM reach r JOIN adj a ON a.assembly_id = r.assembly_id AND a.u = r.seen),
lab AS (SELECT assembly_id, node, min(seen) AS label FROM reach GROUP BY ALL),
comp AS (
  SELECT mem.*, coalesce(lab.label, mem.part_index) AS label, y AS bottom
  FROM mem LEFT JOIN lab ON lab.assembly_id = mem.assembly_id AND lab.node = mem.owner)"""


SUBS_SQL = """
SELECT assembly_id, CAST(row_number() OVER (PARTITION BY assembly_id ORDER BY label) - 1 AS INTEGER) AS subassembly_id,
  count(*) AS parts_count, string_agg(DISTINCT part_id, ',' ORDER BY part_id) AS parts_list,
  bool_or(abs(y) <= 1) AS is_grounded
FROM comp GROUP BY assembly_id, label"""


def _subassembly_rows(subs):
    return subs.select(
        "assembly_id", "subassembly_id", "parts_count",
        F.array_join("parts_list", ",").alias("parts_list"), "is_grounded",
    )


@query("subassemblies", _component_sql(P_SQL) + SUBS_SQL)
def subassemblies(spark, sf):
    return _subassembly_rows(graph.subassemblies(placed_parts(spark, sf)))


@query("set_connectivity", _component_sql(STACK_SQL) + """
SELECT assembly_id, count(DISTINCT label) AS subassembly_count, count(DISTINCT label) = 1 AS fully_connected
FROM comp GROUP BY assembly_id""")
def set_connectivity(spark, sf):
    return graph.set_connectivity(graph.subassemblies(stacked_parts(spark, sf)))


GRAVITY_SQL = """,
fl AS (SELECT assembly_id, max(bottom) AS floor, max(y) AS low, count(*) FILTER (abs(y) <= 1) AS g
  FROM comp GROUP BY assembly_id),
anch AS (SELECT assembly_id, label, max(bottom) AS bottom FROM comp GROUP BY ALL),
grav AS (SELECT fl.assembly_id, low <= 1 AND g <= 4 AND bool_and(abs(bottom - floor) < 1) AS stable
  FROM fl JOIN anch USING (assembly_id) GROUP BY fl.assembly_id, low, g)"""


@query("gravity_check", _component_sql(STACK_SQL) + GRAVITY_SQL + " SELECT * FROM grav")
def gravity_check(spark, sf):
    return graph.gravity_check(stacked_parts(spark, sf))


COM_SQL = """,
tops AS (SELECT assembly_id, max(y) AS max_y FROM p GROUP BY assembly_id),
com AS (
  SELECT assembly_id,
    sum(w*h*d*x) / sum(w*h*d) BETWEEN min(x - w/2) FILTER (abs(y - max_y) <= 12) - 2
      AND max(x + w/2) FILTER (abs(y - max_y) <= 12) + 2
    AND sum(w*h*d*z) / sum(w*h*d) BETWEEN min(z - d/2) FILTER (abs(y - max_y) <= 12) - 2
      AND max(z + d/2) FILTER (abs(y - max_y) <= 12) + 2 AS com_stable
  FROM p JOIN tops USING (assembly_id) GROUP BY assembly_id)"""


@query("com_stable", f"WITH {P_SQL}{COM_SQL} SELECT * FROM com")
def com_stable(spark, sf):
    return metrics.com_stable(placed_parts(spark, sf))


INTERLOCK_SQL = """,
lev AS (SELECT *, CAST(round_even(y / 24, 0) AS INTEGER) * 24 AS lv FROM local),
hold AS (
  SELECT DISTINCT u.assembly_id, u.owner AS up, u.copies AS upc, k.owner AS dn, k.copies AS dnc
  FROM lev u JOIN lev k ON u.assembly_id = k.assembly_id AND k.lv = u.lv + 24
   AND pow(u.c*u.lx + u.s*u.lz + u.x - (k.c*k.lx + k.s*k.lz + k.x), 2) + pow(u.y - (k.y - k.h), 2)
     + pow(-u.s*u.lx + u.c*u.lz + u.z - (-k.s*k.lx + k.c*k.lz + k.z), 2) < 25.0),
il AS (SELECT assembly_id, sum(upc) AS score FROM
  (SELECT assembly_id, up, upc FROM hold GROUP BY ALL HAVING sum(dnc) >= 2) GROUP BY assembly_id),
inter AS (SELECT n.assembly_id, CASE WHEN n.n < 3 THEN 0.0::DOUBLE ELSE coalesce(score, 0)::DOUBLE END AS interlock
  FROM (SELECT assembly_id, count(*) AS n FROM p GROUP BY assembly_id) n LEFT JOIN il USING (assembly_id))"""


@query("interlock_score", f"WITH {P_SQL}{PL_SQL}{ANCHOR_SQL}{INTERLOCK_SQL} SELECT * FROM inter")
def interlock_score(spark, sf):
    return metrics.interlock_score(placed_parts(spark, sf))


@query("stability_reward", _component_sql(STACK_SQL) + GRAVITY_SQL + INTERLOCK_SQL + """
SELECT assembly_id, CASE WHEN NOT stable THEN -5.0::DOUBLE ELSE 10.0::DOUBLE + 5 * interlock END AS reward
FROM grav JOIN inter USING (assembly_id)""")
def stability_reward(spark, sf):
    return metrics.stability_reward(stacked_parts(spark, sf))


def _as_vehicles(parts):
    """Rename some vocabulary parts to wheel and cabin parts."""
    swap = {"3005.dat": "42610.dat", "3004.dat": "3139.dat", "3003.dat": "56902.dat", "3062b.dat": "3829.dat"}
    part = F.col("part_id")
    for old, new in swap.items():
        part = F.when(F.col("part_id") == old, new).otherwise(part)
    return parts.withColumn("part_id", part)


VEH_SQL = """,
v AS (SELECT *, CASE part_id WHEN '3005.dat' THEN '42610.dat' WHEN '3004.dat' THEN '3139.dat'
    WHEN '3003.dat' THEN '56902.dat' WHEN '3062b.dat' THEN '3829.dat' ELSE part_id END AS vid FROM p),
vk AS (SELECT *, vid IN ('42610.dat', '3139.dat', '56902.dat') AS wheel, vid = '3829.dat' AS cabin FROM v),
va AS (SELECT assembly_id, count(*) FILTER (wheel) AS wheel_count, count(*) FILTER (cabin) AS cabins,
    max(y) AS my, min(y) FILTER (wheel) AS wt, avg(y) FILTER (wheel) AS wa,
    max(y) FILTER (cabin) AS cl, max(abs(x)) FILTER (cabin) AS co FROM vk GROUP BY assembly_id),
vm AS (SELECT assembly_id, wheel_count, coalesce(abs(wt - my) <= 15, true) AS wheels_at_bottom,
    CASE WHEN wheel_count > 0 AND cabins > 0 THEN cl < wa - 8 ELSE true END AS cabin_height_valid,
    CASE WHEN wheel_count > 0 AND cabins > 0 THEN co <= 10 ELSE true END AS cabin_centered,
    cabins > 0 AS has_cabin_parts FROM va)"""
# lattice positions mirror exactly or not at all, so the greedy walk pairs equal counts
SYM_SQL = """,
vc AS (SELECT assembly_id, vid, x, y, z, count(*) AS n FROM v GROUP BY ALL),
vs AS (SELECT a.assembly_id, CAST(sum(CASE WHEN a.x = 0 THEN a.n ELSE least(a.n, coalesce(k.n, 0)) END) AS DOUBLE)
    / sum(a.n) AS symmetry_score
  FROM vc a LEFT JOIN vc k ON a.assembly_id = k.assembly_id AND a.vid = k.vid AND a.x = -k.x AND a.y = k.y AND a.z = k.z
  GROUP BY a.assembly_id)"""


@query("vehicle_metrics", f"WITH {P_SQL}{VEH_SQL}{SYM_SQL} SELECT vm.*, symmetry_score FROM vm JOIN vs USING (assembly_id)")
def vehicle_metrics(spark, sf):
    return metrics.vehicle_metrics(_as_vehicles(placed_parts(spark, sf)))


@query("symmetry_score", f"""WITH {P_SQL}{VEH_SQL}{SYM_SQL} SELECT assembly_id, symmetry_score FROM vs""")
def symmetry_score(spark, sf):
    return metrics.symmetry_score(_as_vehicles(placed_parts(spark, sf)))


@query("mirror_match", f"""WITH {P_SQL}{VEH_SQL}, rk AS (SELECT assembly_id, vid, x, y, z, part_index, row_number() OVER (PARTITION BY assembly_id, vid, x, y, z ORDER BY part_index) AS r FROM v)
SELECT a.assembly_id, a.part_index, k.part_index AS partner_index FROM rk a JOIN rk k ON a.assembly_id = k.assembly_id AND a.vid = k.vid AND a.x = -k.x AND a.y = k.y AND a.z = k.z AND a.r = k.r WHERE abs(a.x) >= 6""")
def mirror_match(spark, sf):
    """The partner of every mirrored part."""
    return mirror.mirror_partners(_as_vehicles(placed_parts(spark, sf)))


@query("mirror_exists", f"""WITH {P_SQL} SELECT a.assembly_id, a.part_index FROM p a WHERE abs(a.x) >= 6 AND EXISTS (
  SELECT 1 FROM p k WHERE k.assembly_id = a.assembly_id AND k.part_id = a.part_id AND k.part_index <> a.part_index
   AND abs(a.x + k.x) < 8 AND abs(a.y - k.y) < 5 AND abs(a.z - k.z) < 5)""")
def mirror_exists(spark, sf):
    return mirror.mirror_exists(placed_parts(spark, sf))


@query("vehicle_reward", _component_sql(STACK_SQL) + GRAVITY_SQL + VEH_SQL + SYM_SQL + """
SELECT assembly_id, CASE WHEN NOT stable THEN -10.0::DOUBLE ELSE 10.0::DOUBLE
  + CASE wheel_count WHEN 4 THEN 15 WHEN 2 THEN 4 ELSE -10 END
  + CASE WHEN wheel_count = 0 THEN 0 WHEN wheels_at_bottom THEN 5 ELSE -5 END
  + 10 * symmetry_score
  + CASE WHEN NOT has_cabin_parts THEN 0 WHEN cabin_height_valid AND cabin_centered THEN 5 ELSE -5 END END AS reward
FROM grav JOIN vm USING (assembly_id) JOIN vs USING (assembly_id)""")
def vehicle_reward(spark, sf):
    """Towers, with the footprint sizes of the original parts kept through equal-sized stand-ins."""
    parts = stacked_parts(spark, sf)
    renamed = _as_vehicles(parts)
    stable = graph.gravity_check(parts)
    return metrics.vehicle_reward(renamed, stable=stable)


RANGE_MEM = ORACLES["parent_connections"].split("\nSELECT l.assembly_id, kid.part_index")[0].replace(
    "SELECT p.assembly_id, p.part_index, pl.owner,", "SELECT p.assembly_id, p.part_index, pl.owner, row_number() OVER (PARTITION BY p.assembly_id, pl.owner ORDER BY p.part_index) - 1 AS rk,")
RANGE_SQL = RANGE_MEM + """,
counted AS MATERIALIZED (SELECT l.assembly_id, po, co, kid.part_index, kid.rk, count(*) AS n, any_value(kid.x - par.x) AS dx, any_value(kid.y - par.y) AS dy, any_value(kid.z - par.z) AS dz
  FROM links l JOIN mem kid ON kid.assembly_id = l.assembly_id AND kid.owner = co JOIN mem par ON par.assembly_id = l.assembly_id AND par.owner = po
  WHERE par.part_index < kid.part_index GROUP BY l.assembly_id, po, co, kid.part_index, kid.rk),
kids AS MATERIALIZED (SELECT counted.*, CASE mode WHEN 0 THEN 'stud_' || pi WHEN 1 THEN 'socket_' || pi ELSE 'unknown' END AS parent_anchor,
  CASE mode WHEN 0 THEN 'socket_' || ci WHEN 1 THEN 'stud_' || ci ELSE 'unknown' END AS child_anchor FROM counted LEFT JOIN best USING (assembly_id, po, co))"""


@query("connection_ranges", RANGE_SQL + """
SELECT assembly_id, po AS p, co AS c, min(rk) AS child_from, max(rk) AS child_to, n AS n_parents, parent_anchor, child_anchor, any_value(dx) AS dx, any_value(dy) AS dy, any_value(dz) AS dz
FROM kids GROUP BY assembly_id, po, co, n, parent_anchor, child_anchor""")
def connection_ranges(spark, sf):
    t = F.col("relative_transform")
    return spatial.connection_ranges(placed_parts(spark, sf)).select(
        "assembly_id", "p", "c", "child_from", "child_to", "n_parents", "parent_anchor", "child_anchor", t[3].alias("dx"), t[7].alias("dy"), t[11].alias("dz")
    )


BEST_SQL = ORACLES["parent_connections"].split(",\nmem AS")[0] + """
SELECT l.assembly_id, po AS p, co AS c, CASE mode WHEN 0 THEN 'stud_' || pi WHEN 1 THEN 'socket_' || pi ELSE 'unknown' END AS parent_anchor,
  CASE mode WHEN 0 THEN 'socket_' || ci WHEN 1 THEN 'stud_' || ci ELSE 'unknown' END AS child_anchor
FROM links l LEFT JOIN best USING (assembly_id, po, co)"""


@query("best_anchor", BEST_SQL)
def best_anchor(spark, sf):
    return spatial.best_anchor(placed_parts(spark, sf))
