"""Catalog, theme, report and merge queries."""

from __future__ import annotations

import re

from pyspark.sql import functions as F
from pyspark.sql import types as T

from brickloom.functions.prompts import CLASSIFY, ENRICH
from brickloom.operators import catalog as c
from brickloom.operators import reports as r
from brickloom.operators.metrics import vehicle_metrics
from brickloom.plans.assembly_queries import SYM_SQL, VEH_SQL, _as_vehicles
from brickloom.plans.bindings import P_SQL, placed_parts, table
from brickloom.plans.registry import ORACLES, query

# Input tables, in SQL that both engines read the same way; {name} is a test table.
SETS = """
SELECT CASE WHEN o_orderkey % 2 = 0 THEN o_orderkey || '-1' ELSE '' || o_orderkey END AS set_id,
  o_orderkey AS okey,
  'Set ' || o_orderkey || ' ' || lower(o_orderpriority) AS name,
  CASE WHEN o_orderkey % 17 = 0 THEN '' ELSE c_mktsegment END AS theme,
  CAST(year(o_orderdate) AS INT) AS year,
  CASE WHEN o_orderkey % 19 = 0 THEN NULL ELSE 'Built for ' || c_name END AS description,
  CASE o_orderkey % 3 WHEN 0 THEN 'OMR' WHEN 1 THEN 'BrickLink' ELSE 'Official' END AS source,
  CAST(CASE WHEN o_orderkey % 11 = 0 THEN NULL ELSE n END AS INT) AS parts_count,
  lower(c_mktsegment) || ', ,' || o_orderstatus || ',tag' || (o_orderkey % 7) || ',a,b, c,d,e,f,g' AS tags,
  CASE o_orderkey % 4 WHEN 0 THEN NULL WHEN 1 THEN '' ELSE 'https://img.example/' || o_orderkey || '.png' END AS image_url,
  CAST(CASE WHEN o_orderkey % 5 < 2 THEN NULL ELSE o_orderkey % 5 END AS INT) AS subassemblies_count,
  CAST(CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE o_orderkey % 2 END AS INT) AS is_fully_connected,
  CASE WHEN o_orderkey % 7 = 0 THEN NULL WHEN o_orderkey % 13 = 0 THEN 'Subterraneo'
    ELSE CASE o_orderkey % 4 WHEN 0 THEN 'Terrestre' WHEN 1 THEN 'Acuático' WHEN 2 THEN 'Aéreo' ELSE 'Espacial' END END AS level_1_entorno,
  CASE WHEN o_orderkey % 7 = 0 THEN NULL
    ELSE CASE o_orderkey % 3 WHEN 0 THEN 'Civil/Pasajeros' WHEN 1 THEN 'Carga/Comercial' ELSE 'Militar/Combate' END END AS level_2_proposito,
  CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE 'Clase_' || o_orderstatus END AS level_3_clase,
  CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE CASE o_orderkey % 2 WHEN 0 THEN 'Microscale' ELSE 'Minifig-scale' END END AS level_4_escala,
  CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE CASE o_orderkey % 5 WHEN 0 THEN 'Estatico' ELSE 'Motorizado' END END AS level_4_motorizacion,
  CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE c_mktsegment END AS level_4_licencia,
  CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE CAST(o_orderkey % 101 AS DOUBLE) / 100 END AS confidence_score
FROM {orders} JOIN {customer} ON c_custkey = o_custkey
LEFT JOIN (SELECT l_orderkey, count(*) AS n FROM {lineitem} GROUP BY l_orderkey) q ON l_orderkey = o_orderkey"""
RB_SETS = """
SELECT c_custkey || '-1' AS set_num, c_name AS name, CAST(1990 + c_custkey % 30 AS INT) AS year,
  CAST(100 + c_nationkey AS INT) AS theme_id, CAST(c_custkey % 900 AS INT) AS num_parts,
  'https://rb.example/' || c_custkey || '.jpg' AS img_url FROM {customer}"""
THEMES = """
SELECT CAST(1 + r_regionkey AS INT) AS id, r_name AS name, CAST(NULL AS INT) AS parent_id FROM {region}
UNION ALL SELECT CAST(100 + n_nationkey AS INT), n_name, CAST(1 + n_regionkey AS INT) FROM {nation}"""
INVENTORIES = "SELECT o_orderkey AS id, 1 AS version, o_custkey || '-1' AS set_num FROM {orders}"
INV_PARTS = """SELECT l_orderkey AS inventory_id, '' || l_partkey AS part_num,
  CAST(l_suppkey % 16 AS INT) AS color_id, CAST(l_quantity AS INT) AS quantity FROM {lineitem}"""
PARTS = "SELECT '' || p_partkey AS part_num, p_name AS name FROM {part}"
ENRICHED = "SELECT '' || (p_partkey * 3) AS part_num FROM {part}"
INVENTORY = """SELECT CASE WHEN l_orderkey % 2 = 0 THEN l_orderkey || '-1' ELSE '' || l_orderkey END AS set_id,
  l_partkey || '.dat' AS part_id, CAST(l_suppkey % 16 AS INT) AS color, count(*) AS quantity
  FROM {lineitem} GROUP BY l_orderkey, l_partkey, l_suppkey % 16"""
IMAGES = """SELECT CASE WHEN o_orderkey % 2 = 0 THEN o_orderkey || '-1' ELSE '' || o_orderkey END AS set_id,
  l_linenumber AS image_no, 'https://img.example/' || l_partkey || '.png' AS image_url
  FROM {lineitem} JOIN {orders} ON o_orderkey = l_orderkey * 2"""


def bind(spark, sf, sql):
    names = set(re.findall(r"\{(\w+)\}", sql))
    return spark.sql(sql, **{n: table(spark, sf, n) for n in names})


def duck(**views):
    body = ",\n".join(f"{name} AS (" + re.sub(r"\{(\w+)\}", r"\1", sql) + ")" for name, sql in views.items())
    return f"WITH {body}\n"


def rb(spark, sf):
    return [bind(spark, sf, s) for s in (INV_PARTS, INVENTORIES, RB_SETS, THEMES)]


RB_DUCK = duck(ip=INV_PARTS, iv=INVENTORIES, rs=RB_SETS, th=THEMES, pt=PARTS, en=ENRICHED)
S_DUCK = duck(s=SETS, rs=RB_SETS, th=THEMES)


@query("inventory_counts", f"""WITH {P_SQL} SELECT assembly_id, lower(part_id) AS part_id, color, count(*) AS quantity
FROM p GROUP BY ALL""")
def inventory_counts(spark, sf):
    return c.inventory_counts(placed_parts(spark, sf))


@query("inventory_join", duck(s=SETS, i=INVENTORY) + """SELECT s.set_id, name, part_id, color, quantity
FROM s JOIN i USING (set_id) WHERE part_id = '7.dat'""")
def inventory_join(spark, sf):
    return c.inventory_join(bind(spark, sf, SETS).select("set_id", "name"), bind(spark, sf, INVENTORY), "7.DAT")


@query("catalog_search", duck(s=SETS, i=INVENTORY) + """SELECT DISTINCT s.set_id, name, theme, parts_count, source
FROM s JOIN i ON i.set_id = s.set_id WHERE theme ILIKE '%build%' AND (name ILIKE '%set 1%' OR description ILIKE '%set 1%')
AND parts_count >= 2 AND parts_count <= 6 AND part_id = '11.dat'
UNION ALL SELECT DISTINCT set_id, name, theme, parts_count, source FROM s
WHERE theme ILIKE '%mach%' AND parts_count >= 5""")
def catalog_search(spark, sf):
    sets, inv = bind(spark, sf, SETS), bind(spark, sf, INVENTORY)
    narrow = c.catalog_search(sets, inv, part="11.dat", theme="build", keyword="set 1", min_parts=2, max_parts=6)
    return narrow.unionByName(c.catalog_search(sets, theme="mach", min_parts=5))


@query("search_top30", S_DUCK + """SELECT DISTINCT set_id, name, theme, parts_count, source FROM s
WHERE theme ILIKE '%auto%' AND parts_count IS NOT NULL ORDER BY parts_count DESC, set_id LIMIT 30""")
def search_top30(spark, sf):
    found = c.catalog_search(bind(spark, sf, SETS), theme="auto", min_parts=0)
    return c.search_top(found)


@query("top_inventory", duck(i=INVENTORY) + """SELECT set_id, part_id, color, quantity, CAST(rk AS INTEGER) AS rank, kinds,
  greatest(kinds - 3, 0) AS overflow FROM (SELECT *, count(*) OVER (PARTITION BY set_id) AS kinds,
  row_number() OVER (PARTITION BY set_id ORDER BY quantity DESC, part_id, color) AS rk FROM i) WHERE rk <= 3""")
def top_inventory(spark, sf):
    """Three rows per set instead of 25, since the test orders are small."""
    return c.top_inventory(bind(spark, sf, INVENTORY), 3)


@query("pending_classification", S_DUCK + """SELECT set_id, source FROM (
  SELECT * FROM (SELECT set_id, source, 0 AS p FROM s WHERE source IN ('OMR', 'BrickLink') AND level_1_entorno IS NULL
    ORDER BY set_id LIMIT 2000)
  UNION ALL SELECT * FROM (SELECT set_num, 'Official', 1 FROM rs LEFT JOIN s ON set_num = set_id
    WHERE level_1_entorno IS NULL ORDER BY set_num LIMIT 2000)) ORDER BY p, set_id LIMIT 2000""")
def pending_classification(spark, sf):
    return c.pending_classification(bind(spark, sf, SETS), bind(spark, sf, RB_SETS), ["OMR", "BrickLink"], 2000)


@query("pending_by_null", S_DUCK + """SELECT set_id, name FROM s
WHERE source = 'BrickLink' AND (image_url IS NULL OR image_url = '')""")
def pending_by_null(spark, sf):
    return c.pending_by_null(bind(spark, sf, SETS), "image_url", "BrickLink").select("set_id", "name")


@query("union_sources", S_DUCK + """SELECT set_id, source FROM s WHERE source <> 'Official'
UNION ALL SELECT set_num, 'Official' FROM rs""")
def union_sources(spark, sf):
    sets = bind(spark, sf, SETS).select("set_id", "source")
    official = bind(spark, sf, RB_SETS).select(F.col("set_num").alias("set_id"), F.lit("Official").alias("source"))
    return c.union_sources([sets.filter("source = 'OMR'"), sets.filter("source = 'BrickLink'"), official])


@query("set_theme_lookup", S_DUCK + """, m AS (SELECT s.set_id, rs.*, th.name AS theme_name,
  row_number() OVER (PARTITION BY s.set_id ORDER BY rs.set_num <> s.set_id, rs.set_num) AS rk
  FROM s JOIN rs ON rs.set_num = s.set_id OR rs.set_num = s.set_id || '-1' LEFT JOIN th ON th.id = theme_id)
SELECT set_id, set_num, name, year, theme_name, num_parts, img_url FROM m WHERE rk = 1""")
def set_theme_lookup(spark, sf):
    return c.set_theme_lookup(*[bind(spark, sf, q) for q in (SETS, RB_SETS, THEMES)])


@query("theme_chain", RB_DUCK + """SELECT th.name AS theme, ip.part_num, count(*) AS n FROM ip JOIN iv ON iv.id = inventory_id
JOIN rs ON rs.set_num = iv.set_num JOIN th ON th.id = theme_id GROUP BY ALL""")
def theme_chain(spark, sf):
    return c.theme_chain(*rb(spark, sf)).groupBy("theme", "part_num").agg(F.count(F.lit(1)).alias("n"))


@query("unenriched_parts", RB_DUCK + """SELECT pt.part_num, pt.name FROM pt LEFT JOIN en ON en.part_num = pt.part_num
WHERE en.part_num IS NULL""")
def unenriched_parts(spark, sf):
    return c.unenriched_parts(bind(spark, sf, PARTS), bind(spark, sf, ENRICHED))


@query("enrichment_backlog", RB_DUCK + """SELECT pt.part_num, pt.name,
  max(CASE WHEN th.name LIKE '%_1' OR th.name LIKE '%_7%' THEN 1 ELSE 0 END) AS is_priority
FROM pt LEFT JOIN ip ON ip.part_num = pt.part_num LEFT JOIN iv ON iv.id = inventory_id
LEFT JOIN rs ON rs.set_num = iv.set_num LEFT JOIN th ON th.id = theme_id LEFT JOIN en ON en.part_num = pt.part_num
WHERE en.part_num IS NULL GROUP BY pt.part_num, pt.name""".replace("'%_1' OR th.name LIKE '%_7%'", "'%NATION#_7%' ESCAPE '#' OR th.name LIKE '%NATION#_12%' ESCAPE '#'"))
def enrichment_backlog(spark, sf):
    words = [r"nation\_7", r"nation\_12"]
    return c.enrichment_backlog(bind(spark, sf, PARTS), *rb(spark, sf), bind(spark, sf, ENRICHED), words)


@query("coverage_status", RB_DUCK + """, d AS (SELECT DISTINCT ip.part_num FROM ip JOIN iv ON iv.id = inventory_id
JOIN rs ON rs.set_num = iv.set_num JOIN th ON th.id = theme_id WHERE th.name LIKE '%NATION%3')
SELECT count(*) AS total, count(en.part_num) AS enriched,
  CASE WHEN count(*) > 0 THEN count(en.part_num) / count(*) * 100 ELSE 0 END AS percentage
FROM d LEFT JOIN en ON en.part_num = d.part_num""".replace("LIKE '%NATION%3'", "ILIKE '%tion#_3%' ESCAPE '#'"))
def coverage_status(spark, sf):
    return c.coverage_status(*rb(spark, sf), bind(spark, sf, ENRICHED), [r"tion\_3"])


DESCRIBED = [("NATION_1", "First nation."), ("NATION_2", "Second nation.")]


@query("dominant_theme", RB_DUCK + f""", n AS (SELECT ip.part_num, th.name AS theme, count(*) AS n FROM ip JOIN iv ON iv.id = inventory_id
JOIN rs ON rs.set_num = iv.set_num JOIN th ON th.id = theme_id GROUP BY ALL),
b AS (SELECT * FROM n QUALIFY row_number() OVER (PARTITION BY part_num ORDER BY n DESC, theme) = 1)
SELECT pt.part_num, coalesce(theme, '{c.NO_THEME}') AS theme, CASE WHEN theme IS NULL THEN '{c.NO_THEME_TEXT}'
  WHEN theme = 'NATION_1' THEN 'First nation.' WHEN theme = 'NATION_2' THEN 'Second nation.'
  ELSE replace('{c.ANY_THEME_TEXT.replace("'", "''")}', '%s', theme) END AS description
FROM pt LEFT JOIN b ON b.part_num = pt.part_num""")
def dominant_theme(spark, sf):
    from brickloom.lookups import inline_table

    described = inline_table(spark, ["theme", "description"], DESCRIBED)
    return c.dominant_theme(bind(spark, sf, PARTS), *rb(spark, sf), described)


def _request_sql():
    text = ENRICH.replace("'", "''")
    for name in ("part_num", "name", "theme", "description"):
        text = text.replace(f"<{name}>", f"' || {name} || '")
    return f"SELECT part_num, '{text}' AS prompt FROM ({ORACLES['dominant_theme']}) JOIN (SELECT '' || p_partkey AS pn, p_name AS name FROM part) ON pn = part_num"


@query("enrichment_prompts", _request_sql())
def enrichment_prompts(spark, sf):
    """Every part's request, with its dominant theme."""
    return r.enrichment_prompts(bind(spark, sf, PARTS), dominant_theme(spark, sf))


@query("theme_root", "WITH RECURSIVE " + RB_DUCK[5:] + """, up AS (SELECT id, name, id AS at, name AS root, parent_id FROM th
UNION ALL SELECT up.id, up.name, th.id, th.name, th.parent_id FROM up JOIN th ON th.id = up.parent_id),
roots AS (SELECT id, name, root FROM up WHERE parent_id IS NULL)
SELECT id, name, root FROM roots""")
def theme_root(spark, sf):
    return c.theme_root(bind(spark, sf, THEMES))


@query("present_roots", "WITH RECURSIVE " + S_DUCK[5:] + """, up AS (SELECT id, id AS at, name AS root, parent_id FROM th
UNION ALL SELECT up.id, th.id, th.name, th.parent_id FROM up JOIN th ON th.id = up.parent_id)
SELECT DISTINCT root AS theme FROM s JOIN rs ON rs.set_num = s.set_id OR rs.set_num = s.set_id || '-1'
JOIN up ON up.id = theme_id WHERE parent_id IS NULL""")
def present_roots(spark, sf):
    names = bind(spark, sf, SETS).select(F.col("set_id").alias("set_name"))
    return c.present_roots(names, bind(spark, sf, RB_SETS), c.theme_root(bind(spark, sf, THEMES)))


# --- merges ---------------------------------------------------------------------------------------

BASE = """SELECT '' || o_orderkey AS set_id, 'Base ' || o_orderstatus AS name, o_orderpriority AS theme,
  CAST(CASE WHEN o_orderkey % 4 = 0 THEN NULL ELSE o_orderkey % 6 END AS INT) AS subassemblies_count,
  CAST(CASE WHEN o_orderkey % 8 = 0 THEN NULL ELSE 1 END AS INT) AS is_fully_connected,
  'local' AS note FROM {orders}"""
INCOMING = """SELECT '' || (o_orderkey * 2) AS set_id, 'New ' || o_orderstatus AS name,
  CAST(CASE WHEN o_orderkey % 9 = 0 THEN NULL ELSE o_orderkey % 5 END AS INT) AS subassemblies_count,
  CAST(CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE 0 END AS INT) AS is_fully_connected,
  o_orderkey AS extra FROM {orders}"""
MULTI = """SELECT '' || ((o_orderkey - o_orderkey % 2) * 3) AS set_id, 'Row ' || o_orderkey AS name, o_orderkey AS seq
  FROM {orders}"""
M_DUCK = duck(b=BASE, n=INCOMING, m=MULTI)


@query("catalog_replace", M_DUCK + """, lw AS (SELECT * FROM m QUALIFY row_number() OVER (PARTITION BY set_id ORDER BY seq DESC) = 1)
SELECT set_id, name, theme, subassemblies_count, is_fully_connected, note FROM b WHERE set_id NOT IN (SELECT set_id FROM m)
UNION ALL SELECT set_id, name, NULL, NULL, NULL, NULL FROM lw""")
def catalog_replace(spark, sf):
    return c.catalog_replace(bind(spark, sf, BASE), bind(spark, sf, MULTI), ["set_id"], ["seq"])


@query("catalog_insert_ignore", M_DUCK + """, fw AS (SELECT * FROM m QUALIFY row_number() OVER (PARTITION BY set_id ORDER BY seq) = 1)
SELECT * FROM b UNION ALL SELECT set_id, name, NULL, NULL, NULL, NULL FROM fw WHERE set_id NOT IN (SELECT set_id FROM b)""")
def catalog_insert_ignore(spark, sf):
    return c.catalog_insert_ignore(bind(spark, sf, BASE), bind(spark, sf, MULTI), ["set_id"], ["seq"])


@query("catalog_add_columns", M_DUCK + """SELECT *, CAST(NULL AS VARCHAR) AS source_url, CAST(NULL AS DOUBLE) AS confidence_score FROM b""")
def catalog_add_columns(spark, sf):
    schema = T.StructType().add("note", "string").add("source_url", "string").add("confidence_score", "double")
    return c.catalog_add_columns(bind(spark, sf, BASE), schema)


RESULTS = """SELECT CASE WHEN o_orderkey % 4 = 0 THEN (o_orderkey * 3) || '-1' ELSE '' || (o_orderkey * 3) END AS set_id,
  'L1' AS level_1_entorno, o_orderstatus AS level_2_proposito, o_orderpriority AS level_3_clase, 'E' AS level_4_escala,
  'M' AS level_4_motorizacion, 'L' AS level_4_licencia, CAST(o_orderkey % 10 AS DOUBLE) / 10 AS confidence_score,
  'why ' || o_orderkey AS reasoning_notes, CAST(o_orderkey % 2 AS INT) AS needs_human_review,
  CAST(NULL AS STRING) AS review_table_payload FROM {orders}"""


@query("catalog_update_columns", duck(s=SETS, rs=RB_SETS, x=RESULTS) + """
SELECT s.set_id, s.name, s.source, s.theme, s.year, s.image_url, s.parts_count,
  CASE WHEN x.set_id IS NOT NULL THEN x.level_1_entorno ELSE s.level_1_entorno END AS level_1_entorno,
  CASE WHEN x.set_id IS NOT NULL THEN x.level_3_clase ELSE s.level_3_clase END AS level_3_clase,
  CASE WHEN x.set_id IS NOT NULL THEN x.confidence_score ELSE s.confidence_score END AS confidence_score,
  x.reasoning_notes, x.needs_human_review
FROM s LEFT JOIN x ON x.set_id = s.set_id
UNION ALL SELECT x.set_id, coalesce(rs.name, x.set_id), 'Official', NULL, rs.year, img_url, coalesce(num_parts, 0),
  x.level_1_entorno, x.level_3_clase, x.confidence_score, x.reasoning_notes, x.needs_human_review
FROM x LEFT JOIN rs ON rs.set_num = x.set_id WHERE x.set_id NOT IN (SELECT set_id FROM s)""")
def catalog_update_columns(spark, sf):
    sets = bind(spark, sf, SETS)
    extra = T.StructType().add("reasoning_notes", "string").add("needs_human_review", "integer").add("review_table_payload", "string")
    out = c.catalog_update_columns(c.catalog_add_columns(sets, extra), bind(spark, sf, RESULTS), bind(spark, sf, RB_SETS))
    return out.select("set_id", "name", "source", "theme", "year", "image_url", "parts_count", "level_1_entorno",
                      "level_3_clase", "confidence_score", "reasoning_notes", "needs_human_review")


FILL = ["subassemblies_count", "is_fully_connected"]
MERGED_SQL = """, ms AS (SELECT coalesce(b.set_id, n.set_id) AS set_id,
  CASE WHEN b.set_id IS NULL THEN n.name ELSE b.name END AS name, b.theme,
  coalesce(b.subassemblies_count, n.subassemblies_count) AS subassemblies_count,
  coalesce(b.is_fully_connected, n.is_fully_connected) AS is_fully_connected, b.note,
  CASE WHEN b.set_id IS NULL THEN 'inserted'
    WHEN (b.subassemblies_count IS NULL AND n.subassemblies_count IS NOT NULL)
      OR (b.is_fully_connected IS NULL AND n.is_fully_connected IS NOT NULL) THEN 'updated' ELSE 'kept' END AS action
FROM b FULL JOIN n ON n.set_id = b.set_id)"""


@query("merge_sets", M_DUCK + MERGED_SQL + " SELECT * FROM ms")
def merge_sets(spark, sf):
    return c.merge_sets(bind(spark, sf, BASE), bind(spark, sf, INCOMING), FILL)


INV_B = INVENTORY
INV_N = ("SELECT set_id, part_id, CASE WHEN color < 8 THEN color ELSE color + 16 END AS color, "
         "quantity + 100 AS quantity FROM (" + INVENTORY + ") q")
INV_MERGED = """, mi AS (SELECT set_id, part_id, color, quantity, 'kept' AS action FROM ib
UNION ALL SELECT set_id, part_id, color, quantity, 'inserted' FROM inn
WHERE NOT EXISTS (SELECT 1 FROM ib WHERE ib.set_id = inn.set_id AND ib.part_id = inn.part_id AND ib.color = inn.color))"""


@query("merge_insert_missing", duck(ib=INV_B, inn=INV_N) + INV_MERGED + " SELECT * FROM mi")
def merge_insert_missing(spark, sf):
    return c.merge_insert_missing(bind(spark, sf, INV_B), bind(spark, sf, INV_N), ["set_id", "part_id", "color"])


QUEUE_B = """SELECT 'm' || o_orderkey AS model_id,
  CASE o_orderkey % 4 WHEN 0 THEN 'completed' WHEN 1 THEN 'failed' ELSE 'pending' END AS status,
  CAST(o_orderkey % 5 AS INT) AS attempts, 't' || o_orderkey AS last_attempt_time,
  CASE WHEN o_orderkey % 4 = 1 THEN 'boom' END AS error_msg FROM {orders}"""
QUEUE_N = """SELECT 'm' || (o_orderkey * 2) AS model_id,
  CASE o_orderkey % 3 WHEN 0 THEN 'completed' WHEN 1 THEN 'failed' ELSE 'downloading' END AS status,
  CAST(o_orderkey % 7 AS INT) AS attempts, 'u' || o_orderkey AS last_attempt_time,
  CASE WHEN o_orderkey % 3 = 1 THEN 'late' END AS error_msg FROM {orders}"""
QUEUE_MERGED = """, up AS (SELECT coalesce(qb.model_id, qn.model_id) AS model_id, qb.model_id IS NULL AS ins,
  coalesce(qn.status IN ('completed', 'failed') AND qb.status = 'pending' OR qn.attempts > qb.attempts, false) AS upd,
  qb.status AS bs, qb.attempts AS ba, qb.last_attempt_time AS bt, qb.error_msg AS be, qn.* EXCLUDE (model_id)
  FROM qb FULL JOIN qn ON qn.model_id = qb.model_id),
mq AS (SELECT model_id, CASE WHEN ins OR upd THEN status ELSE bs END AS status,
  CASE WHEN ins OR upd THEN attempts ELSE ba END AS attempts,
  CASE WHEN ins OR upd THEN last_attempt_time ELSE bt END AS last_attempt_time,
  CASE WHEN ins OR upd THEN error_msg ELSE be END AS error_msg,
  CASE WHEN ins THEN 'inserted' WHEN upd THEN 'updated' ELSE 'kept' END AS action FROM up)"""


@query("merge_queue", duck(qb=QUEUE_B, qn=QUEUE_N) + QUEUE_MERGED + " SELECT * FROM mq")
def merge_queue(spark, sf):
    return c.merge_queue(bind(spark, sf, QUEUE_B), bind(spark, sf, QUEUE_N))


@query("merge_stats", duck(b=BASE, n=INCOMING, ib=INV_B, inn=INV_N, qb=QUEUE_B, qn=QUEUE_N) + MERGED_SQL + INV_MERGED + QUEUE_MERGED + """
SELECT 'sets' AS table_name, count(*) FILTER (action = 'inserted') AS inserted, count(*) FILTER (action = 'updated') AS updated FROM ms
UNION ALL SELECT 'parts_inventory', count(*) FILTER (action = 'inserted'), count(*) FILTER (action = 'updated') FROM mi
UNION ALL SELECT 'bricklink_scraping_queue', count(*) FILTER (action = 'inserted'), count(*) FILTER (action = 'updated') FROM mq""")
def merge_stats(spark, sf):
    return c.merge_stats({
        "sets": merge_sets(spark, sf),
        "parts_inventory": merge_insert_missing(spark, sf),
        "bricklink_scraping_queue": merge_queue(spark, sf),
    })


@query("catalog_json_merge", M_DUCK + """SELECT set_id, name FROM b WHERE set_id NOT IN (SELECT set_id FROM n)
UNION ALL SELECT set_id, name FROM n""")
def catalog_json_merge(spark, sf):
    old, new = (bind(spark, sf, q).select("set_id", "name") for q in (BASE, INCOMING))
    return c.catalog_json_merge(old, new, "set_id")


@query("next_pending", duck(qb=QUEUE_B) + "SELECT * FROM qb WHERE status = 'pending' ORDER BY model_id LIMIT 50")
def next_pending(spark, sf):
    return c.next_pending(bind(spark, sf, QUEUE_B), 50)


# --- reports --------------------------------------------------------------------------------------

LEVEL_COUNTS = " UNION ALL ".join(
    f"SELECT '{t}' AS level, {t} AS value, count(*) AS n FROM s WHERE {t} IS NOT NULL GROUP BY {t}" for t in c.TAXONOMY
)


@query("taxonomy_counts", S_DUCK + LEVEL_COUNTS)
def taxonomy_counts(spark, sf):
    return r.taxonomy_counts(bind(spark, sf, SETS))


@query("taxonomy_cross", S_DUCK + """SELECT level_1_entorno, level_2_proposito, count(*) AS n FROM s
WHERE level_1_entorno IS NOT NULL AND level_2_proposito IS NOT NULL GROUP BY ALL""")
def taxonomy_cross(spark, sf):
    return r.taxonomy_cross(bind(spark, sf, SETS))


@query("schema_domain_counts", S_DUCK + f""", dom(level, value) AS (VALUES {", ".join(f"('{k}', '{v}')" for k, vs in r.DOMAINS.items() for v in vs)}),
cnt AS ({LEVEL_COUNTS})
SELECT coalesce(dom.level, cnt.level) AS level, coalesce(dom.value, cnt.value) AS value, coalesce(n, 0) AS n,
  CASE WHEN dom.value IS NOT NULL THEN 'schema' ELSE 'dynamic' END AS kind
FROM dom FULL JOIN (SELECT * FROM cnt WHERE level IN (SELECT level FROM dom)) cnt ON cnt.level = dom.level AND cnt.value = dom.value""")
def schema_domain_counts(spark, sf):
    return r.schema_domain_counts(bind(spark, sf, SETS))


@query("report_rows", S_DUCK + """SELECT s.set_id, s.name, s.theme, s.source, coalesce(s.parts_count, num_parts, 0) AS parts_count,
  level_1_entorno, level_2_proposito, confidence_score FROM s LEFT JOIN rs ON set_num = set_id WHERE level_1_entorno IS NOT NULL""")
def report_rows(spark, sf):
    return r.report_rows(bind(spark, sf, SETS), bind(spark, sf, RB_SETS))


LISTED = """, li AS (SELECT set_id, image_url, CAST(row_number() OVER (PARTITION BY set_id ORDER BY image_no, image_url) - 1 AS INTEGER) AS position FROM im)"""


@query("set_image_lists", duck(s=SETS, im=IMAGES) + LISTED + " SELECT s.set_id, li.image_url, position FROM s LEFT JOIN li ON li.set_id = s.set_id")
def set_image_lists(spark, sf):
    return r.set_image_lists(bind(spark, sf, SETS), bind(spark, sf, IMAGES))


@query("image_fallback", duck(s=SETS, im=IMAGES) + LISTED + f""" SELECT s.set_id, coalesce(position, 0) AS position,
  coalesce(li.image_url, nullif(s.image_url, ''), '{r.PLACEHOLDER}') AS image_url FROM s LEFT JOIN li ON li.set_id = s.set_id""")
def image_fallback(spark, sf):
    return r.image_fallback(bind(spark, sf, SETS), bind(spark, sf, IMAGES))


@query("confidence_band", S_DUCK + """SELECT set_id, confidence_score <= 0.8 AS needs_review,
  CAST(floor(confidence_score * 100) AS INTEGER) AS percent,
  CASE WHEN confidence_score > 0.8 THEN 'high' WHEN confidence_score > 0.5 THEN 'medium' ELSE 'low' END AS band,
  CASE WHEN confidence_score <= 0.8 THEN CAST(floor(confidence_score * 100) AS INTEGER) || '%' END AS score
FROM s WHERE confidence_score IS NOT NULL""")
def confidence_band(spark, sf):
    conf = F.col("confidence_score")
    payload = r.review_payload(*[F.col(x) for x in ("name", "source", "confidence_score", *c.TAXONOMY[:3], "name")])
    return bind(spark, sf, SETS).filter(conf.isNotNull()).select(
        "set_id", r.needs_review(conf).alias("needs_review"), r.percent(conf).alias("percent"),
        r.confidence_band(conf).alias("band"), payload["score"].alias("score"),
    )


@query("tag_list", S_DUCK + """SELECT set_id, array_to_string([trim(x) for x in string_split(tags, ',') if trim(x) <> ''][1:8], '|') AS tags FROM s""")
def tag_list(spark, sf):
    return bind(spark, sf, SETS).select("set_id", F.array_join(r.tag_list(F.col("tags")), "|").alias("tags"))


RESPONSES = """SELECT 'p' || p_partkey AS set_id, 'OMR' AS source, p_name AS name,
  CASE WHEN p_partkey % 11 = 0 THEN '{{broken' ELSE
  '{{"taxonomy_proposal": {{"Level_1_Entorno": "' || CASE p_partkey % 4 WHEN 0 THEN 'Terrestre' WHEN 1 THEN 'Espacial' WHEN 2 THEN 'Multientorno' ELSE 'Lunar' END ||
  '", "Level_2_Proposito": "' || CASE p_partkey % 5 WHEN 0 THEN 'Nada' ELSE 'Civil/Pasajeros' END ||
  '", "Level_3_Clase": "' || p_type || '"' || CASE WHEN p_partkey % 13 = 0 THEN '' ELSE ', "Level_4_Escala": "Microscale"' END ||
  ', "Level_4_Motorizacion": "Pull-back", "Level_4_Licencia": "' || p_brand || '"}}' ||
  CASE WHEN p_partkey % 3 = 0 THEN '' WHEN p_partkey % 17 = 0 THEN ', "confidence_score": "high"' ELSE ', "confidence_score": 0.' || (p_partkey % 90 + 10) END ||
  CASE WHEN p_partkey % 2 = 0 THEN '' ELSE ', "reasoning_notes": "size ' || p_size || '"' END || '}}' END AS response FROM {part}"""


@query("validate_taxonomy", "WITH x AS (" + RESPONSES.replace("{{", "{").replace("}}", "}").replace("{part}", "part") + """),
ok AS (SELECT *, CASE WHEN json_valid(response) THEN response END AS j FROM x),
f AS (SELECT set_id, source, name, j->'taxonomy_proposal' AS t, j->>'confidence_score' AS cs, j->>'reasoning_notes' AS rn FROM ok),
g AS (SELECT *, coalesce(t->>'Level_1_Entorno' IN ('Terrestre', 'Acuático', 'Aéreo', 'Espacial', 'Multientorno')
  AND t->>'Level_2_Proposito' IN ('Civil/Pasajeros', 'Carga/Comercial', 'Emergencias/Servicios', 'Construccion/Industrial', 'Competicion/Deportes', 'Militar/Combate', 'Ficcion/Fantasia')
  AND t->>'Level_4_Escala' IN ('Microscale', 'Minifig-scale', 'UCS/Gran Escala') AND (t->>'Level_3_Clase') IS NOT NULL
  AND t->>'Level_4_Motorizacion' IN ('Estatico', 'Ruedas Libres', 'Pull-back', 'Motorizado')
  AND (t->>'Level_4_Licencia') IS NOT NULL AND (cs IS NULL OR TRY_CAST(cs AS DOUBLE) IS NOT NULL), false) AS good FROM f),
h AS (SELECT set_id, source, name, CASE WHEN good THEN t->>'Level_1_Entorno' ELSE 'Terrestre' END AS level_1_entorno,
  CASE WHEN good THEN t->>'Level_2_Proposito' ELSE 'Civil/Pasajeros' END AS level_2_proposito,
  CASE WHEN good THEN t->>'Level_3_Clase' ELSE 'Desconocido' END AS level_3_clase,
  CASE WHEN good THEN t->>'Level_4_Licencia' ELSE 'Genérico' END AS level_4_licencia,
  CASE WHEN good THEN coalesce(CAST(cs AS DOUBLE), 0.5) ELSE 0.1 END::DOUBLE AS confidence_score,
  CASE WHEN good THEN coalesce(rn, 'No notes provided.') ELSE 'Inference failure' END AS reasoning_notes FROM g)
SELECT *, CAST(confidence_score <= 0.8 AS INTEGER) AS needs_human_review, confidence_score <= 0.8 AS has_payload FROM h""")
def validate_taxonomy(spark, sf):
    out = r.validate_taxonomy(bind_raw(spark, sf, RESPONSES))
    return out.withColumn("has_payload", F.col("review_table_payload").isNotNull()).drop(
        "level_4_escala", "level_4_motorizacion", "review_table_payload"
    )


def bind_raw(spark, sf, sql):
    """Binding whose text holds doubled braces."""
    return spark.sql(sql, part=table(spark, sf, "part"))


META_SQL = S_DUCK.replace("s AS (", "s AS MATERIALIZED (", 1) + f""", {P_SQL}{VEH_SQL}{SYM_SQL},
geo AS (SELECT assembly_id, n, wheel_count, symmetry_score FROM vm JOIN vs USING (assembly_id)
  JOIN (SELECT assembly_id, count(*) AS n FROM p GROUP BY ALL) USING (assembly_id)),
md AS (SELECT set_id, name, coalesce(nullif(theme, ''), CASE source WHEN 'BrickLink' THEN 'Studio MOC' ELSE 'Unknown' END) AS theme, year,
  coalesce(description, '') AS description, CASE WHEN coalesce(parts_count, 0) = 0 THEN coalesce(n, 0) ELSE parts_count END AS parts_count,
  coalesce(tags, '') AS tags, image_url, source, wheel_count, symmetry_score
  FROM s LEFT JOIN geo ON assembly_id = okey WHERE source IN ('BrickLink', 'OMR')
UNION ALL SELECT set_num, rs.name, coalesce(th.name, 'Unknown'), year, 'Official LEGO Set ' || set_num || ': ' || rs.name || ' under theme ' || th.name || '.',
  num_parts, '', img_url, 'Official', NULL, NULL FROM rs LEFT JOIN th ON th.id = theme_id)
"""


def _metadata(spark, sf):
    parts = placed_parts(spark, sf)
    sizes = parts.groupBy("assembly_id").agg(F.count(F.lit(1)).alias("n_parts"))
    geometry = vehicle_metrics(_as_vehicles(parts)).join(sizes, "assembly_id")
    sets = bind(spark, sf, SETS)
    geometry = geometry.join(sets.select("set_id", F.col("okey").alias("assembly_id")), "assembly_id").drop("assembly_id")
    return r.source_metadata(sets, bind(spark, sf, RB_SETS), bind(spark, sf, THEMES), geometry)


@query("source_metadata", META_SQL + "SELECT * FROM md")
def source_metadata(spark, sf):
    return _metadata(spark, sf).withColumns(
        {k: F.col(f"metadata_3d.{k}") for k in ("wheel_count", "symmetry_score")}
    ).drop("metadata_3d")


@query("prompt_table", META_SQL + "SELECT set_id, '" + CLASSIFY.replace("'", "''") + """' AS system, 'Set ID: ' || set_id || chr(10) || 'Origen: ' || source || chr(10) || 'Nombre: ' || name || chr(10) ||
  'Temática: ' || theme || chr(10) || 'Año: ' || year || chr(10) || 'Descripción: ' || description || chr(10) ||
  'Tags del usuario: ' || tags || chr(10) || 'Cantidad de piezas: ' || parts_count || chr(10) ||
  'Metadatos 3D del diseño: ' || CASE WHEN wheel_count IS NULL THEN '{}' ELSE '{"wheel_count":' || wheel_count || '}' END || chr(10) ||
  CASE WHEN coalesce(image_url <> '', false) THEN chr(10) || '[IMAGEN DE ENTRADA DISPONIBLE Y PROCESADA MULTIMODALMENTE]'
  ELSE chr(10) || '[ATENCIÓN: NO HAY IMAGEN DISPONIBLE. Confianza máxima reducida por falta de visual.]' END AS prompt FROM md""")
def prompt_table(spark, sf):
    meta = _metadata(spark, sf)
    slim = F.when(F.col("metadata_3d").isNotNull(), F.struct(F.col("metadata_3d.wheel_count").alias("wheel_count")))
    return r.prompt_table(meta.withColumn("metadata_3d", slim))
