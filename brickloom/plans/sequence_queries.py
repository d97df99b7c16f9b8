"""Sequencing, feature, text and LDraw round-trip queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from brickloom.functions import geometry as g
from brickloom.functions import text as t
from brickloom.lookups import (
    ALLOWED_PARTS, COLOR_HEX, DEFAULT_HEX, MECABRICKS_COLORS, MECABRICKS_PARTS, PART_NAMES, VEHICLE_COLORS,
    VEHICLE_VOCAB, values_sql,
)
from brickloom.operators import features as f
from brickloom.operators import sequencing as q
from brickloom.plans.bindings import P_SQL, STACK_SQL, placed_parts, table
from brickloom.plans.catalog_queries import SETS, bind, duck
from brickloom.plans.registry import query
from brickloom.sinks import ldraw as out
from brickloom.sources import ldraw as src


def _pose(df, *keep):
    """Readable pose columns in place of the matrix."""
    c = lambda i, j: g.cell("transform", i, j) + 0.0
    return df.select(*keep, c(0, 3).alias("x"), c(1, 3).alias("y"), c(2, 3).alias("z"), c(0, 0).alias("c"), c(0, 2).alias("s"))


# --- sequencing -----------------------------------------------------------------------------------


@query("size_filter", f"WITH {P_SQL} SELECT assembly_id, part_index FROM p QUALIFY count(*) OVER (PARTITION BY assembly_id) BETWEEN 3 AND 5")
def size_filter(spark, sf):
    return q.size_filter(placed_parts(spark, sf), 3, 6).select("assembly_id", "part_index")


@query("sequence_index", f"""WITH {P_SQL} SELECT assembly_id, part_index,
CAST(row_number() OVER (PARTITION BY assembly_id ORDER BY color % 3, part_index) - 1 AS INTEGER) AS sequence_index FROM p""")
def sequence_index(spark, sf):
    """Steps taken from the colour, so that the order changes."""
    parts = placed_parts(spark, sf).withColumn("step_id", F.col("color") % 3)
    return q.sequence_index(parts).select("assembly_id", "part_index", "sequence_index")


@query("bottom_up_index", f"""WITH {P_SQL} SELECT assembly_id, part_index,
CAST(row_number() OVER (PARTITION BY assembly_id ORDER BY y DESC, step_id, part_index) - 1 AS INTEGER) AS sequence_index FROM p""")
def bottom_up_index(spark, sf):
    return q.bottom_up_index(placed_parts(spark, sf)).select("assembly_id", "part_index", "sequence_index")


STD_SQL = """,
st AS (SELECT *, part_index AS k, coalesce(abs(y - lag(y) OVER w) > 8, false) OR part_index = 0 AS jump
  FROM p WINDOW w AS (PARTITION BY assembly_id ORDER BY part_index)),
rn AS (SELECT *, sum(CAST(jump AS INTEGER)) OVER (PARTITION BY assembly_id ORDER BY k) AS run FROM st),
ns AS (SELECT *, (row_number() OVER (PARTITION BY assembly_id, run ORDER BY k) - 1) % 5 = 0 AND k > 0 AS new_step FROM rn),
sd AS (SELECT *, CAST(sum(CAST(new_step AS INTEGER)) OVER (PARTITION BY assembly_id ORDER BY k) AS BIGINT) AS std_step FROM ns)"""


@query("std_steps", f"WITH {P_SQL}{STD_SQL} SELECT assembly_id, part_index, new_step, std_step FROM sd")
def std_steps(spark, sf):
    return q.std_steps(placed_parts(spark, sf), "part_index").select("assembly_id", "part_index", "new_step", "std_step")


@query("layer_steps", f"""WITH {P_SQL}, l AS (SELECT *, row_number() OVER w - 1 AS ord, coalesce(abs(y - lag(y) OVER w) > 5, false) AS new_step
  FROM p WINDOW w AS (PARTITION BY assembly_id ORDER BY y DESC, part_index))
SELECT assembly_id, part_index, CAST(ord AS INTEGER) AS ord, new_step,
  CAST(sum(CAST(new_step AS INTEGER)) OVER (PARTITION BY assembly_id ORDER BY ord) AS BIGINT) AS layer_step FROM l""")
def layer_steps(spark, sf):
    return q.layer_steps(placed_parts(spark, sf)).select("assembly_id", "part_index", "ord", "new_step", "layer_step")


@query("stack_heights", f"WITH {STACK_SQL} SELECT assembly_id, part_index, y AS stack_y FROM p")
def stack_heights(spark, sf):
    return q.stack_heights(placed_parts(spark, sf)).select("assembly_id", "part_index", "stack_y")


TRAIN_SQL = """, n AS (SELECT *, count(*) OVER (PARTITION BY assembly_id) AS size FROM p),
s AS (SELECT *, row_number() OVER (PARTITION BY assembly_id ORDER BY step_id, part_index) - 1 AS k FROM n WHERE size < 100)"""


@query("training_examples", f"""WITH {P_SQL}{TRAIN_SQL}
SELECT a.assembly_id, CAST(a.k AS INTEGER) AS k, count(*) AS state_size, string_agg(b.part_id, ',' ORDER BY b.k) AS state_parts,
  a.part_no AS part_target, a.color AS color_target, a.x, a.z, a.c AS r00, a.s AS r02
FROM s a JOIN s b ON a.assembly_id = b.assembly_id AND b.k < a.k GROUP BY ALL""")
def training_examples(spark, sf):
    seq = q.sequence_index(q.size_filter(placed_parts(spark, sf)), bounded=True)
    ex = q.training_examples(seq)
    v = F.col("transform_target")
    return ex.select("assembly_id", "k", F.size("state").cast("long").alias("state_size"),
                     F.array_join(F.transform("state", lambda p: p["part_id"]), ",").alias("state_parts"),
                     "part_target", "color_target", v[0].alias("x"), v[2].alias("z"), (v[3] + 0.0).alias("r00"), (v[5] + 0.0).alias("r02"))


VV = values_sql(list(enumerate(VEHICLE_VOCAB)), ["vi", "vp"], "vv")
VC = values_sql(list(enumerate(VEHICLE_COLORS)), ["ci", "vc"], "vcol")


@query("training_examples_vehicle", f"""WITH {P_SQL}{TRAIN_SQL.replace("< 100", "< 150")}
SELECT assembly_id, CAST(k AS INTEGER) AS k, CAST(coalesce(vi, 0) AS INTEGER) AS part_target, CAST(coalesce(ci, 0) AS INTEGER) AS color_target, c AS m00, x AS m03, z AS m23
FROM s LEFT JOIN {VV} ON vp = part_id LEFT JOIN {VC} ON vc = color WHERE k > 0""")
def training_examples_vehicle(spark, sf):
    # the vehicle data hold assemblies of up to 149 parts
    seq = q.sequence_index(q.size_filter(placed_parts(spark, sf), below=150), bounded=True)
    v = F.col("transform_target")
    return q.training_examples(seq, VEHICLE_VOCAB, "rows", VEHICLE_COLORS).select(
        "assembly_id", "k", "part_target", "color_target", v[0].alias("m00"), v[3].alias("m03"), v[11].alias("m23"))


NAMES = values_sql(PART_NAMES, ["nid", "nm"], "nn")
HEXES = values_sql(COLOR_HEX, ["hc", "hx"], "hh")


@query("part_labels", f"""WITH {P_SQL} SELECT assembly_id, part_index, coalesce(hx, '{DEFAULT_HEX}') AS hex,
  coalesce(nm, replace(replace(part_id, '.dat', ''), 'b', '')) AS part_name
FROM p LEFT JOIN {NAMES} ON nid = part_id LEFT JOIN {HEXES} ON hc = color""")
def part_labels(spark, sf):
    return q.part_labels(placed_parts(spark, sf)).select("assembly_id", "part_index", "hex", "part_name")


@query("step_report_payload", f"""WITH {P_SQL}, fp AS (SELECT assembly_id, step_id, min(part_index) AS f FROM p GROUP BY ALL)
SELECT assembly_id, step_id, CAST(f // 2 AS INTEGER) AS step_page, part_index, part_id,
  coalesce(nm, replace(replace(part_id, '.dat', ''), 'b', '')) AS name, color, coalesce(hx, '{DEFAULT_HEX}') AS hex, w, h, d
FROM p JOIN fp USING (assembly_id, step_id) LEFT JOIN {NAMES} ON nid = part_id LEFT JOIN {HEXES} ON hc = color""")
def step_report_payload(spark, sf):
    return q.step_report_payload(placed_parts(spark, sf)).drop("transform")


# --- features -------------------------------------------------------------------------------------


@query("node_features", f"""WITH {P_SQL}, fx AS (SELECT assembly_id, part_index, list_concat(
  [CASE WHEN i = part_no THEN 1 ELSE 0 END FOR i IN range(32)], [CASE WHEN i = color THEN 1 ELSE 0 END FOR i IN range(16)],
  [CAST(v AS INTEGER) FOR v IN [x, y, z, c, 0, s, 0, 1, 0, -s, 0, c]]) AS v FROM p)
SELECT assembly_id, part_index, array_to_string(v, ' ') AS features FROM fx""".replace(
    "[CASE WHEN i = part_no THEN 1 ELSE 0 END FOR i IN range(32)]", "list_transform(range(32), lambda i: CASE WHEN i = part_no THEN 1 ELSE 0 END)").replace(
    "[CASE WHEN i = color THEN 1 ELSE 0 END FOR i IN range(16)]", "list_transform(range(16), lambda i: CASE WHEN i = color THEN 1 ELSE 0 END)").replace(
    "[CAST(v AS INTEGER) FOR v IN [x, y, z, c, 0, s, 0, 1, 0, -s, 0, c]]", "list_transform([x, y, z, c, 0, s, 0, 1, 0, -s, 0, c], lambda v: CAST(v AS INTEGER))"))
def node_features(spark, sf):
    v = f.node_features(F.col("part_id"), F.col("color"))
    return placed_parts(spark, sf).select(
        "assembly_id", "part_index", F.array_join(F.transform(v, lambda e: e.cast("int").cast("string")), " ").alias("features"))


@query("node_features_fallback", f"""WITH {P_SQL} SELECT assembly_id, part_index, CAST(coalesce(vi, 0) AS INTEGER) AS part_slot,
  CAST(coalesce(ci, 0) AS INTEGER) AS color_slot, 70 AS width, 2.0::DOUBLE AS hot, x
FROM p LEFT JOIN {VV} ON vp = part_id LEFT JOIN {VC} ON vc = color""")
def node_features_fallback(spark, sf):
    v = f.node_features(F.col("part_id"), F.col("color"), VEHICLE_VOCAB, VEHICLE_COLORS, fallback=True)
    n, m = len(VEHICLE_VOCAB), len(VEHICLE_COLORS)
    df = placed_parts(spark, sf).withColumn("v", v)
    return df.select(
        "assembly_id", "part_index",
        (F.array_position(F.slice("v", 1, n), 1.0) - 1).cast("int").alias("part_slot"),
        (F.array_position(F.slice("v", n + 1, m), 1.0) - 1).cast("int").alias("color_slot"),
        F.size("v").alias("width"),
        F.aggregate(F.slice("v", 1, n + m), F.lit(0.0), lambda a, e: a + e).alias("hot"),
        F.get("v", F.lit(n + m)).alias("x"),
    )


@query("vocab_valid", f"""WITH {P_SQL} SELECT assembly_id, bool_and(part_no <> 31 AND color < 15) AS valid FROM p GROUP BY assembly_id""")
def vocab_valid(spark, sf):
    return f.vocab_valid(placed_parts(spark, sf), ALLOWED_PARTS[:31], list(range(15)))


@query("is_vehicle", f"""WITH {P_SQL}, r AS (SELECT assembly_id, CASE WHEN part_no < 6 THEN 'tyre' WHEN part_no < 12 THEN 'kit' END AS k FROM p),
n AS (SELECT assembly_id, count(*) FILTER (k = 'tyre') AS tyres, count(*) FILTER (k IS NOT NULL) AS kit FROM r GROUP BY assembly_id)
SELECT assembly_id, tyres >= 4 OR (regexp_matches(lower(c_mktsegment || o_orderpriority), 'car|truck|rover|racer|buggy|vehicle|tractor|kart|roadster|formula1|tow-truck|jeep|4wd|chassis|auto')
  AND (tyres >= 2 OR kit >= 4)) AS is_vehicle FROM n JOIN orders ON o_orderkey = assembly_id JOIN customer ON c_custkey = o_custkey""")
def is_vehicle(spark, sf):
    tyres = ["3139", "30027", "6015", "18977", "56890", "56891"]
    kit = ["42610", "2926", "4150", "3829", "50745", "98282"]
    swap = F.create_map(*[F.lit(x) for p, v in zip(ALLOWED_PARTS[:12], [*tyres, *kit]) for x in (p, f"{v}.DAT")])
    parts = placed_parts(spark, sf).withColumn("part_id", F.coalesce(F.try_element_at(swap, F.col("part_id")), F.lit("9.dat")))
    names = table(spark, sf, "orders").join(table(spark, sf, "customer"), F.col("o_custkey") == F.col("c_custkey")).select(
        F.col("o_orderkey").alias("assembly_id"), F.concat("c_mktsegment", "o_orderpriority").alias("file_name"))
    return f.is_vehicle(parts, names)


SYN = """SELECT CASE o_orderkey % 5 WHEN 0 THEN '9999-' || o_orderkey WHEN 1 THEN 'My_Synthetic_' || o_orderkey
  WHEN 2 THEN o_orderkey || '-1_Desert-Rover' WHEN 3 THEN 'omr_' || o_orderkey ELSE o_orderkey || '-' || o_custkey || '_City' END AS assembly_id FROM {orders}"""


@query("skip_synthetic", duck(s=SYN) + "SELECT * FROM s WHERE assembly_id NOT LIKE '%Synthetic%' AND assembly_id NOT LIKE '9999-%'")
def skip_synthetic(spark, sf):
    return f.skip_synthetic(bind(spark, sf, SYN))


@query("prefer_synthetic", duck(s=SYN) + "SELECT * FROM s WHERE assembly_id LIKE '9999%'")
def prefer_synthetic(spark, sf):
    return f.prefer_synthetic(bind(spark, sf, SYN))


@query("theme_subsets", f"""WITH h AS (SELECT doc_id, regexp_matches(lower(text), '{"|".join(f.CITY_WORDS)}') AS c,
  regexp_matches(lower(text), '{"|".join(f.STAR_WORDS)}') AS s FROM documents)
SELECT doc_id, 'city' AS subset FROM h WHERE c OR NOT s UNION ALL SELECT doc_id, 'star_wars' FROM h WHERE NOT c""")
def theme_subsets(spark, sf):
    return f.theme_subsets(table(spark, sf, "documents"), "text").select("doc_id", "subset")


# --- scalar text ----------------------------------------------------------------------------------


@query("set_number", duck(s=SYN) + r"""SELECT assembly_id, CASE WHEN assembly_id LIKE '9999-%' THEN regexp_extract(assembly_id, '^9999-[0-9]+')
  WHEN regexp_matches(assembly_id, '^[0-9]') THEN regexp_extract(assembly_id, '^[0-9]+') ELSE assembly_id END AS set_number,
  CASE WHEN regexp_matches(assembly_id, '^[0-9]+-[0-9]+') THEN regexp_extract(assembly_id, '^[0-9]+-[0-9]+') ELSE assembly_id END AS dashed FROM s""")
def set_number(spark, sf):
    return bind(spark, sf, SYN).select("assembly_id", t.set_number(F.col("assembly_id")).alias("set_number"),
                                       t.set_number_dashed(F.col("assembly_id")).alias("dashed"))


@query("source_from_path", duck(s=SYN) + """SELECT assembly_id, CASE WHEN contains(lower(assembly_id), 'rover') THEN 'BrickLink' ELSE 'OMR' END AS by_path,
  CASE WHEN contains(assembly_id, 'omr') THEN 'OMR' ELSE 'Local' END AS by_id FROM s""")
def source_from_path(spark, sf):
    path = F.regexp_replace("assembly_id", "Rover", "BrickLink_raw")
    return bind(spark, sf, SYN).select("assembly_id", t.source_from_path(path).alias("by_path"), t.source_from_id(F.col("assembly_id")).alias("by_id"))


@query("theme_family", "WITH h AS (SELECT doc_id, lower(text) AS x FROM documents) SELECT doc_id, CASE " + " ".join(
    f"WHEN regexp_matches(x, '{p}') THEN '{n}'" for n, p in t.FAMILIES) + " ELSE 'Other' END AS family FROM h")
def theme_family(spark, sf):
    return table(spark, sf, "documents").select("doc_id", t.theme_family(F.col("text")).alias("family"))


@query("prompt_spec", """WITH h AS (SELECT conv_id, turn, lower(text) || CASE turn % 5 WHEN 0 THEN ' chair' WHEN 1 THEN ' torre' ELSE '' END AS x, role, text FROM conversations)
SELECT conv_id, turn, role, CASE WHEN regexp_matches(x, 'roja|rojo|red') THEN 4 WHEN regexp_matches(x, 'azul|blue') THEN 1 WHEN regexp_matches(x, 'verde|green') THEN 2 ELSE 14 END AS color,
  CASE WHEN regexp_matches(x, 'silla|chair') THEN 2 WHEN regexp_matches(x, 'torre|tower') THEN 3 END AS big_bricks,
  CASE WHEN regexp_matches(x, 'silla|chair') THEN 6 WHEN regexp_matches(x, 'torre|tower') THEN 5 ELSE 6 END AS pieces, md5(text) AS h FROM h""")
def prompt_spec(spark, sf):
    turn = F.col("turn") % 5
    text = F.concat("text", F.when(turn == 0, " chair").when(turn == 1, " torre").otherwise(""))
    return table(spark, sf, "conversations").select(
        "conv_id", "turn", "role", t.prompt_color(text).alias("color"),
        F.try_element_at(t.prompt_inventory(text), F.lit("3001.dat")).alias("big_bricks"), t.prompt_pieces(text).alias("pieces"), F.md5(F.col("text").cast("binary")).alias("h"))


MAPPED = """SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN ' ' || (3001 + p_size) || ' ' WHEN 1 THEN '3062' WHEN 2 THEN 'X' || p_partkey || '.DAT' ELSE '3941' END AS pid,
  CASE p_partkey % 6 WHEN 0 THEN '' WHEN 1 THEN '' || p_size WHEN 2 THEN p_name WHEN 3 THEN 'Trans ' || p_name WHEN 4 THEN 'Solid_Light_Gray' ELSE ' WHITE ' END AS col FROM {part}"""


@query("map_part_id", duck(m=MAPPED) + f"""SELECT p_partkey, CASE WHEN lower(trim(pid)) LIKE '%.dat' THEN lower(trim(pid)) ELSE coalesce(tv, lower(trim(pid)) || '.dat') END AS part_id
FROM m LEFT JOIN {values_sql(MECABRICKS_PARTS, ["tk", "tv"], "tt")} ON tk = lower(trim(pid))""")
def map_part_id(spark, sf):
    return bind(spark, sf, MAPPED).select("p_partkey", t.map_part_id(F.col("pid")).alias("part_id"))


@query("map_color_id", duck(m=MAPPED) + f""", tt AS (SELECT *, row_number() OVER () AS o FROM {values_sql(MECABRICKS_COLORS, ["ck", "cv"], "cc")}),
hit AS (SELECT p_partkey, arg_min(cv, o) AS cv FROM m JOIN tt ON contains(lower(trim(col)), ck) GROUP BY p_partkey)
SELECT m.p_partkey, CAST(CASE WHEN col = '' THEN 7 WHEN ex.cv IS NOT NULL THEN ex.cv WHEN hit.cv IS NOT NULL THEN hit.cv
  WHEN regexp_matches(trim(col), '^[0-9]+$') THEN CAST(trim(col) AS INTEGER) ELSE 7 END AS INTEGER) AS color
FROM m LEFT JOIN tt ex ON ex.ck = lower(trim(col)) LEFT JOIN hit ON hit.p_partkey = m.p_partkey""")
def map_color_id(spark, sf):
    return bind(spark, sf, MAPPED).select("p_partkey", t.map_color_id(F.col("col")).alias("color"))


@query("convert_matrix", """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CASE WHEN l_linenumber = 7 THEN 1.0 ELSE l_quantity END AS m00,
  CASE WHEN l_linenumber = 7 THEN 0.0 ELSE -l_tax END AS m01, CASE WHEN l_linenumber = 7 THEN 0.0 ELSE l_discount * 2500 END AS m03,
  CASE WHEN l_linenumber = 7 THEN 0.0 ELSE -l_quantity * 2500 END AS m13, CASE WHEN l_linenumber = 7 THEN 0.0 ELSE l_tax END AS m12 FROM lineitem""")
def convert_matrix(spark, sf):
    n = lambda c: F.col(c)
    full = [n("l_quantity"), n("l_tax"), F.lit(0.0), n("l_discount"), F.lit(0.0), F.lit(1.0), n("l_tax"), n("l_quantity"),
            F.lit(0.0), F.lit(0.0), F.lit(1.0), n("l_tax"), F.lit(0.0), F.lit(0.0), F.lit(0.0), F.lit(1.0)]
    matrix = F.when(F.col("l_linenumber") == 7, F.array(F.lit(1.0))).otherwise(F.array(*full))
    df = table(spark, sf, "lineitem").withColumn("m", matrix).withColumn("t", t.convert_matrix(F.col("m")))
    return df.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", *[
        (g.cell("t", i, j) + 0.0).alias(f"m{i}{j}") for i, j in ((0, 0), (0, 1), (0, 3), (1, 3), (1, 2))])


@query("mat_compose", f"""WITH {P_SQL} SELECT a.assembly_id, a.part_index, a.c*b.x + a.s*b.z + a.x AS x, b.y + a.y AS y, -a.s*b.x + a.c*b.z + a.z AS z,
  a.c*b.c - a.s*b.s AS c, a.c*b.s + a.s*b.c AS s FROM p a JOIN p b ON a.assembly_id = b.assembly_id AND b.part_index = a.part_index - 1""")
def mat_compose(spark, sf):
    parts = placed_parts(spark, sf)
    prev = parts.select("assembly_id", (F.col("part_index") + 1).alias("part_index"), F.col("transform").alias("tb"))
    both = parts.join(prev, ["assembly_id", "part_index"])
    return _pose(both.withColumn("transform", g.mat_compose("transform", "tb")), "assembly_id", "part_index")


@query("relative_transform", f"""WITH {P_SQL} SELECT a.assembly_id, a.part_index, b.x - a.x AS dx, b.z - a.z AS dz, a.c*b.c + a.s*b.s AS r00, a.c*b.s - a.s*b.c AS r02
FROM p a JOIN p b ON a.assembly_id = b.assembly_id AND b.part_index = a.part_index - 1""")
def relative_transform(spark, sf):
    parts = placed_parts(spark, sf)
    prev = parts.select("assembly_id", (F.col("part_index") + 1).alias("part_index"), F.col("transform").alias("tb"))
    v = g.relative_transform("transform", "tb")
    return parts.join(prev, ["assembly_id", "part_index"]).withColumn("v", v).select(
        "assembly_id", "part_index", F.col("v")[0].alias("dx"), F.col("v")[2].alias("dz"),
        (F.col("v")[3] + 0.0).alias("r00"), (F.col("v")[5] + 0.0).alias("r02"))


@query("absolute_url", """SELECT l_orderkey, l_linenumber, l_partkey, CASE l_linenumber % 3 WHEN 0 THEN 'https:' || '//cdn.example/' || l_partkey
  WHEN 1 THEN 'http://a.example/' || l_partkey ELSE '/img/' || l_partkey END AS url FROM lineitem""")
def absolute_url(spark, sf):
    k = F.col("l_linenumber") % 3
    url = F.concat(F.when(k == 0, "//cdn.example/").when(k == 1, "http://a.example/").otherwise("/img/"), "l_partkey")
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", t.absolute_url(url).alias("url"))


# --- LDraw text -----------------------------------------------------------------------------------

# one text per line item: a step, an indented part line, a comment and a short line
LINE_TEXT = """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice,
  '0 STEP' || chr(10) || '   1 ' || (l_suppkey % 16) || ' ' || CAST(l_quantity / 4 AS DOUBLE) || ' -' || (8 * (l_suppkey % 6)) || '.5 ' || l_tax ||
  ' 1 0 0.125 0 1 -' || l_discount || ' 0 ' || l_tax || ' 1.0 ' || CASE WHEN l_partkey % 2 = 0 THEN '3005.DAT' ELSE '9' || l_partkey || '.dat' END || ' extra' || chr(10) ||
  '0 // note' || chr(10) || '1 4 0 0 0 short' AS text FROM {lineitem}"""
NORM_SQL = """, nl AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice,
  '1 ' || (l_suppkey % 16) || ' ' || CAST(round_even(l_quantity / 4, 0) AS INTEGER) || ' ' || CAST(round_even(-(8 * (l_suppkey % 6) + 0.5)::DOUBLE, 0) AS INTEGER) || ' ' ||
  CAST(round_even(l_tax, 0) AS INTEGER) || ' 1.00 0.00 0.12 0.00 1.00 -' || printf('%.2f', l_discount) || ' 0.00 ' || printf('%.2f', l_tax) || ' 1.00 ' ||
  CASE WHEN l_partkey % 2 = 0 THEN '3005.dat' ELSE '9' || l_partkey || '.dat' END AS part_line FROM lineitem)"""
KEYS = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"]


@query("ldraw_normalize", "WITH x AS (SELECT 1)" + NORM_SQL + " SELECT * EXCLUDE (part_line), '0 STEP' || chr(10) || part_line AS norm FROM nl")
def ldraw_normalize(spark, sf):
    return bind(spark, sf, LINE_TEXT).select(*KEYS, t.ldraw_normalize(F.col("text")).alias("norm"))


VOCAB_IDS = values_sql([(w, i) for i, w in enumerate(t.token_vocabulary())], ["word", "id"], "vw")
ENC_SQL = f"""WITH vw AS (SELECT word, max(id) AS id FROM {VOCAB_IDS} GROUP BY word){NORM_SQL},
w AS (SELECT *, unnest(string_split(part_line, ' ')) AS word, generate_subscripts(string_split(part_line, ' '), 1) AS pos FROM nl),
e AS (SELECT {", ".join("w." + k for k in KEYS)}, w.part_line, string_agg(coalesce(id, 1), ' ' ORDER BY pos) AS ids,
  string_agg(CASE WHEN id IS NOT NULL AND id > 3 THEN w.word END, ' ' ORDER BY pos) AS words
  FROM w LEFT JOIN vw ON vw.word = w.word GROUP BY ALL)"""


@query("ldraw_encode", ENC_SQL + f" SELECT DISTINCT {', '.join(KEYS)}, '2 506 5 1 ' || ids || ' 1 3' AS ids FROM e")
def ldraw_encode(spark, sf):
    ids = F.array_join(F.transform(t.ldraw_encode(F.col("text")), lambda i: i.cast("string")), " ")
    return bind(spark, sf, LINE_TEXT).select(*KEYS, ids.alias("ids")).distinct()


@query("ldraw_decode", ENC_SQL + f" SELECT DISTINCT {', '.join(KEYS)}, '0 STEP ' || words AS words FROM e")
def ldraw_decode(spark, sf):
    return bind(spark, sf, LINE_TEXT).select(*KEYS, t.ldraw_decode(t.ldraw_encode(F.col("text"))).alias("words")).distinct()


# --- LDraw files ----------------------------------------------------------------------------------


def _rendered(spark, sf):
    """Line table of the LDraw texts of all assemblies."""
    lines = out.to_ldraw(placed_parts(spark, sf))
    return lines.select("assembly_id", (F.shiftleft(F.col("ord").cast("long"), 32) + F.col("sub")).alias("line_no"), "line")


def _num(v):
    return f"CAST(CAST({v} AS FLOAT) AS VARCHAR)"


# rotation texts spell out the sign of zero as the matrix holds it
LINE_SQL = f"""'1 ' || color || ' ' || {_num('x')} || ' ' || {_num('y')} || ' ' || {_num('z')} || ' ' || {_num('c')} || ' 0.0 ' || {_num('s')} ||
  ' 0.0 1.0 0.0 ' || {_num('0.0::DOUBLE - s')} || ' 0.0 ' || {_num('c')} || ' ' || part_id"""


@query("to_ldraw", f"""WITH {P_SQL} SELECT assembly_id, CAST(part_index AS BIGINT) AS ord,
  CASE WHEN part_index > 0 AND part_index % 2 = 0 THEN 1 ELSE 0 END AS sub, {LINE_SQL} AS line FROM p
UNION ALL SELECT assembly_id, part_index, 0, '0 STEP' FROM p WHERE part_index > 0 AND part_index % 2 = 0
UNION ALL SELECT DISTINCT assembly_id, -1, 0, '0 Generated Model' FROM p""")
def to_ldraw(spark, sf):
    return out.to_ldraw(placed_parts(spark, sf)).withColumn("line", F.regexp_replace("line", " -0.0 ", " 0.0 "))


def _pf(v, n):
    return f"printf('%.{n}f', {v})"


def _pf_line(n, m):
    zero, one = ("0." + "0" * m), ("1." + "0" * m)
    return (f"'1 ' || color || ' ' || {_pf('x', n)} || ' ' || {_pf('y', n)} || ' ' || {_pf('z', n)} || ' ' || {_pf('c', m)} || ' {zero} ' || {_pf('s', m)} || "
            f"' {zero} {one} {zero} ' || {_pf('0.0::DOUBLE - s', m)} || ' {zero} ' || {_pf('c', m)} || ' ' || part_id")


@query("to_ldraw_paged", f"""WITH {P_SQL} SELECT assembly_id, CAST(part_index AS BIGINT) AS ord,
  CASE WHEN part_index > 0 AND part_index % 2 = 0 THEN 1 ELSE 0 END AS sub, {_pf_line(3, 3)} AS line FROM p
UNION ALL SELECT assembly_id, part_index, 0, '0 STEP PAGE ' || step_id FROM p WHERE part_index > 0 AND part_index % 2 = 0
UNION ALL SELECT DISTINCT assembly_id, -1, 0, '0 Sequence' FROM p""")
def to_ldraw_paged(spark, sf):
    lines = out.to_ldraw_paged(placed_parts(spark, sf), ["0 Sequence"])
    return lines.withColumn("line", F.regexp_replace("line", r" -0\.000(?= )", " 0.000"))


@query("to_ldraw_standard", f"""WITH {P_SQL}{STD_SQL} SELECT assembly_id, CAST(part_index AS BIGINT) AS ord,
  CASE WHEN new_step THEN 1 ELSE 0 END AS sub, {_pf_line(4, 6)} AS line FROM sd
UNION ALL SELECT assembly_id, part_index, 0, '0 STEP' FROM sd WHERE new_step
UNION ALL SELECT DISTINCT assembly_id, -1, 0, '0 Standardized Sequence' FROM p""")
def to_ldraw_standard(spark, sf):
    marked = q.std_steps(placed_parts(spark, sf).withColumn("ord", F.col("part_index")))
    lines = out.to_ldraw_marked(marked, "0 Standardized Sequence")
    return lines.withColumn("line", F.regexp_replace("line", r" -0\.0000(00)?(?= )", " 0.0000$1"))


@query("ldraw_lines", f"""WITH {P_SQL} SELECT assembly_id, 'part' AS kind, color, part_id, x, y, z, c, s FROM p
UNION ALL SELECT assembly_id, 'step', NULL, NULL, NULL, NULL, NULL, NULL, NULL FROM p WHERE part_index > 0 AND part_index % 2 = 0""")
def ldraw_lines(spark, sf):
    return _pose(src.ldraw_lines(_rendered(spark, sf)), "assembly_id", "kind", "color", "part_id")


@query("ldraw_parts", f"WITH {P_SQL} SELECT assembly_id, part_index, part_id, color, step_id, step_id AS page_num, x, y, z, c, s FROM p")
def ldraw_parts(spark, sf):
    return _pose(src.ldraw_parts(_rendered(spark, sf)), "assembly_id", "part_index", "part_id", "color", "step_id", "page_num")


# multi-part files: even parts in the main model, odd ones in a submodel that is used twice; a block of line numbers is wider
# than the range of part_index, so blocks of assemblies of any size keep their order
BLOCK = 1 << 33
MPD_FRAME = [
    (0, "0 before"), (1, "0 FILE Main Model.ldr"), (BLOCK, "0 STEP"), (BLOCK + 1, "1 16 100 0 0 1 0 0 0 1 0 0 0 1 sub.ldr"),
    (BLOCK + 2, "0 step"), (BLOCK + 3, "1 16 0 -8 200 0 0 1 0 1 0 -1 0 0 SUB.LDR"), (2 * BLOCK - 1, "0 FILE Sub.ldr"),
    (3 * BLOCK - 1, "0 FILE SUB.ldr"), (4 * BLOCK, "0 STEP"), (4 * BLOCK + 1, "1 16 5 5 5 1 0 0 0 1 0 0 0 1 main model.ldr"),
    (4 * BLOCK + 2, "1 7 1 2 3 1 0 0 0 1 0 0 0 1 gone.ldr"),
]
MPD = f"""SELECT assembly_id, line_no, line FROM (
  SELECT assembly_id, 10 + part_index AS line_no, line FROM lines WHERE part_index % 2 = 0
  UNION ALL SELECT assembly_id, {2 * BLOCK} + part_index, line FROM lines WHERE part_index % 2 = 1
  UNION ALL SELECT assembly_id, {3 * BLOCK} + part_index, line FROM lines WHERE part_index % 2 = 1
  UNION ALL SELECT assembly_id, n, t FROM (SELECT DISTINCT assembly_id FROM lines) a CROSS JOIN {values_sql(MPD_FRAME, ["n", "t"], "h")})"""
MPD_LINES = f"""{P_SQL}, lines AS (SELECT assembly_id, part_index, {LINE_SQL} AS line FROM p), mpd AS ({MPD})"""
FLAT_SQL = f"""{P_SQL}, main AS (SELECT assembly_id, part_index AS o, part_id, color, x, y, z, c, s, 0 AS st FROM p WHERE part_index % 2 = 0),
inner_parts AS (SELECT assembly_id, part_index AS o, part_id, color, x, y, z, c, s, 0 AS ls FROM p WHERE part_index % 2 = 1
  UNION ALL SELECT DISTINCT assembly_id, {BLOCK - 1}, 'gone.ldr', 7, 1.0, 2.0, 3.0, 1.0, 0.0, 1 FROM p),
leaf AS (SELECT * FROM main
  UNION ALL SELECT assembly_id, {BLOCK} + o, part_id, color, x + 100, y, z, c, s, 1 + ls FROM inner_parts
  UNION ALL SELECT assembly_id, {2 * BLOCK} + o, part_id, color, z, y - 8, -x + 200, -s, c, 2 + ls FROM inner_parts),
flat AS (SELECT assembly_id, CAST(row_number() OVER (PARTITION BY assembly_id ORDER BY o) - 1 AS INTEGER) AS part_index, part_id, color, CAST(st AS INTEGER) AS step_id,
  x::DOUBLE AS x, y::DOUBLE AS y, z::DOUBLE AS z, c::DOUBLE AS c, s::DOUBLE AS s FROM leaf)"""


def _mpd(spark, sf):
    parts = placed_parts(spark, sf)
    lines = parts.select("assembly_id", "part_index", F.regexp_replace(out.part_line(), " -0.0 ", " 0.0 ").alias("line"))
    odd = F.col("part_index") % 2 == 1
    spots = F.when(odd, F.array(2 * BLOCK + F.col("part_index"), 3 * BLOCK + F.col("part_index"))).otherwise(
        F.array(F.lit(10).cast("long") + F.col("part_index")))
    frame = F.array(*[F.struct(F.lit(n).cast("long").alias("line_no"), F.lit(text).alias("line")) for n, text in MPD_FRAME])
    heads = parts.select("assembly_id").distinct().select("assembly_id", F.inline(frame))
    return lines.select("assembly_id", F.explode(spots).alias("line_no"), "line").unionByName(heads)


@query("mpd_submodels", f"""WITH {MPD_LINES} SELECT assembly_id, 'main model.ldr' AS submodel, CAST(1 AS BIGINT) AS position, line_no, line FROM mpd WHERE line_no BETWEEN 2 AND {2 * BLOCK - 2}
UNION ALL SELECT assembly_id, 'sub.ldr', 2, line_no, line FROM mpd WHERE line_no > {3 * BLOCK - 1}""")
def mpd_submodels(spark, sf):
    return src.mpd_submodels(_mpd(spark, sf))


@query("mpd_flatten", f"WITH {FLAT_SQL} SELECT * FROM flat")
def mpd_flatten(spark, sf):
    return _pose(src.mpd_flatten(_mpd(spark, sf)), "assembly_id", "part_index", "part_id", "color", "step_id")


@query("std_flatten", f"WITH {FLAT_SQL} SELECT * EXCLUDE (step_id) FROM flat")
def std_flatten(spark, sf):
    return _pose(src.mpd_flatten(_mpd(spark, sf), steps=False, keep_empty=False), "assembly_id", "part_index", "part_id", "color")


# headers written from orders
HEAD = """SELECT assembly_id, line_no, line FROM (
  SELECT o_orderkey AS assembly_id, 0 AS line_no, '0 !NAME First ' || o_orderkey AS line FROM {orders}
  UNION ALL SELECT o_orderkey, 1, '0 !name Model ' || o_orderstatus FROM {orders} WHERE o_orderstatus <> 'F'
  UNION ALL SELECT o_orderkey, 2, '0  !Theme ' || o_orderpriority FROM {orders} WHERE o_orderpriority <> '5-LOW'
  UNION ALL SELECT o_orderkey, 3, '0 Theme Plain ' || o_orderpriority FROM {orders} WHERE o_orderpriority <> '1-URGENT'
  UNION ALL SELECT o_orderkey, CASE WHEN o_orderstatus = 'O' THEN 4 ELSE 60 END, '1 4 0 0 0 1 0 0 0 1 0 0 0 1 3005.dat' FROM {orders}
  UNION ALL SELECT o_orderkey, 5, '0 NAME Plain ' || o_orderkey FROM {orders}
  UNION ALL SELECT o_orderkey, 55, '0 THEME Late ' || o_orderkey FROM {orders}) q"""


@query("file_header_meta", duck(hd=HEAD) + r""", m AS (SELECT assembly_id, arg_max(regexp_extract(line, '(?i)^0\s+!NAME\s+(.+)$', 1), line_no) FILTER (regexp_matches(line, '(?i)^0\s+!NAME\s+')) AS n,
  arg_max(regexp_extract(line, '(?i)^0\s+!THEME\s+(.+)$', 1), line_no) FILTER (regexp_matches(line, '(?i)^0\s+!THEME\s+')) AS th FROM hd WHERE line_no < 50 GROUP BY assembly_id)
SELECT assembly_id, coalesce(n, '' || assembly_id) AS name, coalesce(th, 'Unknown') AS theme, 'Unknown' AS author FROM m""")
def file_header_meta(spark, sf):
    return src.file_header_meta(bind(spark, sf, HEAD))


@query("file_header_meta_plain", """SELECT o_orderkey AS assembly_id, 'Plain ' || o_orderkey AS name,
  CASE WHEN o_orderpriority = '1-URGENT' THEN 'Studio MOC' ELSE 'Plain ' || o_orderpriority END AS theme FROM orders""")
def file_header_meta_plain(spark, sf):
    return src.file_header_meta_plain(bind(spark, sf, HEAD), F.lit("BrickLink"))


@query("leading_block_meta", """SELECT o_orderkey AS assembly_id, CASE WHEN o_orderstatus = 'O' THEN 'Unknown Lego Set' ELSE 'Plain ' || o_orderkey END AS name,
  CASE WHEN o_orderstatus <> 'O' THEN 'Late ' || o_orderkey WHEN o_orderpriority = '1-URGENT' THEN 'General' ELSE 'Plain ' || o_orderpriority END AS theme FROM orders""")
def leading_block_meta(spark, sf):
    return src.leading_block_meta(bind(spark, sf, HEAD))
