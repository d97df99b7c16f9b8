"""HTML, JSON, XML, dump, archive and manual-geometry queries."""

from __future__ import annotations

import io
import uuid
import zipfile

import pandas as pd
from pyspark.sql import functions as F

from brickloom.functions import geometry as g
from brickloom.lookups import MECABRICKS_COLORS, MECABRICKS_PARTS, values_sql
from brickloom.operators import manual as m
from brickloom.operators import sequencing as q
from brickloom.plans.assembly_queries import RANGE_SQL
from brickloom.plans.bindings import LINE_ORDER, P_SQL, numbered_lines, placed_parts, table
from brickloom.plans.catalog_queries import bind, duck
from brickloom.plans.registry import ORACLES, query
from brickloom.plans.sequence_queries import SYN, TRAIN_SQL, _pose
from brickloom.sinks.ldraw import assembly_documents, homogenized_chunks, homogenized_documents
from brickloom.operators.spatial import child_connections, connection_ranges, parent_connections
from brickloom.session import ensure_checkpoint_dir
from brickloom.sources import documents as d
from brickloom.sources import html as h

# whole pages with set numbers and counters written into their own text
PAGES = """SELECT page_id, replace(replace(html, '</li>', CASE WHEN page_id % 3 = 0 THEN '<td> ' || (100 + page_id) || ' </td>' ELSE ' ' || (100 + page_id) || '-' || (page_id % 4) || ' ' END || '</li>'),
  'article', 'article 1,' || (100 + page_id % 800) || ' Downloads, ' || page_id || ' views') AS html FROM {pages}"""
PG = duck(pg=PAGES)


@query("html_refs", r"""SELECT page_id, url FROM (SELECT DISTINCT page_id, unnest(regexp_extract_all(html, '(?:src|href)="([^"]+)"', 1)) AS url FROM pages)""")
def html_refs(spark, sf):
    return h.html_refs(table(spark, sf, "pages"))


@query("distinct_union_urls", r"""SELECT page_id, unnest(regexp_extract_all(html, 'href="([^"]+)"', 1)) AS url FROM pages
UNION SELECT page_id, unnest(regexp_extract_all(html, 'src="([^"]+)"', 1)) FROM pages
UNION SELECT page_id, unnest(regexp_extract_all(html, 'content="(http[^"]+)"', 1)) FROM pages""")
def distinct_union_urls(spark, sf):
    return h.distinct_union_urls(table(spark, sf, "pages"), "page_id", [r'href="([^"]+)"', r'src="([^"]+)"', r'content="(http[^"]+)"'])


INDEX_SQL = PG + r""", l AS (SELECT DISTINCT page_id, html, unnest(regexp_extract_all(html, 'href="([^"]+)"', 1)) AS url FROM pg),
n AS (SELECT page_id, url, substring(html, instr(html, url), 1500) AS near FROM l),
x AS (SELECT page_id, url, regexp_extract(near, '(?:^|[^\p{L}\p{N}_])([0-9]{3,6}-[0-9]+)(?:$|[^\p{L}\p{N}_])', 1) AS f, regexp_extract(near, '>\s*([0-9]{3,6})\s*<', 1) AS b FROM n),
k AS (SELECT page_id, url, split_part(f, '-', 1) AS set_num FROM x WHERE f <> '' UNION ALL SELECT page_id, url, f FROM x WHERE f <> ''
  UNION ALL SELECT page_id, url, b FROM x WHERE f = '' AND b <> ''),
idx AS (SELECT set_num, arg_max(url, (page_id, url)) AS url FROM k GROUP BY set_num)"""


@query("html_set_index", INDEX_SQL + " SELECT * FROM idx")
def html_set_index(spark, sf):
    return h.html_set_index(bind(spark, sf, PAGES))


@query("set_page_lookup", INDEX_SQL + """, w AS (SELECT DISTINCT '' || (o_orderkey % 500) AS set_num FROM orders),
c AS (SELECT w.set_num, idx.set_num AS key, url, row_number() OVER (PARTITION BY w.set_num ORDER BY idx.set_num <> w.set_num, idx.set_num) AS rk
  FROM w JOIN idx ON starts_with(idx.set_num, w.set_num)) SELECT set_num, key, url FROM c WHERE rk = 1""")
def set_page_lookup(spark, sf):
    wanted = table(spark, sf, "orders").select((F.col("o_orderkey") % 500).cast("string").alias("set_num"))
    return h.set_page_lookup(wanted, h.html_set_index(bind(spark, sf, PAGES)))


@query("html_counts", PG + r"""SELECT page_id, coalesce(TRY_CAST(replace(regexp_extract(html, '([\d,]+)\s*Downloads', 1, 'i'), ',', '') AS INTEGER), 0) AS downloads,
  coalesce(TRY_CAST(replace(regexp_extract(html, '([\d,]+)\s*Views', 1, 'i'), ',', '') AS INTEGER), 0) AS views FROM pg""")
def html_counts(spark, sf):
    return h.html_counts(bind(spark, sf, PAGES))


# --- JSON and XML ---------------------------------------------------------------------------------

KEYS = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"]
SCENE = """SELECT l_orderkey || '/' || l_linenumber || '/' || l_partkey || '/' || l_suppkey || '/' || l_extendedprice AS assembly_id,
  '{{"' || CASE WHEN l_linenumber % 2 = 0 THEN 'nodes' ELSE 'parts' END || '": [{{"' || CASE WHEN l_linenumber % 3 = 0 THEN 'name' ELSE 'id' END || '": "' || (3001 + l_partkey % 10) ||
  '", "' || CASE WHEN l_linenumber % 3 = 0 THEN 'material' ELSE 'color' END || '": "solid_blue_' || l_suppkey || '", "matrix": [1, 0, 0, ' || l_discount || ', 0, 1, 0, ' || l_tax ||
  ', 0, 0, 1, 0, 0, 0, 0, 1], "step": ' || l_linenumber || '}}, {{"id": "3062", "matrix": [1]}}]}}' AS text FROM {lineitem}"""
AID = "l_orderkey || '/' || l_linenumber || '/' || l_partkey || '/' || l_suppkey || '/' || l_extendedprice"


@query("mbx_parts", f"""SELECT DISTINCT {AID} AS assembly_id, 0 AS part_index, (3001 + l_partkey % 10) || '.dat' AS part_id, 1 AS color, l_linenumber AS step_id,
  l_discount * 2500 AS x, 0.0 - l_tax * 2500 AS y, 1.0::DOUBLE AS c FROM lineitem
UNION ALL SELECT DISTINCT {AID}, 1, '3062b.dat', 7, 0, 0.0, 0.0, 1.0 FROM lineitem""")
def mbx_parts(spark, sf):
    scenes = spark.sql(SCENE, lineitem=table(spark, sf, "lineitem")).distinct()
    return _pose(d.mbx_parts(scenes), "assembly_id", "part_index", "part_id", "color", "step_id").drop("z", "s")


XML = """SELECT l_orderkey || '/' || l_linenumber || '/' || l_partkey || '/' || l_suppkey || '/' || l_extendedprice AS assembly_id,
  '<?xml version="1.0"?><Model><Group><Part design="' || (3001 + l_partkey % 10) || '" color="' || (l_suppkey % 16) || '" tx="' || l_quantity || '" ty="-' || l_linenumber ||
  '.5" m00="0" m02="1"/></Group><Parts/><Part design=' || chr(39) || 'x' || l_suppkey || chr(39) || CASE WHEN l_linenumber % 2 = 0 THEN ' color=""' ELSE '' END || '></Part></Model>' AS text FROM {lineitem}"""


@query("studio_xml_parts", f"""SELECT DISTINCT {AID} AS assembly_id, 0 AS part_index, (3001 + l_partkey % 10) || '.dat' AS part_id, CAST(l_suppkey % 16 AS INTEGER) AS color, l_quantity AS x,
  (0 - l_linenumber - 0.5)::DOUBLE AS y, 0.0::DOUBLE AS c, 1.0::DOUBLE AS s FROM lineitem
UNION ALL SELECT DISTINCT {AID}, 1, 'x' || l_suppkey || '.dat', 14, 0.0, 0.0, 1.0, 0.0 FROM lineitem""")
def studio_xml_parts(spark, sf):
    scenes = bind(spark, sf, XML).distinct()
    return _pose(d.studio_xml_parts(scenes), "assembly_id", "part_index", "part_id", "color").drop("z")


RECORDS = """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, CASE l_linenumber % 4
  WHEN 0 THEN '{{"part_id": "a' || l_partkey || '", "color": 3, "position": [' || l_quantity || ', 1, 2], "rotation": [[0, 0, 1], [0, 1, 0], [-1, 0, 0]]}}'
  WHEN 1 THEN '{{"part_id": "", "id": "b' || l_partkey || '", "pos": [' || l_quantity || ', 1, 2], "rot": [0, 0, 1, 0, 1, 0, -1, 0, 0], "step_id": 4}}'
  WHEN 2 THEN '{{"part_name": "c' || l_partkey || '", "rot": [[0, 0, 1, 9], [0, 1, 0, 9], [-1, 0, 0, 9], [0, 0, 0, 1]]}}'
  ELSE '{{"id": "d' || l_partkey || '", "transform": [[1, 0, 0, 5], [0, 1, 0, 6], [0, 0, 1, 7], [0, 0, 0, 1]]}}' END AS record FROM {lineitem}"""


@query("normalize_record", """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, CASE l_linenumber % 4 WHEN 0 THEN 'a' WHEN 1 THEN 'b' WHEN 2 THEN 'c' ELSE 'd' END || l_partkey AS part_id,
  CASE l_linenumber % 4 WHEN 0 THEN 3 ELSE 0 END AS color, CASE l_linenumber % 4 WHEN 1 THEN 4 ELSE 0 END AS step_id,
  CASE l_linenumber % 4 WHEN 2 THEN 0.0 WHEN 3 THEN 5.0 ELSE l_quantity END AS x, CASE l_linenumber % 4 WHEN 2 THEN 0.0::DOUBLE WHEN 3 THEN 6.0::DOUBLE ELSE 1.0::DOUBLE END AS y,
  CASE l_linenumber % 4 WHEN 2 THEN 0.0::DOUBLE WHEN 3 THEN 7.0::DOUBLE ELSE 2.0::DOUBLE END AS z, CASE l_linenumber % 4 WHEN 3 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS c,
  CASE l_linenumber % 4 WHEN 3 THEN 0.0::DOUBLE ELSE 1.0::DOUBLE END AS s FROM lineitem""")
def normalize_record(spark, sf):
    records = spark.sql(RECORDS, lineitem=table(spark, sf, "lineitem"))
    return _pose(d.normalize_record(records), *KEYS, "part_id", "color", "step_id")


# sizes of the made-up responses follow the customers
GALLERY = """SELECT c_custkey AS page, CASE WHEN c_custkey % 2 = 0 THEN '{{"list": ' ELSE '{{"list": [], "data": {{"list": ' END ||
  '[{{"idModel": ' || c_custkey || ', "name": "' || c_name || '", "creatorUsername": "u' || c_nationkey || '", "partsCount": 12, "likeCount": "7", "tags": ["a", "b"], "description": "text"}}, ' ||
  '{{"id": "z' || c_custkey || '", "title": "T", "creator": {{"username": "w"}}, "pieces": "34", "views": 5, "tags": "plain"}}, {{"name": "no id", "idModel": 0}}, {{"id": "q' || c_custkey || '"}}]' ||
  CASE WHEN c_custkey % 2 = 0 THEN '}}' ELSE '}}}}' END AS text FROM {customer}"""


@query("gallery_json", """SELECT c_custkey AS page, 0 AS item_no, '' || c_custkey AS set_id, c_name AS name, 'text' AS description, 12 AS parts_count, 'a,b' AS tags, 7 AS likes_count, 0 AS views_count, 'u' || c_nationkey AS creator_username FROM customer WHERE c_custkey <> 0
UNION ALL SELECT c_custkey, 1, 'z' || c_custkey, 'T', 'Studio creation by w', 34, 'plain', 0, 5, 'w' FROM customer
UNION ALL SELECT c_custkey, 3, 'q' || c_custkey, 'Model q' || c_custkey, 'Studio creation by Unknown', 0, '', 0, 0, 'Unknown' FROM customer""")
def gallery_json(spark, sf):
    return d.gallery_json(spark.sql(GALLERY, customer=table(spark, sf, "customer"))).drop("theme", "source", "downloads_count")


DUMP_LINES = """SELECT p_partkey, CASE p_partkey % 7 WHEN 0 THEN 's' || p_partkey || ',"' || p_name || ', ~~big~~",,5,,u' WHEN 1 THEN 's' || p_partkey || ',n,19x0,5,6,u' WHEN 2 THEN 's' || p_partkey || ',n'
  ELSE 's' || p_partkey || ',' || p_name || ',' || (1990 + p_size) || ',' || (p_partkey % 50) || ',' || p_size || ',http://i/' || p_partkey END AS line FROM {part}""".replace("~~", '""')


@query("dump_csv", """SELECT 's' || p_partkey AS set_num, CASE WHEN p_partkey % 7 = 0 THEN p_name || ', "big"' ELSE p_name END AS name,
  CASE WHEN p_partkey % 7 <> 0 THEN 1990 + p_size END AS year, CAST(CASE WHEN p_partkey % 7 = 0 THEN 5 ELSE p_partkey % 50 END AS INTEGER) AS theme_id, CASE WHEN p_partkey % 7 = 0 THEN 0 ELSE p_size END AS num_parts,
  CASE WHEN p_partkey % 7 = 0 THEN 'u' ELSE 'http://i/' || p_partkey END AS img_url FROM part WHERE p_partkey % 7 NOT IN (1, 2)""")
def dump_csv(spark, sf):
    lines = bind(spark, sf, DUMP_LINES)
    raw = lines.select(F.from_csv("line", F.lit(d.dump_schema("sets")), d.CSV_OPTIONS).alias("r")).select("r.*")
    return d.map_dump(raw, "sets")


INVENTORY_LINES = """SELECT l_orderkey || ',' || CASE WHEN l_linenumber % 3 = 0 THEN '"p ~~' || l_partkey || '~~' || chr(10) || 'x,' || chr(10) || '"' ELSE 'p' || l_partkey END || ',' ||
  CASE WHEN l_linenumber = 7 THEN 'none' ELSE '' || l_suppkey END || ',' || CAST(l_quantity AS INT) || ',' || CASE WHEN l_returnflag = 'R' THEN 't' ELSE 'f' END || ',u' || l_linenumber || '"' AS line
  FROM {lineitem}""".replace("~~", '""')


@query("large_dump", """SELECT CAST(l_orderkey AS INTEGER) AS inventory_id, CASE WHEN l_linenumber % 3 = 0 THEN 'p "' || l_partkey || '"' || chr(10) || 'x,' || chr(10) ELSE 'p' || l_partkey END AS part_num,
  CAST(l_suppkey AS INTEGER) AS color_id, CAST(l_quantity AS INTEGER) AS quantity, CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS is_spare, 'u' || l_linenumber || '"' AS img_url FROM lineitem WHERE l_linenumber <> 7""")
def large_dump(spark, sf):
    """Records with line breaks, written as files without header to the shared folder and read back in blocks."""
    ensure_checkpoint_dir(spark)
    folder = f"{spark.sparkContext.getCheckpointDir()}/dump-{uuid.uuid4().hex}"
    bind(spark, sf, INVENTORY_LINES).write.text(folder)
    return d.read_large_dump(spark, folder, "inventory_parts", header=False)


def _zip_texts(batches):
    """Pack each row's text into an archive beside a decoy."""
    for batch in batches:
        out = []
        for key, name, text in zip(batch["assembly_id"], batch["member"], batch["text"]):
            data = io.BytesIO()
            with zipfile.ZipFile(data, "w") as z:
                z.writestr("other.ldr" if name != "document.xml" and name != "scene.mbx" else "readme.txt", "0 decoy")
                z.writestr(name, text)
            out.append((key, data.getvalue()))
        yield pd.DataFrame(out, columns=["assembly_id", "content"])


PACKED = """SELECT o_orderkey AS assembly_id, CASE o_orderkey % 5 WHEN 0 THEN 'model.ldr' WHEN 1 THEN 'modelv2.ldr' WHEN 2 THEN 'document.xml' WHEN 3 THEN 'scene.mbx' ELSE 'sub/part.ldr' END AS member,
  '0 Model ' || o_orderkey || ' of ' || o_custkey AS text FROM {orders}"""


@query("archive_members", duck(z=PACKED) + """SELECT assembly_id, CASE WHEN member = 'sub/part.ldr' THEN 'other.ldr' ELSE member END AS member,
  CASE WHEN member = 'sub/part.ldr' THEN '0 decoy' ELSE text END AS text FROM z""")
def archive_members(spark, sf):
    zipped = bind(spark, sf, PACKED).mapInPandas(_zip_texts, "assembly_id long, content binary")
    return d.archive_members(zipped)


def _documents(spark, sf, limited=True):
    """The data set files hold assemblies of under 100 parts only; connection documents hold all."""
    small = q.size_filter(placed_parts(spark, sf)) if limited else placed_parts(spark, sf)
    names = small.select("assembly_id").distinct().select(
        "assembly_id", F.concat("assembly_id", F.lit("-1_Set")).alias("set_name"), F.col("assembly_id").cast("string").alias("set_number"))
    return small, names


@query("to_assembly_json", f"""WITH {P_SQL}{TRAIN_SQL} SELECT assembly_id, assembly_id || '-1_Set' AS set_name, '' || assembly_id AS set_number, CAST(count(*) AS INTEGER) AS num_parts,
  string_agg(k || ':' || part_id || ':' || color || ':' || step_id || ':' || CAST(x AS INTEGER), ',' ORDER BY k) AS parts FROM s GROUP BY assembly_id""")
def to_assembly_json(spark, sf):
    small, names = _documents(spark, sf)
    docs = assembly_documents(q.sequence_index(small, bounded=True), names)
    flat = F.transform("parts", lambda p: F.concat_ws(":", p["sequence_index"], p["part_id"], p["color"], p["step_id"], F.get(p["transform"], F.lit(3)).cast("int")))
    return docs.withColumn("parts", F.array_join(flat, ","))


@query("assembly_json", f"""WITH {P_SQL}{TRAIN_SQL} SELECT assembly_id, CAST(k AS INTEGER) AS part_index, part_id, color, step_id, x, y, z, c, s FROM s WHERE size >= 2""")
def assembly_json(spark, sf):
    """Documents written as JSON text and read back."""
    small, names = _documents(spark, sf)
    docs = assembly_documents(q.sequence_index(small, bounded=True), names)
    text = docs.select("assembly_id", F.to_json(F.struct("set_name", "set_number", "num_parts", "parts")).alias("t"))
    back = text.select("assembly_id", F.from_json("t", d.ASSEMBLY_SCHEMA).alias("j")).select("assembly_id", "j.*")
    return _pose(d.assembly_json(back, least=2), "assembly_id", "part_index", "part_id", "color", "step_id")


@query("to_homogenized_json", f"""WITH {P_SQL}, n AS (SELECT assembly_id, CAST(count(*) AS INTEGER) AS num_parts FROM p GROUP BY assembly_id),
c AS MATERIALIZED ({ORACLES["parent_connections"]})
SELECT n.assembly_id, n.assembly_id || '-1_Set' AS set_name, num_parts, coalesce(string_agg(part_index || '<' || parent_index || ':' || parent_anchor || ':' || child_anchor, ',' ORDER BY part_index, parent_index), '') AS links
FROM n LEFT JOIN c ON c.assembly_id = n.assembly_id GROUP BY n.assembly_id, num_parts""")
def to_homogenized_json(spark, sf):
    """The nested connections, listed again as text."""
    parts, names = _documents(spark, sf, limited=False)
    docs = homogenized_documents(parts, parent_connections(parts), names)
    listed = F.flatten(
        F.transform(
            "sequence",
            lambda p: F.transform(
                p["connections"],
                lambda c: F.concat(p["part_index"].cast("string"), F.lit("<"), c["parent_part_index"].cast("string"),
                                   F.lit(":"), c["parent_anchor"], F.lit(":"), c["child_anchor"]),
            ),
        )
    )
    return docs.select("assembly_id", "set_name", "num_parts", F.array_join(listed, ",").alias("links"))


@query("homogenized_chunks", RANGE_SQL + """, placed AS (SELECT assembly_id, part_index, CAST((row_number() OVER (PARTITION BY assembly_id ORDER BY part_index) - 1) // 3 AS INTEGER) AS chunk_no FROM p),
sized AS (SELECT assembly_id, chunk_no, CAST(count(*) AS INTEGER) AS num_parts FROM placed GROUP BY assembly_id, chunk_no),
listed AS (SELECT assembly_id, chunk_no, string_agg(part_index || '<' || po || '*' || n || ':' || parent_anchor || ':' || child_anchor, ',' ORDER BY part_index, po) AS links
  FROM kids JOIN placed USING (assembly_id, part_index) GROUP BY assembly_id, chunk_no)
SELECT assembly_id, assembly_id || '-1_Set' AS set_name, chunk_no, num_parts, coalesce(links, '') AS links FROM sized LEFT JOIN listed USING (assembly_id, chunk_no)""")
def homogenized_chunks_query(spark, sf):
    """Chunks of three parts, their connections listed as text."""
    parts, names = _documents(spark, sf, limited=False)
    docs = homogenized_chunks(parts, child_connections(parts, connection_ranges(parts)), names, size=3)
    listed = F.flatten(F.transform("sequence", lambda p: F.transform(p["connections"], lambda c: F.concat(
        p["part_index"].cast("string"), F.lit("<"), c["parent_part_index"].cast("string"), F.lit("*"), c["parent_copies"].cast("string"),
        F.lit(":"), c["parent_anchor"], F.lit(":"), c["child_anchor"]))))
    return docs.select("assembly_id", "set_name", "chunk_no", "num_parts", F.array_join(listed, ",").alias("links"))


# --- manuals --------------------------------------------------------------------------------------

O_SQL = f"o AS (SELECT *, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY {', '.join(LINE_ORDER)}) - 1 AS INTEGER) AS pi FROM lineitem)"
BOX = """SELECT l_orderkey AS page_id, pi AS box_id, CAST(l_partkey % 300 AS DOUBLE) AS x0, CAST(l_suppkey * 3 % 400 AS DOUBLE) AS y0,
  CAST(l_partkey % 300 + 10 + l_quantity * 9 AS DOUBLE) AS x1, CAST(l_suppkey * 3 % 400 + 10 + l_linenumber * 90 AS DOUBLE) AS y1,
  CAST(CASE WHEN l_partkey % 3 = 0 THEN 0.9 ELSE 0.4 END AS DOUBLE) AS fill_r, CAST(0.4 AS DOUBLE) AS fill_g,
  CAST(l_suppkey * 7 % 500 AS DOUBLE) AS qx, CAST(l_partkey * 3 % 700 AS DOUBLE) AS qy FROM {o}"""


def lines_sql(spark, sf, sql):
    return spark.sql(sql, o=numbered_lines(spark, sf))


@query("box_containment", f"WITH {O_SQL}, bx AS ({BOX.replace('{o}', 'o')})" + """ SELECT a.page_id, a.box_id FROM bx a WHERE x1 - x0 > 20 AND x1 - x0 < 600 * 0.7 AND y1 - y0 > 20 AND y1 - y0 < 800 * 0.7
  AND fill_r > 0.35 AND fill_r < 0.45 AND fill_g > 0.35 AND fill_g < 0.45 AND EXISTS (SELECT 1 FROM bx b WHERE b.page_id = a.page_id
  AND b.qx BETWEEN a.x0 - 5 AND a.x1 + 5 AND b.qy BETWEEN a.y0 - 5 AND a.y1 + 5)""")
def box_containment(spark, sf):
    boxes = lines_sql(spark, sf, BOX)
    pages = boxes.select("page_id", F.lit(600.0).alias("width"), F.lit(800.0).alias("height")).distinct()
    return m.box_containment(boxes.drop("qx", "qy"), boxes.select("page_id", "qx", "qy"), pages).select("page_id", "box_id")


NEAR = """SELECT l_orderkey AS page_id, pi AS box_id, CAST(l_partkey % 4 AS DOUBLE) AS x0, CAST(l_suppkey % 3 AS DOUBLE) AS y0,
  CAST(50 + l_quantity % 3 AS DOUBLE) AS x1, CAST(50 + l_linenumber % 3 AS DOUBLE) AS y1 FROM {o}"""


@query("box_dedupe", f"WITH RECURSIVE {O_SQL}, bx AS ({NEAR.replace('{o}', 'o')})" + """, r AS (
  SELECT page_id, 0 AS i, [{'b': box_id, 'x0': x0, 'y0': y0, 'x1': x1, 'y1': y1}] AS kept FROM bx WHERE box_id = 0
  UNION ALL SELECT r.page_id, b.box_id, CASE WHEN len(list_filter(kept, lambda k: abs(k.x0 - b.x0) < 2 AND abs(k.y0 - b.y0) < 2 AND abs(k.x1 - b.x1) < 2 AND abs(k.y1 - b.y1) < 2)) > 0 THEN kept
    ELSE list_append(kept, {'b': b.box_id, 'x0': b.x0, 'y0': b.y0, 'x1': b.x1, 'y1': b.y1}) END
  FROM r JOIN bx b ON b.page_id = r.page_id AND b.box_id = r.i + 1),
f AS (SELECT page_id, arg_max(kept, i) AS kept FROM r GROUP BY page_id), u AS (SELECT page_id, unnest(kept) AS k FROM f)
SELECT page_id, k.b AS box_id, k.x0 AS x0, k.y0 AS y0, k.x1 AS x1, k.y1 AS y1 FROM u""")
def box_dedupe(spark, sf):
    return m.box_dedupe(lines_sql(spark, sf, NEAR))


WORDS = """SELECT l_orderkey AS page_id, pi, CAST(l_partkey % 20 * 10 AS DOUBLE) AS ex0, CAST(l_suppkey % 20 * 10 AS DOUBLE) AS ey0,
  CAST(l_suppkey % 25 * 8 AS DOUBLE) AS wx0, CAST(l_partkey % 25 * 8 AS DOUBLE) AS wy1, CAST(l_quantity AS INT) AS qty FROM {o}"""


@query("label_above", f"WITH {O_SQL}, w AS ({WORDS.replace('{o}', 'o')})" + """, hit AS (SELECT a.page_id, a.pi, arg_min(b.qty, b.pi) AS qty FROM w a JOIN w b ON a.page_id = b.page_id
  AND abs(b.wx0 - a.ex0) < 40 AND a.ey0 - b.wy1 > 0 AND a.ey0 - b.wy1 < 30 GROUP BY ALL)
SELECT w.page_id, w.pi AS code_id, coalesce(hit.qty, 1) AS qty FROM w LEFT JOIN hit ON hit.page_id = w.page_id AND hit.pi = w.pi""")
def label_above(spark, sf):
    w = lines_sql(spark, sf, WORDS)
    codes = w.select("page_id", F.col("pi").alias("code_id"), "ex0", "ey0")
    return m.label_above(codes, w.select("page_id", F.col("pi").alias("word_no"), "wx0", "wy1", "qty"))


CODED = """SELECT conv_id AS manual_id, turn AS page_no, text || ' ' || repeat((100000 + conv_id * 17) || ' ', CAST(length(text) % 9 AS INT)) || ' 12345678 x1234567' AS text FROM {conversations}"""


@query("dense_code_pages", duck(t=CODED) + r""", e AS (SELECT *, max(page_no) OVER (PARTITION BY manual_id) + 1 AS n FROM t),
k AS (SELECT manual_id, page_no, CAST(len(list_filter(regexp_extract_all(' ' || text || ' ', '[^0-9A-Za-z_]+([0-9A-Za-z_]+)', 1), lambda w: regexp_full_match(w, '[0-9]{6,7}'))) AS INTEGER) AS codes
  FROM e WHERE page_no >= greatest(n - 3, 0)) SELECT * FROM k WHERE codes >= 5""")
def dense_code_pages(spark, sf):
    """Last three turns of a conversation as the end of a manual."""
    return m.dense_code_pages(bind(spark, sf, CODED), last=3)


POOL = "SELECT l_orderkey AS manual_id, pi AS item_no, 'p' || (l_partkey % 5) AS part_id, CAST(l_suppkey % 3 AS INT) AS color, CAST(l_quantity % 4 AS INT) AS qty FROM {o}"


@query("distinct_candidates", f"WITH {O_SQL}, t AS ({POOL.replace('{o}', 'o')}) SELECT manual_id, part_id, color, item_no FROM t QUALIFY row_number() OVER (PARTITION BY manual_id, part_id, color ORDER BY item_no) = 1")
def distinct_candidates(spark, sf):
    return m.distinct_candidates(lines_sql(spark, sf, POOL))


@query("page_assignment", f"WITH {O_SQL}, inv AS ({POOL.replace('{o}', 'o')})" + """, pg AS (SELECT l_orderkey AS manual_id, pi AS page_no, CAST(l_partkey % 3 AS INTEGER) AS page_qty FROM o),
ie AS (SELECT *, sum(qty) OVER (PARTITION BY manual_id ORDER BY item_no) AS e FROM inv),
pe AS (SELECT *, sum(page_qty) OVER (PARTITION BY manual_id ORDER BY page_no) AS e, max(page_no + 2) OVER (PARTITION BY manual_id) AS extra FROM pg),
u AS (SELECT manual_id, item_no, part_id, color, unnest(range(CAST(e - qty AS BIGINT), CAST(e AS BIGINT))) AS pos FROM ie)
SELECT u.manual_id, pos, item_no AS line_no, part_id, color, CAST(coalesce(page_no + 1, (SELECT max(extra) FROM pe x WHERE x.manual_id = u.manual_id)) AS INTEGER) AS step_id
FROM u LEFT JOIN pe ON pe.manual_id = u.manual_id AND pos >= e - page_qty AND pos < e""")
def page_assignment(spark, sf):
    inv = lines_sql(spark, sf, POOL).withColumnRenamed("item_no", "line_no")
    pages = numbered_lines(spark, sf).select(F.col("l_orderkey").alias("manual_id"), F.col("pi").alias("page_no"), (F.col("l_partkey") % 3).cast("int").alias("page_qty"))
    return m.page_assignment(inv, pages)


@query("remaining_pool", f"WITH {O_SQL}, inv AS ({POOL.replace('{o}', 'o')})" + """, hv AS (SELECT manual_id, part_id, color, sum(qty) AS have FROM inv GROUP BY ALL),
us AS (SELECT l_orderkey AS manual_id, 'p' || ((l_partkey + 1) % 6) AS part_id, CAST(l_suppkey % 3 AS INTEGER) AS color, count(*) AS used FROM o GROUP BY ALL)
SELECT coalesce(hv.manual_id, us.manual_id) AS manual_id, coalesce(hv.part_id, us.part_id) AS part_id, coalesce(hv.color, us.color) AS color, CAST(greatest(coalesce(have, 0) - coalesce(used, 0), 0) AS BIGINT) AS remaining
FROM hv FULL JOIN us ON hv.manual_id = us.manual_id AND hv.part_id = us.part_id AND hv.color = us.color""")
def remaining_pool(spark, sf):
    lines = numbered_lines(spark, sf)
    used = lines.select(F.col("l_orderkey").alias("manual_id"), F.concat(F.lit("p"), ((F.col("l_partkey") + 1) % 6).cast("string")).alias("part_id"), (F.col("l_suppkey") % 3).cast("int").alias("color"))
    return m.remaining_pool(lines_sql(spark, sf, POOL), used)


ELEM = "SELECT l_orderkey AS manual_id, pi AS item_no, (3000 + l_partkey % 40) || '' || (10 + l_suppkey % 90) AS element_id, (3000 + l_suppkey % 40) || '.dat' AS part_id FROM {o}"


@query("substring_match", f"WITH {O_SQL}, t AS ({ELEM.replace('{o}', 'o')})" + """, el AS (SELECT DISTINCT manual_id, element_id FROM t),
hit AS (SELECT el.manual_id, element_id, arg_min(t.part_id, item_no) AS part_id FROM el JOIN (SELECT manual_id, item_no, part_id FROM t) t ON t.manual_id = el.manual_id AND contains(element_id, replace(t.part_id, '.dat', '')) GROUP BY ALL),
fst AS (SELECT manual_id, arg_min(part_id, item_no) AS part_id FROM t GROUP BY manual_id)
SELECT el.manual_id, el.element_id, coalesce(hit.part_id, fst.part_id) AS part_id FROM el LEFT JOIN hit ON hit.manual_id = el.manual_id AND hit.element_id = el.element_id JOIN fst ON fst.manual_id = el.manual_id""")
def substring_match(spark, sf):
    t = lines_sql(spark, sf, ELEM)
    return m.substring_match(t.select("manual_id", "element_id").distinct(), t.select("manual_id", "item_no", "part_id"))


@query("nearest_template", """WITH sc AS (SELECT e.label AS manual_id, e.vec_id AS query_id, t.vec_id AS template_id, round(list_cosine_similarity(e.embedding::DOUBLE[], t.embedding::DOUBLE[]), 12) AS s
  FROM embeddings e JOIN embeddings t ON t.label = e.label WHERE t.vec_id % 10 = 0)
SELECT manual_id, query_id, template_id, round(s, 6) AS score FROM sc QUALIFY row_number() OVER (PARTITION BY manual_id, query_id ORDER BY s DESC, template_id) = 1""")
def nearest_template(spark, sf):
    """A manual is a label; its templates are the tenth of its vectors whose id ends in 0."""
    e = table(spark, sf, "embeddings").withColumnRenamed("label", "manual_id")
    templates = e.filter("vec_id % 10 = 0").withColumnRenamed("vec_id", "template_id")
    return m.nearest_template(e.withColumnRenamed("vec_id", "query_id"), templates).withColumn("score", F.round("score", 6))


LISTING = """SELECT CASE o_orderkey % 4 WHEN 0 THEN 'omr_' ELSE '' END || o_orderkey || CASE o_orderkey % 4 WHEN 1 THEN '-1' WHEN 2 THEN '-2' ELSE '' END || '.ldr' AS file_name FROM {orders}"""


@query("normalized_path_pick", duck(fl=LISTING) + """, c AS (SELECT '' || o_custkey AS set_id FROM orders GROUP BY ALL), k AS (SELECT set_id, set_id || '.ldr' AS fn, 0 AS r FROM c
  UNION ALL SELECT set_id, 'omr_' || set_id || '.ldr', 1 FROM c UNION ALL SELECT set_id, set_id || '-1.ldr', 2 FROM c)
SELECT c.set_id, arg_min(fl.file_name, r) AS file_name FROM c LEFT JOIN k ON k.set_id = c.set_id LEFT JOIN fl ON fl.file_name = fn GROUP BY c.set_id""".replace("arg_min(fl.file_name, r)", "arg_min(fl.file_name, r) FILTER (fl.file_name IS NOT NULL)"))
def normalized_path_pick(spark, sf):
    from brickloom.operators.ingest import normalized_path_pick as pick

    sets = table(spark, sf, "orders").select(F.col("o_custkey").cast("string").alias("set_id")).distinct()
    return pick(sets, bind(spark, sf, LISTING))
