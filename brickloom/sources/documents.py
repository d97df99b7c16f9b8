"""JSON, XML, CSV-dump and archive sources."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator
from fnmatch import fnmatchcase

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from brickloom.functions.geometry import transform_from
from brickloom.functions.text import convert_matrix, map_color_id, map_part_id
from brickloom.sources.lines import csv_records, read_lines

# --- assembly documents ---------------------------------------------------------------------------

ASSEMBLY_SCHEMA = (
    "set_name STRING, set_number STRING, num_parts INT, parts ARRAY<STRUCT<sequence_index: INT, part_id: STRING,"
    " color: INT, transform: ARRAY<DOUBLE>, step_id: INT>>"
)


def read_assembly_json(spark: SparkSession, path: str) -> DataFrame:
    docs = spark.read.schema(ASSEMBLY_SCHEMA).json(path, multiLine=True)
    return docs.withColumn("assembly_id", F.col("set_number"))


def assembly_json(docs: DataFrame, least: int = 0) -> DataFrame:
    """Documents back to placed parts; documents with fewer than ``least`` parts are skipped."""
    kept = docs.filter(F.size("parts") >= least)
    return kept.select("assembly_id", F.posexplode("parts").alias("part_index", "p")).select(
        "assembly_id", "part_index", "p.part_id", "p.color", "p.step_id",
        F.col("p.step_id").alias("page_num"), "p.transform",
    )


_RECORD = (
    "part_id: STRING, id: STRING, part_name: STRING, color: INT, step_id: INT, transform: STRING,"
    " position: ARRAY<DOUBLE>, pos: ARRAY<DOUBLE>, rotation: STRING, rot: STRING"
)


def _numbers(text: Column) -> Column:
    """All numbers of a JSON array, nested or flat."""
    return F.from_json(F.concat(F.lit("["), F.regexp_replace(text, r"[\[\]]", ""), F.lit("]")), "array<double>")


def normalize_record(records: DataFrame) -> DataFrame:
    """JSON part records with alias fields -> part_id, color, step_id, transform.

    Rotation may be 3x3, 9 values or a 4x4; the position then overrides the offset. A 4x4 needs its
    own shape, so 16 numbers are only taken as one when nested.
    """
    r = records.withColumn("r", F.from_json("record", f"STRUCT<{_RECORD}>"))
    rot_text = F.coalesce("r.rotation", "r.rot")
    rot = _numbers(rot_text)
    place = F.coalesce("r.position", "r.pos", F.array(*[F.lit(0.0)] * 3))
    whole = _numbers(F.col("r.transform"))
    eye = [1.0, 0.0, 0.0, 0.0, 1.0, 0.0, 0.0, 0.0, 1.0]

    def spin(k: int) -> Column:
        nested = F.get(rot, F.lit(k + k // 3))
        return F.when(F.size(rot) == 9, F.get(rot, F.lit(k))).when(F.size(rot) == 16, nested).otherwise(F.lit(eye[k]))

    built = transform_from(F.get(place, F.lit(0)), F.get(place, F.lit(1)), F.get(place, F.lit(2)), [spin(k) for k in range(9)])
    blank = lambda c: F.nullif(F.col(c), F.lit(""))
    keep = [c for c in records.columns if c != "record"]
    return r.select(
        *keep, F.coalesce(blank("r.part_id"), blank("r.id"), blank("r.part_name"), F.lit("")).alias("part_id"),
        F.coalesce("r.color", F.lit(0)).alias("color"), F.coalesce("r.step_id", F.lit(0)).alias("step_id"),
        F.when(whole.isNotNull(), whole).otherwise(built).alias("transform"),
    )


# --- Mecabricks -----------------------------------------------------------------------------------

_NODE = "id: STRING, name: STRING, color: STRING, material: STRING, matrix: ARRAY<DOUBLE>, step: INT"


def mbx_parts(scenes: DataFrame, scale: float = 2500.0) -> DataFrame:
    """assembly_id, text (scene JSON) -> placed parts in node order."""
    schema = f"STRUCT<nodes: ARRAY<STRUCT<{_NODE}>>, parts: ARRAY<STRUCT<{_NODE}>>>"
    parsed = scenes.select("assembly_id", F.from_json("text", schema).alias("j"))
    nodes = parsed.select("assembly_id", F.posexplode(F.coalesce("j.nodes", "j.parts")).alias("part_index", "n"))
    step = F.coalesce("n.step", F.lit(0))
    matrix = F.coalesce("n.matrix", F.array().cast("array<double>"))
    return nodes.select(
        "assembly_id", "part_index", map_part_id(F.coalesce("n.id", "n.name", F.lit("3005"))).alias("part_id"),
        map_color_id(F.coalesce("n.color", "n.material", F.lit("solid_light_gray"))).alias("color"),
        step.alias("step_id"), step.alias("page_num"), convert_matrix(matrix, scale).alias("transform"),
    )


# --- archives -------------------------------------------------------------------------------------

# Names that an archive's model may have, the best first.
MODEL_NAMES = ["*.mbx", "model.ldr", "modelv2.ldr", "model2.ldr", "*.[lL][dD][rR]", "document.xml"]


def _pick(names: list[str]) -> str | None:
    return next((n for pattern in MODEL_NAMES for n in names if fnmatchcase(n, pattern)), None)


def _unzip(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        rows = []
        for key, content in zip(batch["assembly_id"], batch["content"]):
            data = io.BytesIO(content)
            if not zipfile.is_zipfile(data):
                continue
            with zipfile.ZipFile(data) as archive:
                member = _pick(archive.namelist())
                if member is not None:
                    rows.append((key, member, archive.read(member).decode("utf-8", errors="ignore")))
        yield pd.DataFrame(rows, columns=["assembly_id", "member", "text"])


def archive_members(archives: DataFrame) -> DataFrame:
    """assembly_id, content (zip bytes) -> the member that holds the model. One archive per row."""
    key = archives.schema["assembly_id"].dataType.simpleString()
    return archives.select("assembly_id", "content").mapInPandas(_unzip, f"assembly_id {key}, member STRING, text STRING")


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    files = spark.read.format("binaryFile").load(path)
    name = F.element_at(F.split(F.url_decode("path"), "/"), -1)
    return files.select(F.regexp_replace(name, r"\.[^.]*$", "").alias("assembly_id"), "content")


_NO_MARKUP = r"(?s)<!--.*?-->|<!\[CDATA\[.*?\]\]>|<\?.*?\?>"  # may hold what looks like an element
_TAG = r"""<[^\s/>!]+(?:[^<>"']|"[^"]*"|'[^']*')*+>"""
_PART_TAG = r"""<Part(?=[\s/>])(?:[^<>"']|"[^"]*"|'[^']*')*+>"""
_ATTRIBUTES = ["design", "color", "tx", "ty", "tz", *[f"m{i}{j}" for i in range(3) for j in range(3)]]


def studio_xml_parts(scenes: DataFrame) -> DataFrame:
    """assembly_id, text (document.xml) -> placed parts; identity defaults, missing colour 14.

    Every Part element below the root counts, at any depth. A text that is no well-formed document has none; document types are
    not accepted, and what follows the end of the root is not checked. The parser sees the whole text once for that and then
    the start tags of the parts, so attributes are read by it and not by a pattern.
    """
    # asked for an element that no document has, the parser goes through the text and reports only whether it could
    checked = F.from_xml("text", "_corrupt_record STRING, _ STRING")["_corrupt_record"]
    sound = scenes.filter(F.col("text").isNotNull() & checked.isNull()).select("assembly_id", F.regexp_replace("text", _NO_MARKUP, "").alias("text"))
    below = F.regexp_replace("text", rf"(?s)^.*?{_TAG}", "")  # without the root's own tag
    tags = sound.select("assembly_id", F.posexplode(F.regexp_extract_all(below, F.lit(_PART_TAG), F.lit(0))).alias("part_index", "tag"))
    closed = F.concat(F.regexp_replace("tag", r"\s*/?>$", ""), F.lit("/>"))
    schema = ", ".join(f"_{name} STRING" for name in _ATTRIBUTES)
    parts = tags.withColumn("attributes", F.from_xml(closed, schema, {"ignoreSurroundingSpaces": "false"}))

    def attr(name: str) -> Column:
        return F.col(f"attributes._{name}")

    def number(name: str, default: float) -> Column:
        return F.coalesce(attr(name).try_cast("double"), F.lit(default))

    rotation = [number(f"m{i}{j}", 1.0 if i == j else 0.0) for i in range(3) for j in range(3)]
    return parts.select(
        "assembly_id", "part_index", F.concat(F.coalesce(attr("design"), F.lit("None")), F.lit(".dat")).alias("part_id"),
        F.coalesce(F.nullif(attr("color"), F.lit("")).try_cast("int"), F.lit(14)).alias("color"),
        F.lit(0).alias("step_id"), F.lit(0).alias("page_num"),
        transform_from(number("tx", 0.0), number("ty", 0.0), number("tz", 0.0), rotation).alias("transform"),
    )


# --- catalog dumps --------------------------------------------------------------------------------

# Columns of the ten dump tables. int: required number, int?: number or NULL,
# int0: number or 0, flag: t/f to 1/0, text: as is.
DUMPS = {
    "colors": [("id", "int"), ("name", "text"), ("rgb", "text"), ("is_trans", "flag")],
    "themes": [("id", "int"), ("name", "text"), ("parent_id", "int?")],
    "part_categories": [("id", "int"), ("name", "text")],
    "parts": [("part_num", "text"), ("name", "text"), ("part_cat_id", "int"), ("part_material", "text")],
    "sets": [("set_num", "text"), ("name", "text"), ("year", "int?"), ("theme_id", "int?"), ("num_parts", "int0"), ("img_url", "text")],
    "minifigs": [("fig_num", "text"), ("name", "text"), ("num_parts", "int0"), ("img_url", "text")],
    "inventories": [("id", "int"), ("version", "int"), ("set_num", "text")],
    "inventory_parts": [
        ("inventory_id", "int"),
        ("part_num", "text"),
        ("color_id", "int"),
        ("quantity", "int"),
        ("is_spare", "flag"),
        ("img_url", "text"),
    ],
    "inventory_minifigs": [("inventory_id", "int"), ("fig_num", "text"), ("quantity", "int")],
    "elements": [("element_id", "text"), ("part_num", "text"), ("color_id", "int")],
}
_CORRUPT = "_corrupt"


def dump_columns(table: str) -> list[tuple[str, str]]:
    return DUMPS[table]


def dump_schema(table: str) -> str:
    return ", ".join(f"{n} STRING" for n, _ in dump_columns(table)) + f", {_CORRUPT} STRING"


CSV_OPTIONS = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": _CORRUPT, "escape": '"', "emptyValue": ""}


def read_dump(spark: SparkSession, path: str, table: str) -> DataFrame:
    """A dump file per task; for files too large for that see ``read_large_dump``."""
    raw = spark.read.schema(dump_schema(table)).options(**CSV_OPTIONS).csv(path, header=True, multiLine=True)
    return map_dump(raw, table)


def read_large_dump(spark: SparkSession, path: str, table: str, header: bool = True) -> DataFrame:
    """Same rows, every file cut into blocks that are read side by side, also where quoted fields hold line breaks."""
    records = csv_records(read_lines(spark, path))
    if header:
        records = records.filter("line_no > 0")
    parsed = records.select(F.from_csv("record", F.lit(dump_schema(table)), CSV_OPTIONS).alias("r"))
    return map_dump(parsed.select("r.*"), table)


def map_dump(raw: DataFrame, table: str) -> DataFrame:
    """Text columns -> typed columns; short rows and unreadable numbers are dropped."""
    columns = dump_columns(table)
    last = columns[-1][0]
    good = F.col(_CORRUPT).isNull() | F.col(last).isNotNull()
    out = []
    for name, kind in columns:
        value = F.col(name)
        number = value.try_cast("int")
        filled = value.isNotNull() & (value != "")
        if kind == "text":
            out.append(F.coalesce(value, F.lit("")).alias(name))
        elif kind == "flag":
            out.append(F.when(value == "t", 1).otherwise(0).alias(name))
        elif kind == "int":
            good = good & number.isNotNull()
            out.append(number.alias(name))
        else:
            good = good & (~filled | number.isNotNull())
            out.append((F.coalesce(number, F.lit(0)) if kind == "int0" else number).alias(name))
    return raw.filter(good).select(*out)


# --- gallery --------------------------------------------------------------------------------------

_ITEM = (
    "idModel: STRING, id: STRING, name: STRING, title: STRING, creatorUsername: STRING, creator: STRUCT<username: STRING>,"
    " partsCount: STRING, pieces: STRING, likeCount: STRING, likes: STRING, viewCount: STRING, views: STRING,"
    " downloadCount: STRING, downloads: STRING, tags: STRING, description: STRING"
)


def gallery_json(responses: DataFrame) -> DataFrame:
    """Search responses (page, text) -> catalog rows; items without id are dropped."""
    schema = f"STRUCT<list: ARRAY<STRUCT<{_ITEM}>>, data: STRUCT<list: ARRAY<STRUCT<{_ITEM}>>>>"
    parsed = responses.select("page", F.from_json("text", schema).alias("j"))
    own = F.when(F.size("j.list") > 0, F.col("j.list"))
    items = parsed.select("page", F.posexplode(F.coalesce(own, "j.data.list")).alias("item_no", "i"))

    def first(*names: str) -> Column:
        return F.coalesce(*[F.nullif(F.nullif(F.col(f"i.{n}"), F.lit("")), F.lit("0")) for n in names])

    def count(*names: str) -> Column:
        return F.coalesce(first(*names).try_cast("int"), F.lit(0))

    text = lambda *names: F.coalesce(*[F.nullif(F.col(f"i.{n}"), F.lit("")) for n in names])
    creator = F.coalesce(text("creatorUsername", "creator.username"), F.lit("Unknown"))
    tags = F.when(F.col("i.tags").startswith("["), F.array_join(F.from_json("i.tags", "array<string>"), ",")).otherwise(
        F.coalesce("i.tags", F.lit(""))
    )
    model = first("idModel", "id")
    return items.filter(model.isNotNull()).select(
        "page", "item_no", model.alias("set_id"), F.coalesce(text("name", "title"), F.concat(F.lit("Model "), model)).alias("name"),
        F.lit("Studio MOC").alias("theme"), F.coalesce(text("description"), F.concat(F.lit("Studio creation by "), creator)).alias("description"),
        F.lit("BrickLink").alias("source"), count("partsCount", "pieces").alias("parts_count"), tags.alias("tags"),
        count("likeCount", "likes").alias("likes_count"), count("downloadCount", "downloads").alias("downloads_count"),
        count("viewCount", "views").alias("views_count"), creator.alias("creator_username"),
    )
