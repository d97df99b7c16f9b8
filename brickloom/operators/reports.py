"""Taxonomy reports, classification rows and metadata tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brickloom.functions.prompts import CLASSIFY, ENRICH, rendered
from brickloom.lookups import inline_table
from brickloom.operators.catalog import TAXONOMY
from brickloom.operators.scans import ordinal

# Declared taxonomy values per level, and the row used when a response is unusable.
LEVEL_1 = ["Terrestre", "Acuático", "Aéreo", "Espacial", "Multientorno"]
LEVEL_2 = [
    "Civil/Pasajeros", "Carga/Comercial", "Emergencias/Servicios", "Construccion/Industrial",
    "Competicion/Deportes", "Militar/Combate", "Ficcion/Fantasia",
]
SCALE = ["Microscale", "Minifig-scale", "UCS/Gran Escala"]
MOTION = ["Estatico", "Ruedas Libres", "Pull-back", "Motorizado"]
FALLBACK = ["Terrestre", "Civil/Pasajeros", "Desconocido", "Minifig-scale", "Ruedas Libres", "Genérico"]
PLACEHOLDER = "https://placehold.co/600x400?text=No+Image+Available"
DOMAINS = {
    "level_1_entorno": LEVEL_1,
    "level_2_proposito": LEVEL_2,
    "level_4_escala": SCALE,
    "level_4_motorizacion": MOTION,
}


def taxonomy_counts(sets: DataFrame) -> DataFrame:
    """Non-null count per taxonomy column and value, all columns in one aggregation."""
    pairs = ", ".join(f"'{c}', {c}" for c in TAXONOMY)
    return (
        sets.selectExpr(f"stack({len(TAXONOMY)}, {pairs}) AS (level, value)")
        .filter("value IS NOT NULL")
        .groupBy("level", "value")
        .agg(F.count(F.lit(1)).alias("n"))
    )


def taxonomy_cross(sets: DataFrame) -> DataFrame:
    keys = ["level_1_entorno", "level_2_proposito"]
    return sets.dropna(subset=keys).groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))


def schema_domain_counts(sets: DataFrame) -> DataFrame:
    """Declared values with zero fill plus undeclared ones, flagged."""
    rows = [(level, v) for level, values in DOMAINS.items() for v in values]
    declared = inline_table(sets.sparkSession, ["level", "value"], rows).withColumn("_d", F.lit(True))
    counts = taxonomy_counts(sets).filter(F.col("level").isin(list(DOMAINS)))
    return counts.join(declared, ["level", "value"], "full").select(
        "level", "value", F.coalesce("n", F.lit(0)).alias("n"),
        F.when(F.col("_d"), "schema").otherwise("dynamic").alias("kind"),
    )


def report_rows(sets: DataFrame, official: DataFrame) -> DataFrame:
    """Classified sets with their part count from either table."""
    off = official.select(F.col("set_num").alias("set_id"), "num_parts")
    return sets.filter("level_1_entorno IS NOT NULL").join(off, "set_id", "left").select(
        "set_id", "name", "theme", "source",
        F.coalesce("parts_count", "num_parts", F.lit(0)).alias("parts_count"),
        "level_1_entorno", "level_2_proposito", "confidence_score",
    )


def set_image_lists(sets: DataFrame, images: DataFrame) -> DataFrame:
    """Sets with their images in order; one row per image so that no list has to fit a task."""
    listed = ordinal(images.select("set_id", "image_no", "image_url"), ["set_id"], ["image_no", "image_url"], "position")
    return sets.select("set_id").join(listed.drop("image_no"), "set_id", "left")


def image_fallback(sets: DataFrame, images: DataFrame) -> DataFrame:
    """Own images, else the main image, else the placeholder."""
    rows = set_image_lists(sets, images)
    main = sets.select("set_id", F.col("image_url").alias("_main"))
    return rows.join(main, "set_id").select(
        "set_id",
        F.coalesce("position", F.lit(0)).alias("position"),
        F.coalesce("image_url", F.nullif("_main", F.lit("")), F.lit(PLACEHOLDER)).alias("image_url"),
    )


def needs_review(confidence: Column) -> Column:
    return confidence <= 0.80


def percent(confidence: Column) -> Column:
    return (confidence * 100).cast("int")


def confidence_band(confidence: Column) -> Column:
    return F.when(confidence > 0.8, "high").when(confidence > 0.5, "medium").otherwise("low")


def review_payload(name, source, confidence, level_1, level_2, level_3, notes) -> Column:
    """Review row for uncertain results, NULL otherwise."""
    row = F.struct(
        name.alias("set_name"), source.alias("source"),
        F.concat(percent(confidence).cast("string"), F.lit("%")).alias("score"),
        level_1.alias("prop_L1"), level_2.alias("prop_L2"), level_3.alias("prop_L3"), notes.alias("conflict_alert"),
    )
    return F.when(needs_review(confidence), row)


def tag_list(tags: Column, n: int = 8) -> Column:
    """Trimmed non-empty tags, the first ``n``."""
    return F.slice(F.filter(F.transform(F.split(tags, ","), lambda t: F.trim(t)), lambda t: t != ""), 1, n)


def validate_taxonomy(responses: DataFrame) -> DataFrame:
    """Stored model responses (set_id, source, name, response) -> checked taxonomy rows.

    Any missing key or undeclared value gives the fixed fallback row with confidence 0.1.
    """
    levels = ["Level_1_Entorno", "Level_2_Proposito", "Level_3_Clase", "Level_4_Escala",
              "Level_4_Motorizacion", "Level_4_Licencia"]
    schema = (
        "taxonomy_proposal STRUCT<" + ", ".join(f"{v}: STRING" for v in levels)
        + ">, confidence_score STRING, reasoning_notes STRING"
    )
    parsed = responses.withColumn("j", F.from_json("response", schema))
    tax = [F.col(f"j.taxonomy_proposal.{v}") for v in levels]
    stated = F.col("j.confidence_score")
    conf = F.when(stated.isNull(), 0.5).otherwise(stated.try_cast("double"))
    good = tax[0].isin(LEVEL_1) & tax[1].isin(LEVEL_2) & tax[3].isin(SCALE) & tax[4].isin(MOTION)
    good = F.coalesce(good & tax[2].isNotNull() & tax[5].isNotNull() & conf.isNotNull(), F.lit(False))
    picked = [F.when(good, t).otherwise(F.lit(d)).alias(c) for t, d, c in zip(tax, FALLBACK, TAXONOMY)]
    out = parsed.select(
        "set_id", "source", "name", *picked,
        F.when(good, conf).otherwise(0.1).alias("confidence_score"),
        F.when(good, F.coalesce("j.reasoning_notes", F.lit("No notes provided.")))
        .otherwise("Inference failure").alias("reasoning_notes"),
    )
    c = F.col("confidence_score")
    return out.withColumns(
        {
            "needs_human_review": needs_review(c).cast("int"),
            "review_table_payload": F.to_json(
                review_payload(F.col("name"), F.col("source"), c, F.col(TAXONOMY[0]), F.col(TAXONOMY[1]),
                               F.col(TAXONOMY[2]), F.col("reasoning_notes"))
            ),
        }
    )


def source_metadata(sets: DataFrame, official: DataFrame, themes: DataFrame, geometry: DataFrame) -> DataFrame:
    """One metadata row per set of the three sources; ``geometry`` holds set_id, n_parts and 3-D metrics."""
    dims = themes.select(F.col("id").alias("theme_id"), F.col("name").alias("_theme"))
    named = official.join(dims, "theme_id", "left")
    blurb = F.concat(F.lit("Official LEGO Set "), "set_num", F.lit(": "), "name", F.lit(" under theme "),
                     F.coalesce("_theme", F.lit("None")), F.lit("."))
    first = named.select(
        F.col("set_num").alias("set_id"), "name", F.coalesce("_theme", F.lit("Unknown")).alias("theme"), "year",
        blurb.alias("description"), F.col("num_parts").alias("parts_count"), F.lit("").alias("tags"),
        F.col("img_url").alias("image_url"), F.lit("Official").alias("source"),
    )
    default = F.when(F.col("source") == "BrickLink", "Studio MOC").otherwise("Unknown")
    own = sets.filter(F.col("source").isin("BrickLink", "OMR")).select(
        "set_id", "name", F.coalesce(F.nullif("theme", F.lit("")), default).alias("theme"), "year",
        F.coalesce("description", F.lit("")).alias("description"), F.coalesce("parts_count", F.lit(0)).alias("parts_count"),
        F.coalesce("tags", F.lit("")).alias("tags"), "image_url", "source",
    )
    measured = [c for c in geometry.columns if c not in ("set_id", "n_parts")]
    filled = own.join(geometry, "set_id", "left").withColumn(
        "parts_count",
        F.when(F.col("parts_count") == 0, F.coalesce("n_parts", F.lit(0))).otherwise(F.col("parts_count")),
    )
    shaped = filled.select(
        *[c for c in own.columns],
        F.when(F.col("n_parts").isNotNull(), F.struct(*measured)).alias("metadata_3d"),
    )
    return shaped.unionByName(first, allowMissingColumns=True)


def prompt_table(metadata: DataFrame) -> DataFrame:
    """The classification request of every metadata row: set_id, the model's instructions (system) and the row's own text (prompt)."""

    def line(label, column):
        return F.concat(F.lit(f"{label}: "), F.coalesce(column.cast("string"), F.lit("None")), F.lit("\n"))

    # Field labels, in order.
    fields = [
        ("Set ID", "set_id"), ("Origen", "source"), ("Nombre", "name"), ("Temática", "theme"), ("Año", "year"),
        ("Descripción", "description"), ("Tags del usuario", "tags"), ("Cantidad de piezas", "parts_count"),
    ]
    body = [line(label, F.col(c)) for label, c in fields]
    shape = line("Metadatos 3D del diseño", F.coalesce(F.to_json("metadata_3d"), F.lit("{}")))
    has_image = F.coalesce(F.col("image_url") != "", F.lit(False))
    note = F.when(has_image, "\n[IMAGEN DE ENTRADA DISPONIBLE Y PROCESADA MULTIMODALMENTE]").otherwise(
        "\n[ATENCIÓN: NO HAY IMAGEN DISPONIBLE. Confianza máxima reducida por falta de visual.]"
    )
    return metadata.select("set_id", F.lit(CLASSIFY).alias("system"), F.concat(*body, shape, note).alias("prompt"))


def enrichment_prompts(parts: DataFrame, themes: DataFrame) -> DataFrame:
    """The enrichment request of every part (part_num, name) within its theme (part_num, theme, description): part_num, prompt.

    Repeated parts have a request each; parts without a theme row have none.
    """
    return parts.select("part_num", "name").join(themes.select("part_num", "theme", "description"), "part_num").select(
        "part_num", rendered(ENRICH).alias("prompt")
    )
