"""Compositions: dataset documents per file, catalog scans and ingestion."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brickloom.functions.text import set_number, source_from_id, source_from_path, theme_family
from brickloom.operators.catalog import inventory_counts
from brickloom.operators.graph import set_connectivity, subassemblies
from brickloom.operators.scans import group_sizes
from brickloom.operators.sequencing import sequence_index, size_filter
from brickloom.operators.spatial import SMALL, contact_edges_directed
from brickloom.sinks.ldraw import assembly_documents
from brickloom.sources.ldraw import (
    failed_files, file_header_meta, file_header_meta_plain, ldraw_parts, leading_block_meta, mpd_flatten,
)
from brickloom.session import durable


def normalized_path_pick(sets: DataFrame, files: DataFrame) -> DataFrame:
    """First existing of ``id.ldr``, ``omr_id.ldr``, ``id-1.ldr``; NULL when none is listed."""
    tries = F.array(
        F.concat("set_id", F.lit(".ldr")), F.concat(F.lit("omr_"), "set_id", F.lit(".ldr")), F.concat("set_id", F.lit("-1.ldr"))
    )
    asked = sets.select("set_id", F.posexplode(tries).alias("rank", "file_name"))
    hit = asked.join(files.select("file_name").distinct(), "file_name", "left_semi")
    best = hit.groupBy("set_id").agg(F.min_by("file_name", "rank").alias("file_name"))
    return sets.join(best, "set_id", "left").select("set_id", "file_name")


def good_lines(lines: DataFrame) -> DataFrame:
    """Lines of the files that can be read. The lines are read for it once, and not again with every use of the result."""
    failed = durable(failed_files(lines))
    return lines if failed.isEmpty() else lines.join(failed, "assembly_id", "left_anti")


def assembly_dataset(lines: DataFrame, least: int = 1, below: int = 100) -> dict[str, DataFrame]:
    """Flatten, filter by size, number, and give documents, graph edges and a status per file."""
    good = good_lines(lines)
    longest = group_sizes(good, ["assembly_id"])[0]
    # short files stay where they lie, so that nothing of them moves in what follows; other ones are stored
    parts = mpd_flatten(good, longest=longest)
    parts = parts if longest <= SMALL else durable(parts)
    small = size_filter(parts, least, below)
    name = F.col("assembly_id").cast("string")
    names = good.select("assembly_id").distinct().select(
        "assembly_id", name.alias("set_name"), set_number(name).alias("set_number")
    )
    ordered = sequence_index(small, bounded=True)
    indexed = ordered.withColumn("part_index", F.col("sequence_index").cast("int"))
    sizes = parts.groupBy("assembly_id").agg(F.count(F.lit(1)).alias("n"))
    status = lines.select("assembly_id").distinct().join(sizes, "assembly_id", "left").select(
        "assembly_id", F.coalesce("n", F.lit(0)).alias("num_parts"),
        F.coalesce((F.col("n") >= least) & (F.col("n") < below), F.lit(False)).alias("processed"),
    )
    return {"documents": assembly_documents(ordered, names), "edges": contact_edges_directed(indexed), "status": status}


def catalog_scan(lines: DataFrame) -> DataFrame:
    """Catalog entry per flat file: pieces, theme, family and source by file name."""
    readable = good_lines(lines)
    pieces = ldraw_parts(readable).groupBy("assembly_id").agg(F.count(F.lit(1)).alias("pieces"))
    return leading_block_meta(readable).join(pieces, "assembly_id", "left").select(
        "assembly_id", source_from_id(F.col("assembly_id").cast("string")).alias("source"), "name",
        F.coalesce("pieces", F.lit(0)).alias("pieces"), "theme", theme_family(F.col("theme")).alias("family"),
    )


def index_files(lines: DataFrame, files: DataFrame, listing: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Set rows and inventory of raw files. files: assembly_id, file_path; listing: file_name."""
    readable = good_lines(lines)
    parts = durable(mpd_flatten(readable))
    counts = parts.groupBy("assembly_id").agg(F.count(F.lit(1)).cast("int").alias("parts_count"))
    picked = normalized_path_pick(files.select(F.col("assembly_id").alias("set_id")), listing)
    sets = (
        file_header_meta(readable)
        .join(files, "assembly_id")
        .join(counts, "assembly_id", "left")
        .join(picked.withColumnRenamed("set_id", "assembly_id"), "assembly_id", "left")
        .select(
            F.col("assembly_id").alias("set_id"), "name", "theme",
            F.concat(F.lit("Modeled by "), "author").alias("description"),
            source_from_path(F.col("file_path")).alias("source"), "file_path",
            F.col("file_name").alias("normalized_file_path"), F.coalesce("parts_count", F.lit(0)).alias("parts_count"),
        )
    )
    return sets, inventory_counts(parts).withColumnRenamed("assembly_id", "set_id")


def ingest_models(lines: DataFrame, files: DataFrame) -> dict[str, DataFrame]:
    """Parse, connect and describe model files: rows for sets, subassemblies and inventory.

    files: assembly_id, file_path, source. Synthetic models and files without parts give nothing.
    """
    kept = good_lines(lines).filter(
        ~F.col("assembly_id").contains("Synthetic") & ~F.col("assembly_id").startswith("9999-")
    )
    parts = durable(mpd_flatten(kept))
    subs = durable(subassemblies(parts))
    counts = parts.groupBy("assembly_id").agg(F.count(F.lit(1)).cast("int").alias("parts_count"))
    head = file_header_meta_plain(kept).join(files, "assembly_id")
    studio = (F.col("source") == "BrickLink") & (F.col("theme") == "Unknown")
    sets = (
        head.join(counts, "assembly_id")
        .join(set_connectivity(subs), "assembly_id")
        .select(
            F.col("assembly_id").alias("set_id"), "name", F.when(studio, "Studio MOC").otherwise(F.col("theme")).alias("theme"),
            "source", "file_path", "parts_count", F.col("subassembly_count").cast("int").alias("subassemblies_count"),
            F.col("fully_connected").cast("int").alias("is_fully_connected"),
        )
    )
    rows = subs.select(
        F.col("assembly_id").alias("set_id"), "subassembly_id", F.col("parts_count").cast("int").alias("parts_count"),
        F.to_json("parts_list").alias("parts_list"), F.col("is_grounded").cast("int").alias("is_grounded"),
    )
    return {"sets": sets, "subassemblies": rows, "inventory": inventory_counts(parts).withColumnRenamed("assembly_id", "set_id")}
