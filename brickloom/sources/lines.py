"""Numbered lines and quoted records of large text files, read in blocks by many tasks.

A file is cut into blocks like any text file, so no task holds a whole one. A line's number is its place in its block plus the
lines of the blocks before it; the table of blocks has one row per block and is all that is ordered.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brickloom.operators.scans import fits, scan
from brickloom.session import durable

#: Rows up to which a stored side table is broadcast; a larger one is joined by its key.
BROADCAST_ROWS = 100_000

# one line of comma-separated fields; \z because $ would also match before a last line separator
_BODY = r'[^"]*+(?:""[^"]*+)*+'
_FIELDS = rf'(?:[^",][^,]*+,|"{_BODY}"[^,]*+,|,)*+'
_OPENS = rf'^{_FIELDS}"{_BODY}\z'
_STAYS = rf'^{_BODY}(?:\z|"[^,]*+,{_FIELDS}"{_BODY}\z)'


def _sided(stored: DataFrame) -> DataFrame:
    """``stored`` (a written table), marked for broadcast where its rows are few."""
    return F.broadcast(stored) if stored.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else stored


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """file_path, line_no (long, from 0 in every file), line; blocks of spark.sql.files.maxPartitionBytes.

    Lines end with LF, CR LF or CR. What follows the last line end is a line only if it is not empty, so an empty file has none.
    Compressed files that cannot be cut are one block.
    """
    raw = spark.read.text(path).select(
        F.col("_metadata.file_path").alias("file_path"), F.col("_metadata.file_block_start").alias("_block"),
        F.monotonically_increasing_id().alias("_at"), F.col("value").alias("line"),
    )
    blocks = raw.groupBy("file_path", "_block").agg(F.min("_at").alias("_first"), F.count(F.lit(1)).alias("_n"))
    # blocks of one file are few enough for a window: the driver lists all of them to plan the scan
    ends = durable(scan(blocks, ["file_path"], ["_block"], sums={"_end": F.col("_n")}, bounded=True))
    before = ends.select("file_path", "_block", (F.col("_end") - F.col("_n") - F.col("_first")).alias("_shift"))
    return raw.join(_sided(before), ["file_path", "_block"]).select("file_path", (F.col("_at") + F.col("_shift")).alias("line_no"), "line")


def csv_records(lines: DataFrame) -> DataFrame:
    """file_path, line_no (of its first line), record: the records of comma-separated files, quoted line breaks included.

    Every line maps the state before it (inside quotes or not) to the state after it. Such maps combine in any order, so the
    state of all lines is a scan over the few that change it, not a walk through the file. Only records of several lines are
    grouped, and only by themselves; a record is one row, so a quote that never closes makes the rest of its file one row.
    Quotes inside an unquoted field are text. Blank lines outside quotes are no records; line breaks in records become LF.
    """
    opens, stays = F.col("line").rlike(_OPENS), F.col("line").rlike(_STAYS)
    marks = lines.select("file_path", "line_no", opens.alias("opens"), stays.alias("stays")).filter("opens OR NOT stays")
    marks = durable(marks)
    blank = F.trim("line") == ""
    broken = marks.filter("opens").select("file_path").distinct()
    if broken.isEmpty():
        return lines.filter(~blank).select("file_path", "line_no", F.col("line").alias("record"))
    marks = marks.join(broken, "file_path", "left_semi")
    small = fits(marks, ["file_path"])
    key, order = ["file_path"], ["line_no"]
    swaps = F.col("opens") & ~F.col("stays")
    turned = scan(marks, key, order, sums={"_turns": swaps.cast("int")}, bounded=small)
    fixed = F.when(F.col("opens") == F.col("stays"), (F.col("opens").cast("int") + F.col("_turns")) % 2)
    turned = scan(turned, key, order, lasts={"_fixed": fixed}, bounded=small)
    after = turned.select("file_path", "line_no", ((F.coalesce("_fixed", F.lit(0)) + F.col("_turns")) % 2).alias("inside"))
    after = scan(after, key, order, lags={"_was": F.col("inside")}, bounded=small)
    edges = scan(after.filter(F.col("inside") != F.coalesce("_was", F.lit(0))), key, order, rank="_k", bounded=small)
    spans = edges.groupBy("file_path", F.floor(F.col("_k") / 2).alias("_pair")).agg(
        F.min("line_no").alias("start"), F.max("line_no").alias("end"), F.count(F.lit(1)).alias("n")
    )
    last = lines.join(broken, "file_path", "left_semi").groupBy("file_path").agg(F.max("line_no").alias("last"))
    spans = spans.join(last, "file_path").withColumn("end", F.when(F.col("n") == 2, F.col("end")).otherwise(F.col("last")))
    members = durable(spans.select("file_path", "start", F.explode(F.sequence("start", "end")).alias("line_no")))
    placed = lines.join(_sided(members), ["file_path", "line_no"], "left")
    single = placed.filter(F.col("start").isNull() & ~blank).select("file_path", "line_no", F.col("line").alias("record"))
    pieces = F.array_sort(F.collect_list(F.struct("line_no", "line")))
    joined = placed.filter("start IS NOT NULL").groupBy("file_path", "start").agg(
        F.array_join(F.transform(pieces, lambda p: p["line"]), "\n").alias("record")
    )
    return single.unionByName(joined.withColumnRenamed("start", "line_no"))
