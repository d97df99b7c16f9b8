"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brickloom.session import ensure_checkpoint_dir

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return add


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet").select(*columns)


def stored(df: DataFrame, codec: str = "zstd") -> DataFrame:
    """Write a table into the shared checkpoint folder and read it back: cuts the lineage and survives lost executors."""
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    path = f"{spark.sparkContext.getCheckpointDir()}/table-{uuid.uuid4().hex}"
    df.write.option("compression", codec).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


# A blank between two characters that no definition of white space includes: the pre-tokenizers in use never join text
# across it, so the pieces can be encoded one by one and remembered.
_BLANK = re.compile(r"(?<=\S) (?=\S)")


def pieces(text: str) -> list[str]:
    """Cut a text where a single blank stands between two visible characters; the blanks themselves are left out."""
    cut = text.split(" ")
    if "" in cut or " ".join(map(str.strip, cut)) != text:
        cut = _BLANK.split(text)  # some blank has white space or an end beside it
    return cut if text else []


def batched(rows: Iterable, size: int, limit_chars: int = 4_000_000):
    """Lists of rows of at most ``size`` rows; a list is also closed once its texts (first field) pass ``limit_chars``."""
    out, n = [], 0
    for row in rows:
        out.append(row)
        n += len(row[0] or "")
        if len(out) >= size or n >= limit_chars:
            yield out
            out, n = [], 0
    if out:
        yield out


def text_of(column: str = "text"):
    return F.coalesce(F.col(column), F.lit(""))
