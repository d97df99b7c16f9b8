"""Links, set numbers and counters out of HTML text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brickloom.functions.text import labelled_count
from brickloom.operators.catalog import last_per_key

REFS = r'(?:src|href)="([^"]+)"'
MODEL_IDS = r"idModel=([0-9]+)"
_EDGE = r"[\p{L}\p{N}_]"
FULL_NUMBER = rf"(?<!{_EDGE})([0-9]{{3,6}}-[0-9]+)(?!{_EDGE})"
BARE_NUMBER = r">\s*([0-9]{3,6})\s*<"


def found(html: Column, pattern: str) -> Column:
    """Distinct captures of a pattern."""
    return F.array_distinct(F.regexp_extract_all(html, F.lit(pattern), F.lit(1)))


def html_refs(pages: DataFrame, key: str = "page_id", pattern: str = REFS) -> DataFrame:
    return pages.select(key, F.explode(found(F.col("html"), pattern)).alias("url"))


def distinct_union_urls(pages: DataFrame, key: str, patterns: list[str]) -> DataFrame:
    """Union of the captures of several patterns, each URL once per page."""
    lists = [F.regexp_extract_all(F.col("html"), F.lit(p), F.lit(1)) for p in patterns]
    merged = lists[0]
    for other in lists[1:]:
        merged = F.array_union(merged, other)
    return pages.select(key, F.explode(F.array_distinct(merged)).alias("url"))


def html_set_index(pages: DataFrame, key: str = "page_id", link: str = r'href="([^"]+)"', window: int = 1500) -> DataFrame:
    """set_num -> url. A number in the text after a link counts for it, in short and full form; later
    pages (then later links) win."""
    links = pages.select(key, "html", F.explode(found(F.col("html"), link)).alias("url"))
    near = links.select(key, "url", F.expr(f"substring(html, instr(html, url), {window})").alias("near"))
    full = F.regexp_extract("near", FULL_NUMBER, 1)
    bare = F.regexp_extract("near", BARE_NUMBER, 1)
    numbers = F.when(full != "", F.array(F.substring_index(full, "-", 1), full)).when(bare != "", F.array(bare))
    rows = near.select(key, "url", F.explode(numbers).alias("set_num"))
    return last_per_key(rows, ["set_num"], [key, "url"]).select("set_num", "url")


def set_page_lookup(wanted: DataFrame, index: DataFrame) -> DataFrame:
    """Exact key, else the least key that starts with the wanted number.

    Every key is spread over its own prefixes that can be asked for, so the fallback is an equi-join.
    """
    ids = wanted.select("set_num").distinct()
    exact = ids.join(index, "set_num").withColumn("key", F.col("set_num"))
    rest = ids.join(index, "set_num", "left_anti")
    prefix = F.explode(F.sequence(F.lit(1), F.greatest(F.length("key") - 1, F.lit(1))))
    spread = index.withColumnRenamed("set_num", "key").withColumn("_n", prefix).filter("_n < length(key)").select(
        "key", "url", F.expr("substring(key, 1, _n)").alias("set_num")
    )
    near = rest.join(spread, "set_num").groupBy("set_num").agg(
        F.min("key").alias("key"), F.min_by("url", "key").alias("url")
    )
    return exact.select("set_num", "key", "url").unionByName(near)


def html_counts(pages: DataFrame, key: str = "page_id") -> DataFrame:
    html = F.col("html")
    return pages.select(
        key, labelled_count(html, "Downloads").alias("downloads"), labelled_count(html, "Views").alias("views")
    )
