"""Ordered scans per key (row numbers, running sums, lag, carry-forward) that survive a hot key.

A window partitioned by one key runs in one task per key. When every key is small that is the best
plan, so a cheap count decides. Otherwise the rows are range-partitioned on (key, order), scanned
inside each range, and corrected with one offset row per (key, range).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from brickloom.session import durable, max_group_rows

_SEG = "_seg"
_POS = "_pos"


def group_sizes(df: DataFrame, keys: list[str]) -> tuple[int, int]:
    """(rows of the largest key, rows in total); counts are combined map-side."""
    row = (
        df.groupBy(*keys)
        .count()
        .agg(F.max("count").alias("m"), F.sum("count").alias("t"))
        .first()
    )
    return int(row.m or 0), int(row.t or 0)


def fits(df: DataFrame, keys: list[str]) -> bool:
    """True when every key is small enough for one window task; lets several scans share one check."""
    return group_sizes(df, keys)[0] <= max_group_rows(df.sparkSession)


def scan(
    df: DataFrame,
    keys: list[str],
    order: list[Column | str],
    rank: str | None = None,
    sums: dict[str, Column] | None = None,
    lags: dict[str, Column] | None = None,
    lasts: dict[str, Column] | None = None,
    maxes: dict[str, Column] | None = None,
    bounded: bool = False,
) -> DataFrame:
    """Add ordered-scan columns. ``order`` must be total within ``keys``.

    rank: 0-based row number. sums: running inclusive sums (NULL counts as 0). lags: value of the
    previous row. lasts: latest non-null value so far. maxes: greatest value so far. ``bounded`` skips the size check where the
    caller has already limited the rows per key.
    """
    order = [F.col(c) if isinstance(c, str) else c for c in order]
    sums, lags, lasts, maxes = sums or {}, lags or {}, lasts or {}, maxes or {}
    limit = max_group_rows(df.sparkSession)
    largest, total = (0, 0) if bounded else group_sizes(df, keys)
    if largest <= limit:
        return _scan_plain(df, keys, order, rank, sums, lags, lasts, maxes)
    return _scan_ranges(df, keys, order, rank, sums, lags, lasts, maxes, max(2, 2 * total // limit))


def _scan_plain(df, keys, order, rank, sums, lags, lasts, maxes):
    w = Window.partitionBy(*keys).orderBy(*order)
    upto = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    out = {}
    if rank:
        out[rank] = F.row_number().over(w) - 1
    for name, value in sums.items():
        out[name] = F.sum(F.coalesce(value, F.lit(0))).over(upto)
    for name, value in lags.items():
        out[name] = F.lag(value).over(w)
    for name, value in lasts.items():
        out[name] = F.last(value, ignorenulls=True).over(upto)
    for name, value in maxes.items():
        out[name] = F.max(value).over(upto)
    return df.withColumns(out)


def _scan_ranges(df, keys, order, rank, sums, lags, lasts, maxes, ranges):
    ranged = df.repartitionByRange(ranges, *[F.col(k) for k in keys], *order)
    # the range number must not change between the two uses below, hence the durable cut
    ranged = durable(ranged.withColumn(_SEG, F.spark_partition_id()))
    ranged = ranged.withColumns({f"_src_{n}": v for n, v in lags.items()})
    local = _scan_plain(ranged, [*keys, _SEG], order, _POS, sums, lags, lasts, maxes)

    carried = [*sums, *[f"_src_{n}" for n in lags], *lasts, *maxes]
    tails = local.groupBy(*keys, _SEG).agg(
        F.count(F.lit(1)).alias("_n"),
        F.max_by(F.struct(F.col(_POS), *carried), F.col(_POS)).alias("_tail"),
    )
    w = Window.partitionBy(*keys).orderBy(_SEG)
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    offsets = tails.select(
        *keys,
        _SEG,
        F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_off_rank"),
        *[F.sum(f"_tail.{n}").over(before).alias(f"_off_{n}") for n in sums],
        *[F.lag(f"_tail._src_{n}").over(w).alias(f"_off_{n}") for n in lags],
        *[F.last(f"_tail.{n}", ignorenulls=True).over(before).alias(f"_off_{n}") for n in lasts],
        *[F.max(f"_tail.{n}").over(before).alias(f"_off_{n}") for n in maxes],
    )
    joined = local.join(offsets, [*keys, _SEG])
    fixed = {n: F.col(n) + F.coalesce(F.col(f"_off_{n}"), F.lit(0)) for n in sums}
    fixed |= {n: F.when(F.col(_POS) == 0, F.col(f"_off_{n}")).otherwise(F.col(n)) for n in lags}
    fixed |= {n: F.coalesce(F.col(n), F.col(f"_off_{n}")) for n in lasts}
    fixed |= {n: F.greatest(n, f"_off_{n}") for n in maxes}
    if rank:
        fixed[rank] = (F.col(_POS) + F.col("_off_rank")).cast("int")
    joined = joined.withColumns(fixed)
    names = [*df.columns, *([rank] if rank else []), *sums, *lags, *lasts, *maxes]
    return joined.select(*dict.fromkeys(names))


def as_of(events: DataFrame, states: DataFrame, keys: list[str], order: list[str], columns: list[str]) -> DataFrame:
    """Add to every event ``columns`` of the latest state of its key that comes strictly before it, NULL where there is none.

    Both sides have ``keys`` and ``order``. They are laid into one ordered scan that carries the state forward, so a hot key
    is cut into ranges like in every scan, and no event meets more than one state. Equal times: an event does not see a state of its own time.
    """
    held = F.struct(*columns)
    kind = states.select(held.alias("s")).schema["s"].dataType
    left = events.select(*keys, *order, F.lit(0).alias("_late"), F.struct(*events.columns).alias("_event"), F.lit(None).cast(kind).alias("_state"))
    none = F.lit(None).cast(left.schema["_event"].dataType)
    right = states.select(*keys, *order, F.lit(1).alias("_late"), none.alias("_event"), held.alias("_state"))
    carried = scan(left.unionByName(right), keys, [*order, "_late"], lasts={"_held": F.col("_state")})
    return carried.filter("_event IS NOT NULL").select("_event.*", "_held.*")


def ordinal(df, keys, order, name, bounded=False) -> DataFrame:
    """0-based position of each row within its key."""
    return scan(df, keys, order, rank=name, bounded=bounded)


def first_per_key(df: DataFrame, keys: list[str], order: list[Column | str]) -> DataFrame:
    """First row per key as a combinable aggregate, so a hot key never sits in one task.

    ``order`` holds ascending, orderable columns; NULL sorts first.
    """
    order = [F.col(c) if isinstance(c, str) else c for c in order]
    rest = [c for c in df.columns if c not in keys]
    picked = df.groupBy(*keys).agg(
        F.min_by(F.struct(*rest), F.struct(*order)).alias("_row")
    )
    return picked.select(*keys, "_row.*")


def top_per_key(df: DataFrame, keys: list[str], order: list[Column], n: int, rank: str) -> DataFrame:
    """First ``n`` rows per key with a 1-based rank, cut down inside salts before the final pass.

    Each salt keeps its own first ``n``; the winners of all salts then hold the winners overall.
    """
    salt = F.pmod(F.xxhash64(*df.columns), F.lit(64))
    part = Window.partitionBy(*keys, "_salt").orderBy(*order)
    full = Window.partitionBy(*keys).orderBy(*order)
    cut = (
        df.withColumn("_salt", salt)
        .withColumn("_r", F.row_number().over(part))
        .filter(F.col("_r") <= n)
        .drop("_salt", "_r")
    )
    return cut.withColumn(rank, F.row_number().over(full)).filter(F.col(rank) <= n)


def all_of(columns: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, columns)


def opaque(condition: Column) -> Column:
    """A filter on computed geometry as one unit.

    Left bare, every conjunct becomes a constraint that the optimizer rewrites for each alias above
    it, which takes seconds of planning on wide pose columns and never prunes anything here.
    """
    return F.coalesce(condition, F.lit(False))
