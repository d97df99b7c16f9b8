"""Catalog maintenance: replace, insert-ignore, merge and column updates as joins.

Each function takes the stored table and the incoming rows and returns the new table, to be written
as the next version. Duplicate keys among the incoming rows are settled by combinable aggregates.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from brickloom.operators.scans import first_per_key

TAXONOMY = [
    "level_1_entorno", "level_2_proposito", "level_3_clase",
    "level_4_escala", "level_4_motorizacion", "level_4_licencia",
]
CLASSIFICATION = [*TAXONOMY, "confidence_score", "reasoning_notes", "needs_human_review", "review_table_payload"]


def last_per_key(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    rest = [c for c in df.columns if c not in keys]
    picked = df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_row"))
    return picked.select(*keys, "_row.*")


def catalog_replace(base: DataFrame, new: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """INSERT OR REPLACE: the last incoming row per key replaces the whole row."""
    latest = last_per_key(new, keys, order)
    latest = latest.select([c for c in latest.columns if c in base.columns])
    return base.join(latest, keys, "left_anti").unionByName(latest, allowMissingColumns=True)


def catalog_insert_ignore(base: DataFrame, new: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """INSERT OR IGNORE: stored rows win, then the first incoming row per key."""
    first = first_per_key(new, keys, order).join(base, keys, "left_anti")
    first = first.select([c for c in first.columns if c in base.columns])
    return base.unionByName(first, allowMissingColumns=True)


def catalog_add_columns(base: DataFrame, schema: T.StructType) -> DataFrame:
    """Add the columns of ``schema`` that are missing, as NULL."""
    have = {c.lower() for c in base.columns}
    return base.withColumns(
        {f.name: F.lit(None).cast(f.dataType) for f in schema.fields if f.name.lower() not in have}
    )


def catalog_update_columns(sets: DataFrame, results: DataFrame, official: DataFrame) -> DataFrame:
    """Store classifications: only the taxonomy columns of known sets change; unknown ones are
    inserted as official sets with whatever the official table knows."""
    hit = F.col("_r").isNotNull()
    # one result per set: the last one by time and, for equal times, by its values
    results = last_per_key(results, ["set_id"], [c for c in results.columns if c != "set_id"])
    # every joined column is renamed, so the result keeps the stored table's own names
    res = results.select("set_id", F.struct(*CLASSIFICATION).alias("_r"))
    known = sets.join(res, "set_id", "left").withColumns(
        {c: F.when(hit, F.col(f"_r.{c}")).otherwise(F.col(c)) for c in CLASSIFICATION}
    )
    info = official.select(F.col("set_num").alias("set_id"), F.col("name").alias("_name"), "year",
                           F.col("img_url").alias("image_url"), F.col("num_parts").alias("_parts"))
    fresh = (
        results.join(sets, "set_id", "left_anti")
        .join(info, "set_id", "left")
        .select("set_id", F.coalesce("_name", "set_id").alias("name"), F.lit("Official").alias("source"),
                "year", "image_url", F.coalesce("_parts", F.lit(0)).alias("parts_count"), *CLASSIFICATION)
    )
    return known.drop("_r").unionByName(fresh, allowMissingColumns=True)


def _sided(df: DataFrame, keys: list[str], name: str, columns: list[str]) -> DataFrame:
    return df.select(*keys, F.struct(*columns).alias(name))


def merge_sets(base: DataFrame, incoming: DataFrame, fill: list[str]) -> DataFrame:
    """Insert unseen sets over the common columns; fill ``fill`` where stored is NULL. Adds action."""
    common = [c for c in base.columns if c in incoming.columns and c != "set_id"]
    rest = [c for c in base.columns if c != "set_id"]
    both = _sided(base, ["set_id"], "b", rest).join(_sided(incoming, ["set_id"], "n", common), "set_id", "full")
    stored, new = F.col("b").isNotNull(), F.col("n").isNotNull()

    def value(c: str) -> Column:
        b = F.col(f"b.{c}")
        if c not in common:
            return b
        n = F.col(f"n.{c}")
        return F.coalesce(b, n) if c in fill else F.when(stored, b).otherwise(n)

    filled = [F.col(f"b.{c}").isNull() & F.col(f"n.{c}").isNotNull() for c in fill if c in common]
    changed = filled[0]
    for f in filled[1:]:
        changed = changed | f
    action = F.when(~stored, "inserted").when(new & changed, "updated").otherwise("kept")
    return both.select("set_id", *[value(c).alias(c) for c in rest], action.alias("action"))


def merge_insert_missing(base: DataFrame, incoming: DataFrame, keys: list[str]) -> DataFrame:
    """Insert only unseen keys; adds action."""
    fresh = incoming.join(base, keys, "left_anti").withColumn("action", F.lit("inserted"))
    return base.withColumn("action", F.lit("kept")).unionByName(fresh)


def merge_queue(base: DataFrame, incoming: DataFrame) -> DataFrame:
    """Insert missing models; overwrite when the incoming row is further along. Adds action."""
    cols = ["status", "attempts", "last_attempt_time", "error_msg"]
    both = _sided(base, ["model_id"], "b", cols).join(_sided(incoming, ["model_id"], "n", cols), "model_id", "full")
    stored, new = F.col("b").isNotNull(), F.col("n").isNotNull()
    ahead = (F.col("n.status").isin("completed", "failed") & (F.col("b.status") == "pending")) | (
        F.col("n.attempts") > F.col("b.attempts")
    )
    take = ~stored | (new & F.coalesce(ahead, F.lit(False)))
    action = F.when(~stored, "inserted").when(take, "updated").otherwise("kept")
    return both.select(
        "model_id", *[F.when(take, F.col(f"n.{c}")).otherwise(F.col(f"b.{c}")).alias(c) for c in cols],
        action.alias("action"),
    )


def merge_stats(merged: dict[str, DataFrame]) -> DataFrame:
    """Inserted and updated counts per merged table."""
    out = None
    for name, df in merged.items():
        one = df.agg(
            F.count_if(F.col("action") == "inserted").alias("inserted"),
            F.count_if(F.col("action") == "updated").alias("updated"),
        ).select(F.lit(name).alias("table_name"), "inserted", "updated")
        out = one if out is None else out.unionByName(one)
    return out


def catalog_json_merge(old: DataFrame, scan: DataFrame, key: str) -> DataFrame:
    """New scan entries override old ones; old-only entries stay."""
    return old.join(scan, key, "left_anti").unionByName(scan)


# --- searches -------------------------------------------------------------------------------------


def inventory_counts(parts: DataFrame) -> DataFrame:
    """Quantity per (set, lower-case part id, colour)."""
    return parts.groupBy("assembly_id", F.lower("part_id").alias("part_id"), "color").agg(
        F.count(F.lit(1)).alias("quantity")
    )


def inventory_join(sets: DataFrame, inventory: DataFrame, part: str) -> DataFrame:
    """Sets that hold a part, one row per inventory line."""
    return sets.join(inventory.filter(F.col("part_id") == part.lower()), "set_id")


def catalog_search(
    sets: DataFrame,
    inventory: DataFrame | None = None,
    part: str | None = None,
    theme: str | None = None,
    keyword: str | None = None,
    min_parts: int | None = None,
    max_parts: int | None = None,
) -> DataFrame:
    """Distinct sets under the conjuncts that are given."""
    if theme is not None:
        sets = sets.filter(F.col("theme").ilike(f"%{theme}%"))
    if keyword is not None:
        like = f"%{keyword}%"
        sets = sets.filter(F.col("name").ilike(like) | F.col("description").ilike(like))
    if min_parts is not None:
        sets = sets.filter(F.col("parts_count") >= min_parts)
    if max_parts is not None:
        sets = sets.filter(F.col("parts_count") <= max_parts)
    if part is not None:
        sets = sets.join(inventory.filter(F.col("part_id") == part.lower()), "set_id", "left_semi")
    return sets.select("set_id", "name", "theme", "parts_count", "source").distinct()


def search_top(found: DataFrame, n: int = 30) -> DataFrame:
    return found.orderBy(F.desc("parts_count"), "set_id").limit(n)


def pending_classification(sets: DataFrame, official: DataFrame, sources: list[str], limit: int) -> DataFrame:
    """Unclassified catalog rows, topped up to ``limit`` with official sets not classified yet."""
    open_rows = sets.filter(F.col("source").isin(sources) & F.col("level_1_entorno").isNull()).select(
        "set_id", "source", F.lit(0).alias("_p")
    )
    done = sets.filter(F.col("level_1_entorno").isNotNull()).select("set_id")
    extra = official.select(F.col("set_num").alias("set_id")).join(done, "set_id", "left_anti").select(
        "set_id", F.lit("Official").alias("source"), F.lit(1).alias("_p")
    )
    cut = [df.orderBy("set_id").limit(limit) for df in (open_rows, extra)]
    return cut[0].unionByName(cut[1]).orderBy("_p", "set_id").limit(limit).drop("_p")


def pending_by_null(sets: DataFrame, column: str, source: str | None = None, empty_too: bool = True) -> DataFrame:
    """Rows whose column is missing (or empty), optionally of one source."""
    gap = F.col(column).isNull()
    if empty_too:
        gap = gap | (F.col(column) == "")
    return sets.filter(gap if source is None else gap & (F.col("source") == source))


def next_pending(queue: DataFrame, n: int) -> DataFrame:
    return queue.filter("status = 'pending'").orderBy("model_id").limit(n)


def union_sources(targets: list[DataFrame]) -> DataFrame:
    out = targets[0]
    for df in targets[1:]:
        out = out.unionByName(df)
    return out


def top_inventory(inventory: DataFrame, n: int = 25) -> DataFrame:
    """Largest quantities per set with rank, number of kinds and how many are not shown."""
    from brickloom.operators.scans import top_per_key

    order = [F.desc("quantity"), F.asc("part_id"), F.asc("color")]
    top = top_per_key(inventory, ["set_id"], order, n, "rank")
    kinds = inventory.groupBy("set_id").agg(F.count(F.lit(1)).alias("kinds"))
    return top.join(kinds, "set_id").withColumn("overflow", F.greatest(F.col("kinds") - n, F.lit(0)))


# --- themes and enrichment ------------------------------------------------------------------------


def set_theme_lookup(wanted: DataFrame, official: DataFrame, themes: DataFrame) -> DataFrame:
    """Official row per wanted set_id: the same number, else the first number ``id-...``."""
    dims = themes.select(F.col("id").alias("theme_id"), F.col("name").alias("theme_name"))
    off = official.join(dims, "theme_id", "left").select(
        "set_num", "name", "year", "theme_name", "num_parts", "img_url"
    )
    ids = wanted.select("set_id").distinct()
    exact = ids.join(off, F.col("set_id") == F.col("set_num")).withColumn("_p", F.lit(0))
    # a number id-x matches id, and id may hold dashes itself: one key per dash position
    pieces = F.split("set_num", "-")
    heads = F.transform(F.sequence(F.lit(1), F.size(pieces) - 1), lambda k: F.array_join(F.slice(pieces, 1, k), "-"))
    keyed = off.filter(F.size(pieces) > 1).withColumn("set_id", F.explode(heads))
    prefixed = ids.join(keyed, "set_id").withColumn("_p", F.lit(1))
    found = exact.unionByName(prefixed)
    return first_per_key(found, ["set_id"], ["_p", "set_num"]).drop("_p")


def theme_chain(inventory_parts, inventories, official, themes) -> DataFrame:
    """inventory parts with set and theme. Dimension joins; Spark picks broadcast by size."""
    inv = inventories.select(F.col("id").alias("inventory_id"), "set_num")
    sets = official.select("set_num", "theme_id")
    dims = themes.select(F.col("id").alias("theme_id"), F.col("name").alias("theme"))
    chain = inv.join(sets, "set_num").join(dims, "theme_id")
    return inventory_parts.join(chain, "inventory_id")


def theme_like(themes: DataFrame, words: list[str]) -> DataFrame:
    hit = F.lit(False)
    for word in words:
        hit = hit | F.col("name").ilike(f"%{word}%")
    return themes.filter(hit)


def unenriched_parts(parts: DataFrame, enriched: DataFrame) -> DataFrame:
    return parts.join(enriched.select("part_num"), "part_num", "left_anti")


def enrichment_backlog(parts, inventory_parts, inventories, official, themes, enriched, words) -> DataFrame:
    """Parts not enriched yet with a priority flag for parts used in the named themes."""
    used = theme_chain(inventory_parts, inventories, official, theme_like(themes, words))
    flag = used.select("part_num").distinct().withColumn("is_priority", F.lit(1))
    return unenriched_parts(parts, enriched).join(flag, "part_num", "left").select(
        "part_num", "name", F.coalesce("is_priority", F.lit(0)).alias("is_priority")
    )


def coverage_status(inventory_parts, inventories, official, themes, enriched, words) -> DataFrame:
    """Distinct parts of the named themes: total, enriched and percent."""
    used = theme_chain(inventory_parts, inventories, official, theme_like(themes, words))
    distinct = used.select("part_num").distinct()
    done = enriched.select("part_num").distinct().withColumn("_e", F.lit(1))
    total, hit = F.count(F.lit(1)), F.count("_e")
    return distinct.join(done, "part_num", "left").agg(
        total.alias("total"), hit.alias("enriched"),
        F.when(total > 0, hit / total * 100).otherwise(0.0).alias("percentage"),
    )


# Default theme and texts for parts without or with an undescribed theme.
NO_THEME = "Universal LEGO Catalog"
NO_THEME_TEXT = (
    "Catálogo universal de piezas generales reutilizadas en todo tipo de creaciones de LEGO."
)
ANY_THEME_TEXT = "Línea de construcción creativa basada en la temática oficial de LEGO '%s'."


def dominant_theme(parts, inventory_parts, inventories, official, themes, descriptions) -> DataFrame:
    """Most frequent theme per part (ties by name) and its description."""
    counts = (
        theme_chain(inventory_parts, inventories, official, themes)
        .groupBy("part_num", "theme")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    best = counts.groupBy("part_num").agg(F.min_by("theme", F.struct(-F.col("n"), F.col("theme"))).alias("theme"))
    named = parts.select("part_num").join(best, "part_num", "left")
    text = descriptions.select("theme", "description")
    return named.join(text, "theme", "left").select(
        "part_num",
        F.coalesce("theme", F.lit(NO_THEME)).alias("theme"),
        F.when(F.col("theme").isNull(), NO_THEME_TEXT)
        .otherwise(F.coalesce("description", F.format_string(ANY_THEME_TEXT, "theme")))
        .alias("description"),
    )


def theme_root(themes: DataFrame) -> DataFrame:
    """Top ancestor of every theme by pointer doubling; themes caught in a cycle get ``Unknown``."""
    from brickloom.session import durable

    ids = themes.select(F.col("id").alias("parent_id"), F.lit(True).alias("_known"))
    up = themes.join(ids, "parent_id", "left").select(
        "id", "name", F.when(F.col("_known") & (F.col("parent_id") != 0), F.col("parent_id")).alias("up")
    )
    step = durable(up.withColumn("anc", F.coalesce("up", "id")))
    rounds = max(1, step.count()).bit_length()
    for _ in range(rounds):
        nxt = step.select(F.col("id").alias("anc"), F.col("anc").alias("far"))
        moved = durable(step.join(nxt, "anc").select("id", "name", "up", F.col("far").alias("anc"),
                                                     (F.col("far") != F.col("anc")).alias("moved")))
        step = moved.drop("moved")
        if moved.filter("moved").isEmpty():
            break
    top = step.select(F.col("id").alias("anc"), F.col("name").alias("top"), F.col("up").isNull().alias("_end"))
    return step.join(top, "anc").select(
        "id", "name", F.when(F.col("_end"), F.col("top")).otherwise("Unknown").alias("root")
    )


def present_roots(set_names: DataFrame, official: DataFrame, roots: DataFrame) -> DataFrame:
    """Distinct root themes of the sets at hand; ``num`` or ``num-1`` must be official."""
    num = F.regexp_extract("set_name", r"^([0-9]+-[0-9]+)", 1)
    wanted = set_names.select(
        F.when(num != "", num).otherwise(F.col("set_name")).alias("set_num")
    ).distinct()
    off = official.select("set_num", "theme_id")
    exact = wanted.join(off, "set_num")
    suffixed = wanted.join(exact, "set_num", "left_anti").select(
        F.concat("set_num", F.lit("-1")).alias("set_num")
    ).join(off, "set_num")
    used = exact.select("theme_id").unionByName(suffixed.select("theme_id")).distinct()
    named = used.join(roots.select(F.col("id").alias("theme_id"), "root"), "theme_id", "left")
    return named.select(F.coalesce("root", F.lit("Unknown")).alias("theme")).distinct()
