"""Instruction-manual geometry: boxes, labels, page inventories, templates and pools."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brickloom.functions.text import count_codes
from brickloom.operators.grouped import map_groups
from brickloom.operators.scans import first_per_key, scan
from brickloom.operators.spatial import SMALL, all_small, join_by
from brickloom.session import durable

_PAGE_CELL = 50.0
_SALTS = 32


def _spread(df: DataFrame, spans: dict[str, tuple[Column, Column]], size: float) -> DataFrame:
    for name, (low, high) in spans.items():
        df = df.withColumn(name, F.explode(F.sequence(F.floor(low / size), F.floor(high / size))))
    return df


def box_containment(drawings: DataFrame, quantities: DataFrame, pages: DataFrame) -> DataFrame:
    """Callout boxes: sized between 20 and 70 % of the page, filled in the callout gray, holding a quantity.

    drawings: page_id, box_id, x0..y1, fill_r, fill_g; quantities: page_id, qx, qy; pages: page_id, width, height.
    """
    wide, tall = F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")
    sized = (wide > 20) & (wide < F.col("width") * 0.7) & (tall > 20) & (tall < F.col("height") * 0.7)
    gray = [(F.col(c) > 0.35) & (F.col(c) < 0.45) for c in ("fill_r", "fill_g")]
    boxes = drawings.join(pages, "page_id").filter(sized & gray[0] & gray[1]).drop("width", "height")
    inside = F.col("qx").between(F.col("x0") - 5, F.col("x1") + 5) & F.col("qy").between(F.col("y0") - 5, F.col("y1") + 5)
    crowd = quantities.groupBy("page_id").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > SMALL).select("page_id")

    def meet(boxes: DataFrame, points: DataFrame) -> DataFrame:
        points = points.select(F.col("page_id").alias("_page"), "qx", "qy")
        return boxes.join(points, (F.col("page_id") == F.col("_page")) & inside, "left_semi")

    # few quantities meet the boxes on the page alone; only boxes of crowded pages are listed in all their cells
    if crowd.isEmpty():
        return meet(boxes, quantities)
    few = meet(boxes, quantities.join(crowd, "page_id", "left_anti"))
    boxes, quantities = (df.join(crowd, "page_id", "left_semi") for df in (boxes, quantities))
    spans = {"gx": (F.col("x0") - 5, F.col("x1") + 5), "gy": (F.col("y0") - 5, F.col("y1") + 5)}
    shape = ["page_id", "x0", "y0", "x1", "y1"]  # boxes drawn several times are looked at once
    cells = _spread(boxes.select(*shape).distinct(), spans, _PAGE_CELL)
    points = quantities.select(
        "page_id", "qx", "qy", F.floor(F.col("qx") / _PAGE_CELL).alias("gx"), F.floor(F.col("qy") / _PAGE_CELL).alias("gy")
    ).distinct()
    held = cells.join(points, ["page_id", "gx", "gy"]).filter(inside).select(*shape).distinct()
    return few.unionByName(boxes.join(held, shape, "left_semi").select(*boxes.columns))


def box_dedupe(boxes: DataFrame) -> DataFrame:
    """Drop a box within 2 units (all four sides) of an earlier kept one of its page.

    Equal boxes follow their first copy. Among distinct boxes every round keeps those without an
    undecided or kept earlier neighbour and drops those next to a kept one, as the walk would.
    """
    sides = ["x0", "y0", "x1", "y1"]
    # boxes of small pages meet on the page where it lies; others meet in grid cells
    small = all_small(boxes, "page_id")
    first = boxes.groupBy("page_id", *sides).agg(F.min("box_id").alias("box_id"))
    left = first.select("page_id", "x0", "y0", F.col("box_id").alias("late"), *[F.col(s).alias(f"l_{s}") for s in sides])
    right = first.select("page_id", "x0", "y0", F.col("box_id").alias("early"), *[F.col(s).alias(f"e_{s}") for s in sides])
    joint: dict[str, str] = {}
    if not small:
        spans = {f"g_{s}": (F.col(s) - 2, F.col(s) + 2) for s in sides[:2]}
        left = _spread(left, spans, 4.0)
        right = right.withColumns({f"g_{s}": F.floor(F.col(s) / 4.0) for s in sides[:2]})
        joint = {g: g for g in spans}
    near = F.col("early") < F.col("late")
    for s in sides:
        near = near & (F.abs(F.col(f"l_{s}") - F.col(f"e_{s}")) < 2)
    met = join_by(left.drop("x0", "y0"), right.drop("x0", "y0"), joint, small, key="page_id")
    links = met.filter(near).select("page_id", "early", "late")
    if small:
        schema = f"page_id {boxes.schema['page_id'].dataType.simpleString()}, box_id {boxes.schema['box_id'].dataType.simpleString()}"
        dropped = map_groups(links, "page_id", [], _dropped, schema)
        return join_by(first, dropped, {"box_id": "box_id"}, small, "left_anti", "page_id").select("page_id", "box_id", *sides)
    links = durable(links)
    # boxes that have a neighbour; the others are kept as they are
    state = durable(
        links.select("page_id", F.col("early").alias("box_id")).unionByName(
            links.select("page_id", F.col("late").alias("box_id"))
        ).distinct().withColumn("kept", F.lit(None).cast("boolean"))
    )
    while True:
        seen = state.select("page_id", F.col("box_id").alias("early"), "kept")
        verdict = links.join(seen, ["page_id", "early"]).groupBy("page_id", F.col("late").alias("box_id")).agg(
            F.max(F.coalesce("kept", F.lit(False))).alias("hit"), F.max(F.col("kept").isNull()).alias("open")
        )
        settled = F.when(F.coalesce("hit", F.lit(False)), False).when(~F.coalesce("open", F.lit(False)), True)
        state = durable(
            state.join(verdict, ["page_id", "box_id"], "left").select(
                "page_id", "box_id", F.coalesce("kept", settled).alias("kept")
            )
        )
        if state.filter("kept IS NULL").isEmpty():
            break
    dropped = state.filter(~F.col("kept")).select("page_id", "box_id")
    return first.join(dropped, ["page_id", "box_id"], "left_anti").select("page_id", "box_id", *sides)


def _dropped(links: pd.DataFrame) -> pd.DataFrame:
    """Boxes that the rounds of ``box_dedupe`` drop, for all links of whole small pages at once."""
    group, pages = pd.factorize(links["page_id"])
    names, name = np.unique(np.concatenate([links["early"], links["late"]]), return_inverse=True)
    codes, node = np.unique(np.concatenate([group, group]).astype(np.int64) * len(names) + name, return_inverse=True)
    early, late = node[: len(links)], node[len(links) :]
    kept, gone = np.zeros(len(codes), dtype=bool), np.zeros(len(codes), dtype=bool)
    while not (kept | gone).all():
        left = ~(kept | gone)
        hit, waits = np.zeros(len(codes), dtype=bool), np.zeros(len(codes), dtype=bool)
        hit[late[kept[early]]] = True
        waits[late[left[early]]] = True
        gone |= left & hit
        kept |= left & ~hit & ~waits
    return pd.DataFrame({"page_id": pages[codes[gone] // len(names)], "box_id": names[codes[gone] % len(names)]})


def label_above(codes: DataFrame, words: DataFrame) -> DataFrame:
    """Quantity of an element code: the first quantity word right above it, 1 by default.

    codes: page_id, code_id, ex0, ey0; words: page_id, word_no, wx0, wy1, qty.
    """
    spans = {"gx": (F.col("ex0") - 40, F.col("ex0") + 40), "gy": (F.col("ey0") - 30, F.col("ey0"))}
    # words, and codes, that share a place on the page are looked at once
    place = ["page_id", "ex0", "ey0"]
    seek = _spread(codes.select(*place).distinct(), spans, 40.0)
    leading = first_per_key(words.select("page_id", "wx0", "wy1", "word_no", "qty"), ["page_id", "wx0", "wy1"], ["word_no", "qty"])
    give = leading.withColumns({"gx": F.floor(F.col("wx0") / 40.0), "gy": F.floor(F.col("wy1") / 40.0)})
    rise = F.col("ey0") - F.col("wy1")
    hits = seek.join(give, ["page_id", "gx", "gy"]).filter(
        (F.abs(F.col("wx0") - F.col("ex0")) < 40) & (rise > 0) & (rise < 30)
    ).select(*place, "word_no", "qty")
    best = first_per_key(hits, place, ["word_no", "qty"]).select(*place, "qty")
    return codes.join(best, place, "left").select(
        "page_id", "code_id", F.coalesce("qty", F.lit(1)).alias("qty")
    )


def dense_code_pages(pages: DataFrame, last: int = 10, least: int = 5) -> DataFrame:
    """Pages among the last ten of a manual with at least five element codes."""
    ends = pages.groupBy("manual_id").agg((F.max("page_no") + 1).alias("_n"))
    tail = pages.join(ends, "manual_id").filter(F.col("page_no") >= F.greatest(F.col("_n") - last, F.lit(0)))
    return tail.withColumn("codes", count_codes(F.col("text"))).filter(F.col("codes") >= least).select(
        "manual_id", "page_no", "codes"
    )


def distinct_candidates(pool: DataFrame) -> DataFrame:
    """First occurrence of every (part, colour) per manual."""
    return pool.groupBy("manual_id", "part_id", "color").agg(F.min("item_no").alias("item_no"))


def page_assignment(inventory: DataFrame, pages: DataFrame) -> DataFrame:
    """Give every single part of the inventory to a page by cumulative quantity.

    inventory: manual_id, line_no, part_id, color, qty; pages: manual_id, page_no, page_qty. Parts
    beyond the last page get one extra step.
    """
    lines = scan(inventory, ["manual_id"], ["line_no"], sums={"_end": F.col("qty")})
    units = lines.filter("qty > 0").select(
        "manual_id", "line_no", "part_id", "color",
        F.explode(F.sequence(F.col("_end") - F.col("qty"), F.col("_end") - 1)).alias("pos"),
    )
    steps = scan(pages, ["manual_id"], ["page_no"], rank="_k", sums={"_end": F.col("page_qty")})
    starts = steps.filter("page_qty > 0").select(
        "manual_id", (F.col("_end") - F.col("page_qty")).alias("pos"), (F.col("_k") + 1).alias("_step")
    )
    rest = pages.groupBy("manual_id").agg(
        F.sum("page_qty").alias("pos"), (F.count(F.lit(1)) + 1).cast("int").alias("_step")
    )
    # markers sort before the unit at their position and are carried forward
    marks = starts.unionByName(rest.select("manual_id", "pos", "_step")).withColumn("_u", F.lit(0))
    both = units.withColumn("_u", F.lit(1)).unionByName(marks, allowMissingColumns=True)
    placed = scan(both, ["manual_id"], ["pos", "_u"], lasts={"step_id": F.col("_step")})
    return placed.filter("_u = 1").select(
        "manual_id", "pos", "line_no", "part_id", "color", F.coalesce("step_id", F.lit(1)).alias("step_id")
    )


def remaining_pool(inventory: DataFrame, placed: DataFrame) -> DataFrame:
    """Inventory minus placed per (part, colour), never below zero."""
    keys = ["manual_id", "part_id", "color"]
    have = inventory.groupBy(*keys).agg(F.sum("qty").alias("have"))
    used = placed.groupBy(*keys).agg(F.count(F.lit(1)).alias("used"))
    return have.join(used, keys, "full").select(
        *keys, F.greatest(F.coalesce("have", F.lit(0)) - F.coalesce("used", F.lit(0)), F.lit(0)).alias("remaining")
    )


def element_pieces(templates: DataFrame, designs: DataFrame) -> DataFrame:
    """manual_id, element_id, piece: substrings of the element ids, no longer or shorter than the design ids of their manual.

    templates: manual_id, element_id; designs: manual_id, piece.
    """
    reach = designs.groupBy("manual_id").agg(F.min(F.length("piece")).alias("_least"), F.max(F.length("piece")).alias("_most"))
    size = F.length("element_id")
    # an empty design id occurs in an empty element id only
    low, high = F.greatest("_least", F.least(size, F.lit(1))), F.least("_most", size)
    cuts = F.transform(
        F.sequence(low, high),
        lambda n: F.transform(F.sequence(F.lit(1), size - n + 1), lambda s: F.substring("element_id", s, n)),
    )
    return (
        templates.select("manual_id", "element_id")
        .distinct()
        .join(reach, "manual_id")
        .filter(low <= high)
        .select("manual_id", "element_id", F.explode(F.array_distinct(F.flatten(cuts))).alias("piece"))
    )


def substring_match(templates: DataFrame, candidates: DataFrame) -> DataFrame:
    """First candidate whose design id occurs in the element id, else the first candidate.

    Element ids are spread over their substrings of the lengths that the manual's design ids have, so this is an
    equi-join. templates: manual_id, element_id; candidates: manual_id, item_no, part_id.
    """
    design = F.substring_index("part_id", ".", 1)
    cand = candidates.select("manual_id", "item_no", "part_id", design.alias("piece"))
    hits = element_pieces(templates, cand).join(cand, ["manual_id", "piece"]).groupBy("manual_id", "element_id").agg(
        F.min_by("part_id", "item_no").alias("hit")
    )
    first = cand.groupBy("manual_id").agg(F.min_by("part_id", "item_no").alias("first"))
    return (
        templates.join(hits, ["manual_id", "element_id"], "left")
        .join(first, "manual_id", "left")
        .select("manual_id", "element_id", F.coalesce("hit", "first").alias("part_id"))
    )


def nearest_template(queries: DataFrame, templates: DataFrame, block_rows: int = 8192) -> DataFrame:
    """Template of the query's manual with the greatest cosine similarity (first of equals), one row per query.

    queries: manual_id, query_id, embedding; templates: manual_id, template_id, embedding. Both sides of a manual are dealt into
    blocks of about ``block_rows``, and every pair of blocks is one matrix product on the executors, which hands on the best of its
    templates for each of its queries. Similarities are equal if they agree to twelve decimals; a vector of length zero is as near as 0, and
    nothing is nearest at -1. Manuals without templates give no row.
    """
    blocks = lambda rows, name: rows.groupBy("manual_id").agg(F.ceil(F.count(F.lit(1)) / block_rows).cast("int").alias(name))
    sizes = blocks(templates, "across").join(blocks(queries, "down"), "manual_id")
    # a manual may hold a third of all rows, so its sizes go to several places
    sizes = sizes.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(_SALTS - 1))))

    def dealt(rows: DataFrame, name: str, own: str, other: str) -> DataFrame:
        h = F.xxhash64(name)
        salted = rows.select("manual_id", F.col(name).alias("id"), "embedding", F.pmod(h, F.lit(_SALTS)).cast("int").alias("salt"))
        placed = salted.join(sizes, ["manual_id", "salt"])
        each = F.explode(F.sequence(F.lit(0), F.col(other) - 1))
        # aliases: both sides may come from one table
        return placed.select(
            *[F.col(c).alias(c) for c in ("manual_id", "id", "embedding")],
            F.pmod(F.xxhash64(F.lit(1), "id"), F.col(own)).cast("int").alias(own), each.alias(other),
        )

    key = ["manual_id", "across", "down"]
    manual = queries.schema["manual_id"].dataType.simpleString()
    met = dealt(queries, "query_id", "down", "across").groupBy(*key).cogroup(
        dealt(templates, "template_id", "across", "down").groupBy(*key)
    ).applyInPandas(_best_of_block, f"manual_id {manual}, query_id long, template_id long, score double")
    first = F.struct("score", (-F.col("template_id")).alias("n"))
    best = met.groupBy("manual_id", "query_id").agg(F.max_by("template_id", first).alias("template_id"), F.max("score").alias("score"))
    return best.filter("score > -1")


def _unit(embeddings: pd.Series) -> np.ndarray:
    """Rows scaled to length one; zero rows stay zero, which makes their similarity zero."""
    matrix = np.array(embeddings.tolist(), dtype=np.float64)
    norm = np.linalg.norm(matrix, axis=1, keepdims=True)
    return np.divide(matrix, norm, out=np.zeros_like(matrix), where=norm > 0)


def _best_of_block(key: tuple, queries: pd.DataFrame, templates: pd.DataFrame) -> pd.DataFrame:
    if queries.empty or templates.empty:
        return pd.DataFrame({"manual_id": [], "query_id": [], "template_id": [], "score": []})
    templates = templates.sort_values("id")
    units, ids = _unit(templates["embedding"]), templates["id"].to_numpy()
    out = []
    for at in range(0, len(queries), 1024):
        part = queries.iloc[at : at + 1024]
        sims = np.round(_unit(part["embedding"]) @ units.T, 12)
        best = sims.argmax(axis=1)
        out.append(pd.DataFrame({"manual_id": key[0], "query_id": part["id"].to_numpy(), "template_id": ids[best], "score": sims[np.arange(len(best)), best]}))
    return pd.concat(out)
