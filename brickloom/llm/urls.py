"""URL filters: rules by host and path, and a tree of path templates per host that judges what no rule fits.

The trees grow level by level as DataFrame aggregates over (scope, template so far, segment), never per host in one task.
A segment that varies too much under its parent becomes a wildcard of its shape, sibling branches whose continuations
are distributed alike and whose labels agree share one template, and a template whose labelled pages are mostly
blocked, after smoothing towards its parents and towards the same paths of its domain and of all hosts, is rejected.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brickloom.llm.common import stored

#: (verdict, host, path); a rule fits its host and all subdomains when the path starts with the rule's path.
RULES = (
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
)


@dataclass(frozen=True)
class TreeParams:
    support: int = 5  # different paths from which a node is opened and a segment may stay literal
    share: float = 0.02  # and its least share of its parent's paths; rarer segments become wildcards
    alike: float = 0.8  # overlap of a branch's continuations with its siblings' from which it may merge
    band: float = 0.2  # branches merge only within a band of smoothed purity of this width
    weight: float = 10.0  # labelled pages that what is known before counts as


def host_of(url: Column) -> Column:
    """After the first :// up to /, ?, # or the end, A-Z lower-cased; empty without ://."""
    host = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def path_of(url: Column) -> Column:
    """What follows the host, up to ?, # or the end; empty without ://."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules=RULES) -> Column:
    """(rule, verdict) of the longest fitting rule, by host and then by path; null if none fits."""
    best = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, h, p in sorted(rules, key=lambda r: (len(r[1]) + len(r[2]), len(r[1]))):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        best = F.when(fits, F.struct(F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(best)
    return best


SCALE = 1_000_000  # purities are handed from tree to tree in whole millionths, so their sums are exact in any order


def _shape(segment: Column) -> Column:
    """Wildcard of a segment's shape: runs of digits and of letters, with the rest as it is."""
    return F.concat(F.lit("*"), F.regexp_replace(F.regexp_replace(segment, r"\p{L}+", "a"), r"[0-9]+", "0"))


def _purity(blocked: Column, labelled: Column, prior: Column, p: TreeParams) -> Column:
    return (blocked + prior * p.weight) / (labelled + p.weight)


SUMS = ("n", "labelled", "blocked", "given")
NODE = ["scope", "template"]


def _totals(rows: DataFrame, *keys: str) -> DataFrame:
    return rows.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in SUMS])


def _given() -> Column:
    return F.col("given") / (F.col("n") * F.lit(float(SCALE)))


def _grow(rows: DataFrame, p: TreeParams) -> DataFrame:
    """Append a token to the template of every path with segments left; the whole rest where few paths share the node."""
    crowd = rows.filter(F.size("rest") > 0).groupBy(*NODE).agg(F.count(F.lit(1)).alias("crowd")).filter(F.col("crowd") >= p.support)
    open_ = F.col("crowd").isNotNull() & (F.size("rest") > 0)
    here = stored(
        rows.join(crowd, NODE, "left").withColumn("segment", F.when(open_, F.get("rest", F.lit(0))))
    )
    after = F.coalesce(_shape(F.get("rest", F.lit(1))), F.lit("$"))
    children = stored(_totals(here.filter("segment IS NOT NULL").withColumn("next", after), *NODE, "crowd", "segment", "next"))
    literal = stored(
        _totals(children, *NODE, "crowd", "segment")
        .filter((F.col("n") >= p.support) & (F.col("n") >= p.share * F.col("crowd")))
        .withColumn("band", F.floor(_purity(F.col("blocked"), F.col("labelled"), _given(), p) / p.band))
        .select(*NODE, "segment", "band", F.col("n").alias("own"))
    )
    # how much of a branch's continuations it has in common with those of all literal branches of its parent and band
    flows = children.join(literal, [*NODE, "segment"])
    pool = flows.groupBy(*NODE, "band", "next").agg(F.sum("n").alias("pooled"))
    whole = literal.groupBy(*NODE, "band").agg(F.sum("own").alias("total"), F.count(F.lit(1)).alias("peers"))
    # cross-multiplied to whole numbers: least(n / own, pooled / total) summed, over own * total
    common = (
        flows.join(pool, [*NODE, "band", "next"]).join(whole, [*NODE, "band"])
        .groupBy(*NODE, "segment", "band", "own", "total", "peers")
        .agg(F.sum(F.least(F.col("n") * F.col("total"), F.col("pooled") * F.col("own"))).alias("met"))
    )
    alike = (F.col("peers") > 1) & (F.col("met") >= p.alike * F.col("own") * F.col("total"))
    token = F.when(alike, F.concat(F.lit("~"), F.col("band").cast("string"))).otherwise(F.concat(F.lit("="), "segment"))
    named = stored(common.select(*NODE, "segment", token.alias("token")))
    step = F.coalesce("token", _shape(F.col("segment")), _shape(F.array_join("rest", "/")))
    left = F.when(F.col("segment").isNull(), F.array().cast("array<string>")).otherwise(F.slice("rest", F.lit(2), F.size("rest")))
    return stored(
        here.join(named, [*NODE, "segment"], "left")
        .withColumn("template", F.when(F.size("rest") == 0, F.col("template")).otherwise(F.concat("template", F.array(step))))
        .withColumn("rest", left)
        .select(*rows.columns)
    )


def _judged(rows: DataFrame, p: TreeParams) -> DataFrame:
    """scope, template, purity of the grown leaves.

    Walking down from the root, a node's labelled pages are smoothed towards the mean of its parent's purity and of what the
    more general tree gave to its paths. Only leaves are walked, a row per level of each.
    """
    leaves = stored(_totals(rows, *NODE))
    steps = leaves.withColumn("depth", F.explode(F.sequence(F.lit(0), F.size("template")))).withColumn("prefix", F.slice("template", F.lit(1), F.col("depth")))
    nodes = _totals(steps, "scope", "prefix").select("scope", "prefix", "blocked", "labelled", _given().alias("g"))
    chain = (
        steps.select(*NODE, "depth", "prefix").join(nodes, ["scope", "prefix"])
        .groupBy(*NODE).agg(F.sort_array(F.collect_list(F.struct("depth", "blocked", "labelled", "g"))).alias("chain"))
    )
    down = lambda up, v: _purity(v["blocked"], v["labelled"], F.coalesce((up + v["g"]) / 2, v["g"]), p)
    return chain.select(*NODE, F.aggregate("chain", F.lit(None).cast("double"), down).alias("purity"))


def path_templates(pages: DataFrame, params: TreeParams = TreeParams()) -> DataFrame:
    """pages(host, path, label: 1 blocked, 0 allowed or null) -> host, path, template, purity, one row per (host, path).

    Three trees are grown one after another: of all hosts together, of the hosts of each registrable domain (the last two
    labels), and of each host. What a tree says about a path is where the next one starts, so a host without labels is
    judged by how the same templates fare elsewhere. Equal paths are counted once up front. A round per level opens the
    nodes that ``support`` or more different paths share, and what lies below smaller nodes is one wildcard, so the number
    of rounds is that of the levels that many paths have in common. No task holds a host.
    """
    parts = F.split(F.substring("path", F.lit(2), F.length("path")), "/")
    none = F.array().cast("array<string>")
    paths = stored(
        pages.groupBy("host", "path")
        .agg(F.count("label").alias("labelled"), F.coalesce(F.sum("label"), F.lit(0)).cast("long").alias("blocked"))
        .withColumn("parts", F.when(F.col("path") == "", none).otherwise(parts))
    )
    facts = paths.agg(F.sum("blocked").alias("b"), F.sum("labelled").alias("l")).first()
    base = ((facts.b or 0) + 0.5 * params.weight) / ((facts.l or 0) + params.weight)
    known = paths.withColumn("given", F.lit(_whole(base)))
    for scope in (F.lit("*"), F.substring_index("host", ".", -2), F.col("host")):
        rows = stored(known.select("host", "path", "parts", "labelled", "blocked", "given", scope.alias("scope"), none.alias("template"), F.col("parts").alias("rest"), F.lit(1).alias("n")))
        while not rows.filter(F.size("rest") > 0).isEmpty():
            rows = _grow(rows, params)
        told = rows.drop("given").join(_judged(rows, params), NODE)
        known = stored(told.withColumn("given", F.floor(F.col("purity") * SCALE + 0.5).cast("long")))
    return known.select("host", "path", F.array_join("template", "/").alias("template"), "purity")


def _whole(purity: float) -> int:
    return int(purity * SCALE + 0.5)


def threshold(tried: DataFrame) -> tuple[float, float, float]:
    """tried(purity, label, n) of hidden pages -> (threshold, share of blocked pages caught, share of allowed ones blocked).

    The middle one of the hundredths at which the difference of the two shares is greatest; 0.5 if a kind is missing.
    """
    counts = tried.groupBy(F.floor(F.col("purity") * 100).alias("step"), "label").agg(F.sum("n").alias("n")).collect()  # at most 202 rows
    kinds = {k: {r.step: r.n for r in counts if r.label == k} for k in (0, 1)}
    total = {k: sum(v.values()) for k, v in kinds.items()}
    share = lambda k, at: sum(n for s, n in kinds[k].items() if s >= at) / max(1, total[k])
    best = [50]
    if total[0] and total[1]:
        gain = {at: share(1, at) - share(0, at) for at in range(1, 101)}
        best = [at for at, g in gain.items() if g == max(gain.values())]
    at = best[len(best) // 2]
    return at / 100, share(1, at), share(0, at)


def hidden(host: Column, path: Column) -> Column:
    """A fifth of the paths, whose labels no tree sees."""
    return F.crc32(F.concat(host, F.lit("/"), path)) % 5 == 0


def judge(pages: DataFrame, rules=RULES, params: TreeParams = TreeParams()) -> DataFrame:
    """pages(page_id, url) -> page_id, host, path, rule, verdict, template, purity.

    The longest fitting rule decides. Four fifths of the paths that rules judge are the labels from which the trees learn the
    rest, and the hidden fifth sets the purity from which a template is rejected.
    A null url, or one without ://, has empty host and path, fits no rule and is judged with the empty template. Repeated
    rows give repeated results, further columns are not used, very long paths are handled whole, and an empty table gives
    an empty result.
    """
    parsed = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    ruled = parsed.withColumn("r", rule_of(F.col("host"), F.col("path"), rules)).select(
        "page_id", "host", "path", F.col("r.rule").alias("rule"), F.col("r.verdict").alias("decided")
    )
    label = F.when(F.col("decided") == "block", 1).when(F.col("decided") == "allow", 0)
    seen = F.when(~hidden(F.col("host"), F.col("path")), label)
    templates = stored(path_templates(ruled.select("host", "path", seen.alias("label")), params))
    tried = ruled.filter(hidden(F.col("host"), F.col("path"))).groupBy("host", "path", label.alias("label")).agg(F.count(F.lit(1)).alias("n"))
    at, *_ = threshold(tried.filter("label IS NOT NULL").join(templates, ["host", "path"]))
    learned = F.when(F.floor(F.col("purity") * 100) >= round(at * 100), "block").otherwise("allow")
    return ruled.join(templates, ["host", "path"], "left").select(
        "page_id", "host", "path", "rule", F.coalesce("decided", learned).alias("verdict"), "template", "purity"
    )
