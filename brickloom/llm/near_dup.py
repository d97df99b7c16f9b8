"""Near duplicates: an inverted join over the coordinates of MinHash signatures.

Every different text is posted under its signature's (coordinate, value) pairs. Two texts that agree in at least ``matches``
coordinates share one of any ``coordinates - matches + 1`` of them, so a text is posted only under its rarest ones: values of one
text need no posting, and long lists are skipped by all texts that have rarer values. Links are confirmed on whole sets of
shingles, in two steps that never list all pairs of a group of copies:

Ids, counts and pairs grow with the corpus, so the joins that carry texts or postings are merge joins at every size.

1. within a posting list every text meets the list's most central one, and confirmed links make components;
2. in the lists that still hold several components, the texts outside the list's largest component meet all others, in blocks
   of bounded size whose tasks give only links between components.

After that every pair that shares a prefix list has been compared or lies within one component.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brickloom.llm.common import stored
from brickloom.llm.links import components

_PRIME = np.uint64(0x9E3779B97F4A7C15)


@dataclass(frozen=True)
class NearParams:
    shingle: int = 5  # words
    percent: int = 80  # least similarity of linked texts
    coordinates: int = 20
    matches: int = 8  # a pair at 80 % agrees in fewer with a probability of about 1e-5
    outside: int = 256  # rows of a block, texts outside the largest component
    inside: int = 512  # and texts of the list


class WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) > 500_000:
            self.clear()
        self[word] = h = xxhash.xxh64_intdigest(word)
        return h


def shingles(text: str | None, size: int, known: WordHashes) -> tuple[np.ndarray, bytes]:
    """The different shingles' hashes in order, and a digest of the word sequence; both empty without words."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: lowers A-Z, splits at ASCII white space
    if not words:
        return np.empty(0, np.uint64), b""
    w = np.array([known[x] for x in words], np.uint64)
    n = max(1, len(w) - size + 1)
    h = np.zeros(n, np.uint64)
    for k in range(min(size, len(w))):
        h = (h ^ w[k : k + n]) * _PRIME
        h ^= h >> np.uint64(29)
    if len(w) < size:
        h = h + np.uint64(len(w))
    return np.unique(h), xxhash.xxh3_128_digest(w.tobytes())


def signature(h: np.ndarray, coordinates: int) -> np.ndarray:
    """Least value of every coordinate's own mixing of the hashes."""
    out = np.empty(coordinates, np.uint64)
    for c in range(coordinates):
        x = (h ^ np.uint64((c + 1) * 0x632BE59BD9B4E019 & 0xFFFFFFFFFFFFFFFF)) * np.uint64(0xD6E8FEB86659FD93)
        x ^= x >> np.uint64(32)
        x *= np.uint64(0xD6E8FEB86659FD93)
        out[c] = (x >> np.uint64(32)).min()
    return out


def sign(documents: DataFrame, p: NearParams) -> DataFrame:
    """documents(doc_id, text) -> doc_id, key, n_shingles, postings (one long per coordinate, none for an empty set)."""
    offset = np.arange(p.coordinates, dtype=np.uint64) << np.uint64(32)

    def run(batches):
        known = WordHashes()
        for b in batches:
            keys, sizes, posts = [], [], []
            for text in b["text"]:
                h, key = shingles(text.as_py(), p.shingle, known)
                keys.append(key)
                sizes.append(len(h))
                posts.append((signature(h, p.coordinates) | offset).astype(np.int64) if len(h) else [])
            yield pa.RecordBatch.from_arrays(
                [b["doc_id"], pa.array(keys, pa.binary()), pa.array(sizes, pa.int64()), pa.array(posts, pa.list_(pa.int64()))],
                names=["doc_id", "key", "n_shingles", "postings"],
            )

    return documents.select("doc_id", "text").mapInArrow(run, "doc_id long, key binary, n_shingles long, postings array<long>")


def _enough(common, total, percent: int):
    return 100 * common >= percent * (total - common)


def _confirm(pairs: DataFrame, texts: DataFrame, p: NearParams) -> DataFrame:
    """pairs(a, b) whose texts are similar enough; the sets of a run of equal a are made once."""

    def run(batches):
        known, last, own = WordHashes(), None, None
        for batch in batches:
            a, b = [], []
            for x, y, s, t in zip(batch["a"].to_pylist(), batch["b"].to_pylist(), batch["ta"], batch["tb"], strict=True):
                s = s.as_py()
                if s != last:
                    last, own = s, shingles(s, p.shingle, known)[0]
                h = shingles(t.as_py(), p.shingle, known)[0]
                if _enough(len(np.intersect1d(own, h, assume_unique=True)), len(own) + len(h), p.percent):
                    a.append(x)
                    b.append(y)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    one = texts.select(F.col("node").alias("a"), F.col("text").alias("ta"))
    two = texts.select(F.col("node").alias("b"), F.col("text").alias("tb"))
    return pairs.hint("merge").join(two, "b").hint("merge").join(one, "a").select("a", "b", "ta", "tb").mapInArrow(run, "a long, b long")


def _between(rows: pd.DataFrame, others: pd.DataFrame, p: NearParams) -> set[tuple[int, int]]:
    """Pairs of components that a row outside links with a row of the list."""
    known = WordHashes()
    sets = [[shingles(t, p.shingle, known)[0] for t in d["text"]] for d in (rows, others)]
    sizes = [np.array([len(h) for h in s]) for s in sets]
    flat = [np.concatenate(s) for s in sets]
    common = np.intersect1d(np.unique(flat[0]), np.unique(flat[1]), assume_unique=True)
    shared = np.zeros((len(rows), len(others)), np.float32)
    place = [np.searchsorted(common, f) for f in flat]
    owner = [np.repeat(np.arange(len(s)), s) for s in sizes]
    held = [common[np.minimum(q, len(common) - 1)] == f if len(common) else np.zeros(len(f), bool) for q, f in zip(place, flat, strict=True)]
    for first in range(0, len(common), 8192):
        parts = []
        for side, n in ((0, len(rows)), (1, len(others))):
            m = np.zeros((n, min(8192, len(common) - first)), np.float32)
            use = held[side] & (place[side] >= first) & (place[side] < first + 8192)
            m[owner[side][use], place[side][use] - first] = 1
            parts.append(m)
        shared += parts[0] @ parts[1].T
    ca, cb = rows["component"].to_numpy(), others["component"].to_numpy()
    linked = _enough(shared.astype(np.int64), sizes[0][:, None] + sizes[1][None], p.percent) & (ca[:, None] != cb[None])
    i, j = np.nonzero(linked)
    return set(zip(np.minimum(ca[i], cb[j]).tolist(), np.maximum(ca[i], cb[j]).tolist(), strict=True))


def _rest(lists: DataFrame, labels: DataFrame, texts: DataFrame, p: NearParams) -> DataFrame:
    """Links (a, b) between components within the lists that hold several of them."""
    rows = stored(lists.select("post", "node").join(labels, "node", "left").select("post", "node", F.coalesce("component", "node").alias("component")))
    sizes = rows.groupBy("post", "component").count()
    open_ = (
        sizes.groupBy("post")
        .agg(F.sum("count").alias("n"), F.count(F.lit(1)).alias("kinds"), F.max(F.struct("count", "component")).alias("most"))
        # lists of two have been compared by the star
        .filter("kinds > 1 AND n > 2")
        .select(
            "post",
            F.col("most.component").alias("major"),
            F.ceil((F.col("n") - F.col("most.count")) / p.outside).cast("int").alias("outer"),
            F.ceil(F.col("n") / p.inside).cast("int").alias("inner"),
        )
    )
    open_ = stored(open_)
    spread = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    member = rows.join(open_, "post")
    all_ = member.select("post", spread("outer").alias("i"), F.pmod(F.xxhash64("node"), "inner").cast("int").alias("j"), "node", "component", F.lit(False).alias("out"))
    out = member.filter("component <> major").select(
        "post", F.pmod(F.xxhash64("node"), "outer").cast("int").alias("i"), spread("inner").alias("j"), "node", "component", F.lit(True).alias("out")
    )

    def meet(d: pd.DataFrame) -> pd.DataFrame:
        found = _between(d[d["out"]], d[~d["out"]], p) if d["out"].any() and not d["out"].all() else set()
        return pd.DataFrame(sorted(found), columns=["a", "b"], dtype="int64")

    blocks = all_.union(out).hint("merge").join(texts, "node")
    return blocks.groupBy("post", "i", "j").applyInPandas(meet, "a long, b long").distinct()


def near_duplicates(documents: DataFrame, p: NearParams = NearParams()) -> DataFrame:
    """documents(doc_id, text) -> doc_id, n_shingles, component_id, kept.

    Null and empty texts, and those without words, have no shingle and are linked with nothing. Different texts whose least
    doc_id is the same are one document. A row without doc_id is linked with nothing, has no component and is kept. Equal texts are one component.
    Further columns are not used; an empty table gives no row.
    """
    signed = stored(sign(documents, p))
    # one node per different text: copies are counted off before anything is compared
    kinds = stored(
        signed.filter("n_shingles > 0 AND doc_id IS NOT NULL").groupBy("key").agg(F.min("doc_id").alias("node"), F.first("postings").alias("postings"))
    )
    posts = kinds.select("node", F.explode("postings").alias("post"))
    counts = stored(posts.groupBy("post").count().filter("count > 1"))
    prefix = (
        posts.join(counts.hint("merge"), "post").groupBy("node").agg(F.sort_array(F.collect_list(F.struct("count", "post"))).alias("own"))
        .filter(F.size("own") >= p.matches)
        .select("node", F.aggregate("own", F.lit(0).cast("long"), lambda a, x: a + x["count"]).alias("weight"), F.slice("own", F.lit(1), F.size("own") - p.matches + 1).alias("own"))
    )
    lists = stored(prefix.select("node", "weight", F.explode("own.post").alias("post")))
    involved = lists.select("node").distinct()
    texts = stored(documents.select(F.col("doc_id").alias("node"), "text").filter("node IS NOT NULL").join(involved.hint("merge"), "node", "left_semi"))
    centres = stored(lists.groupBy("post").agg(F.max(F.struct("weight", "node")).alias("c")).select("post", F.col("c.node").alias("a")))
    star = stored(lists.join(centres, "post").filter("node <> a").select("a", F.col("node").alias("b")).distinct())
    links = stored(_confirm(star, texts, p))
    first = components(links)
    more = components(stored(_rest(lists, first, texts, p)))
    joined = first.select("node", F.col("component").alias("inner"))
    outer = more.select(F.col("node").alias("inner"), F.col("component").alias("outer"))
    named = joined.join(outer, "inner", "left").select("node", F.coalesce("outer", "inner").alias("component"))
    alone = more.join(first.select("node"), "node", "left_anti").select("node", "component")
    labels = stored(kinds.select("key", "node").join(named.union(alone), "node", "left").select("key", F.coalesce("component", "node").alias("component")))
    out = signed.select("doc_id", "key", "n_shingles").join(labels, "key", "left")
    component = F.when(F.col("n_shingles") > 0, F.least("component", "doc_id")).otherwise(F.col("doc_id"))
    component = F.when(F.col("doc_id").isNotNull(), component)
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))
