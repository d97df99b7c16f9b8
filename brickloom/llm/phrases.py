"""Collocations: phrases of two to four words that occur together more often than their parts do, per language.

A prefix of two words bounds every phrase that grows from it: cutting a grown phrase after its first word leaves a part no rarer
than the phrase itself, and the phrase is no more frequent than its prefix, so no score passes 2a / (f(first word) + a) with the
prefix's count a. Prefixes are therefore opened best bound first. Opening one counts, in a pass over the texts, everything of
three and four words that begins with it or has it as words two and three; this settles the prefix and all that grows from it, as a
phrase is dropped by a longer one only if a phrase of one more word drops it. Rounds go on until no closed prefix of a language reaches
the score of its 2000th surviving phrase, ties included. A four-word phrase whose last three words are not counted yet has a
bound only; while that reaches the 2000th score, the rarer prefix inside it is opened as well.

The prefixes of a round are the only thing that tasks get from the driver, and at most ``slice`` of them.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brickloom.llm.common import stored
from brickloom.operators.scans import top_per_key

_SCHEMA = "lang string, phrase string, a long"
_STOP = b"."
_SALTS = 64
# A-Z lowered, tabs as blanks, every mark that ends a piece as one and the same; all of them ASCII, so UTF-8 stays whole
_TABLE = bytes(
    ord(".") if c in b".,;:!?\n\x0b\x0c\r" else ord(" ") if c == 9 else c + 32 if 65 <= c <= 90 else c for c in range(256)
)


@dataclass(frozen=True)
class PhraseParams:
    least: int = 30  # occurrences of a candidate
    top: int = 2000  # phrases of a language
    percent: int = 80  # share of a phrase's occurrences inside a longer one that drops it
    first: int = 3  # prefixes of a language opened in the first round, as a multiple of top
    slice: int = 60_000  # prefixes opened in one round, all languages
    flush: int = 800_000  # words a task holds before it hands on their counts


def tokens(text: bytes) -> list[bytes]:
    """Words of a text in order, with a full stop wherever a piece ends."""
    return text.translate(_TABLE).replace(_STOP, b" . ").split()


def _rows(lang: str, counts: np.ndarray, phrases):
    """Batches of lang, phrase, a; ``phrases`` gives the phrases from one place to another."""
    for at in range(0, len(counts), 65_536):
        n = counts[at : at + 65_536]
        yield pa.RecordBatch.from_arrays([pa.repeat(pa.scalar(lang), len(n)), phrases(at, at + len(n)), pa.array(n, pa.int64())], names=["lang", "phrase", "a"])


class _Numbers(dict):
    """Words numbered as they come; the mark between pieces is 0."""

    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self)
        return n


def _roots(p: PhraseParams):
    """Counts of words, of pairs and (under the empty phrase) of all words, added up inside each task first."""

    def counts(lang, parts, words):
        ids = np.concatenate(parts)
        one, n = np.unique(ids[ids > 0], return_counts=True)
        yield from _rows(lang, np.array([n.sum()]), lambda a, b: pa.array([""]))
        yield from _rows(lang, n, lambda a, b: words.take(pa.array(one[a:b])))
        both = (ids[:-1] > 0) & (ids[1:] > 0)
        two, n = np.unique(ids[:-1][both].astype(np.int64) << 32 | ids[1:][both], return_counts=True)
        side = lambda x: words.take(pa.array(x))
        yield from _rows(lang, n, lambda a, b: pc.binary_join_element_wise(side(two[a:b] >> 32), side(two[a:b] & 0xFFFFFFFF), " "))

    def run(batches):
        numbers, held, n = _Numbers({_STOP: 0}), defaultdict(list), 0

        def flush():
            words = pa.array(list(numbers), pa.binary()).cast(pa.string())
            while held:
                yield from counts(*held.popitem(), words)

        stop = np.zeros(1, np.int32)
        for batch in batches:
            for lang, text in zip(batch["lang"].to_pylist(), batch["text"], strict=True):
                found = tokens(text.as_py())
                held[lang] += (np.fromiter(map(numbers.__getitem__, found), np.int32, len(found)), stop)
                n += len(found)
                if n >= p.flush:
                    yield from flush()
                    numbers, n = _Numbers({_STOP: 0}), 0
        if held:
            yield from flush()

    return run


class _Known(dict):
    """Numbers of the words of open prefixes; -1 for any other word, remembered for a while."""

    def __init__(self, words):
        super().__init__(words)
        self.words = words

    def __missing__(self, word: bytes) -> int:
        if len(self) > len(self.words) + 100_000:
            self.clear()
            self.update(self.words)
        self[word] = -1
        return -1


def _growth(prefixes: list[tuple[str, str]]):
    """Counts of the phrases of three and four words that have an open prefix as their words 1 and 2 or 2 and 3."""

    def given(counts):
        for lang, c in counts.items():
            phrases = list(c)
            yield from _rows(lang, np.fromiter(c.values(), np.int64, len(c)), lambda a, b, x=phrases: pa.array(x[a:b], pa.binary()).cast(pa.string()))

    def run(batches):
        words, codes = {_STOP: -2}, defaultdict(list)
        for lang, phrase in prefixes:
            a, b = (words.setdefault(w, len(words)) for w in phrase.encode().split(b" "))
            codes[lang].append(a << 32 | b)
        codes = {lang: np.sort(np.array(c)) for lang, c in codes.items()}
        known, counts, held = _Known(words), defaultdict(Counter), 0
        for batch in batches:
            for lang, text in zip(batch["lang"].to_pylist(), batch["text"], strict=True):
                if lang not in codes:
                    continue
                found = tokens(text.as_py())
                g = np.fromiter(map(known.__getitem__, found), np.int64, len(found))
                at = np.flatnonzero((g[:-1] >= 0) & (g[1:] >= 0))
                code = g[at] << 32 | g[at + 1]
                own = codes[lang]
                at = at[own[np.minimum(np.searchsorted(own, code), len(own) - 1)] == code]
                starts = np.union1d(at, at - 1)
                whole = np.append(g != -2, np.zeros(4, bool))
                starts = starts[starts >= 0]
                starts = starts[whole[starts] & whole[starts + 1] & whole[starts + 2]]
                out = counts[lang]
                before = len(out)
                out.update([b" ".join(found[i : i + 3]) for i in starts.tolist()])
                out.update([b" ".join(found[i : i + 4]) for i in starts[whole[starts + 3]].tolist()])
                held += len(out) - before
                if held > 120_000:
                    yield from given(counts)
                    counts, held = defaultdict(Counter), 0
        yield from given(counts)

    return run


def _score(a: str, l: str, r: str):
    """floor(2000000 a / (l + r)); decimals hold the product, which passes 64 bits at counts above 4.6e12."""
    return F.expr(f"CAST({a} AS DECIMAL(20, 0)) * 2000000 DIV (CAST({l} AS DECIMAL(20, 0)) + {r})")


def _words(phrase: str = "phrase"):
    return F.length(phrase) - F.length(F.replace(F.col(phrase), F.lit(" "), F.lit(""))) + 1


def _settle(known: DataFrame, opened: DataFrame, p: PhraseParams) -> DataFrame:
    """Candidates below open prefixes: lang, phrase, a, score, l, r of the lowest cut, exact (else the score is a bound)."""
    sized = known.filter("phrase <> ''").withColumn("m", _words()).filter("m > 1")
    prefix = F.substring_index("phrase", " ", 2)
    own = sized.withColumn("prefix", prefix).join(opened.withColumnRenamed("phrase", "prefix"), ["lang", "prefix"], "left_semi")
    grown = sized.filter("m > 2").withColumn(
        "part", F.explode(F.array(F.expr("substring_index(phrase, ' ', m - 1)"), F.expr("substring_index(phrase, ' ', 1 - m)")))
    )
    longest = grown.groupBy("lang", F.col("part").alias("phrase")).agg(F.max("a").alias("longest"))
    alive = (
        own.join(longest, ["lang", "phrase"], "left")
        .filter(f"longest IS NULL OR 100 * longest < {p.percent} * a")
        .select("lang", "phrase", "a", "m", F.explode(F.expr("sequence(1, m - 1)")).alias("k"))
    )
    cuts = alive.withColumns({"left": F.expr("substring_index(phrase, ' ', k)"), "right": F.expr("substring_index(phrase, ' ', k - m)")})
    lefts = known.select("lang", F.col("phrase").alias("left"), F.col("a").alias("l"))
    rights = known.select("lang", F.col("phrase").alias("right"), F.col("a").alias("r"))
    scored = cuts.join(lefts, ["lang", "left"]).join(rights, ["lang", "right"], "left")
    # an uncounted right part is at least as frequent as the phrase, which leaves a bound
    scored = scored.withColumn("score", _score("a", "l", "coalesce(r, a)"))
    best = scored.groupBy("lang", "phrase", "a").agg(
        F.min(F.struct("score", "k", "l", "r")).alias("cut"), F.bool_and(F.col("r").isNotNull()).alias("exact")
    )
    return best.select("lang", "phrase", "a", "cut.score", "cut.l", "cut.r", "exact")


def _closed(nodes: DataFrame, opened: DataFrame | None, candidates: DataFrame | None, p: PhraseParams) -> DataFrame:
    """Prefixes (lang, phrase, bound) that could still hold one of the first ``top`` phrases of their language."""
    if opened is None:
        return nodes.select("lang", "phrase", "bound")
    exact = candidates.filter("exact").select("lang", "phrase", "score")
    floor = top_per_key(exact, ["lang"], [F.desc("score"), F.col("phrase")], p.top, "rank").filter(F.col("rank") == p.top)
    # a language may hold a third of all prefixes, so its floor goes to several places
    floor = floor.select("lang", F.col("score").alias("floor"), F.explode(F.sequence(F.lit(0), F.lit(_SALTS - 1))).alias("salt"))

    def reach(df: DataFrame, of: str) -> DataFrame:
        salted = df.withColumn("salt", F.pmod(F.xxhash64("phrase"), F.lit(_SALTS)).cast("int"))
        return salted.join(floor, ["lang", "salt"], "left").filter(f"{of} >= coalesce(floor, 0)").drop("floor", "salt")

    open_bound = reach(nodes.join(opened, ["lang", "phrase"], "left_anti").select("lang", "phrase", "bound"), "bound")
    unsure = reach(candidates.filter("NOT exact").select("lang", "phrase", "score"), "score")
    inner = F.substring_index(F.substring_index("phrase", " ", 3), " ", -2)
    unsure = unsure.select(
        "lang", F.col("phrase").alias("whole"), F.col("score").alias("bound"),
        F.explode(F.array(inner, F.substring_index("phrase", " ", -2))).alias("phrase"),
    )
    rarer = unsure.join(nodes.select("lang", "phrase", "a"), ["lang", "phrase"]).groupBy("lang", "whole", "bound").agg(
        F.min(F.struct("a", "phrase")).alias("least")
    )
    wanted = rarer.select("lang", F.col("least.phrase").alias("phrase"), "bound")
    return open_bound.union(wanted).groupBy("lang", "phrase").agg(F.max("bound").alias("bound"))


def mine(documents: DataFrame, p: PhraseParams = PhraseParams()) -> DataFrame:
    """documents(lang, text) -> lang, rank, phrase, a, l, r, n, score: the first ``top`` phrases of every language.

    A null language is ``und``; null and empty texts have no words. Whole texts of any length are read; repeated rows count again; ties of
    score and count are ordered by the phrase's bytes. Further columns are not used; an empty table gives no row.
    """
    docs = documents.select(
        F.coalesce("lang", F.lit("und")).alias("lang"), F.coalesce("text", F.lit("")).cast("binary").alias("text")
    )
    total = lambda rows: rows.groupBy("lang", "phrase").agg(F.sum("a").alias("a"))
    counts = stored(total(docs.mapInArrow(_roots(p), _SCHEMA)).filter((F.col("a") >= p.least) | (F.col("phrase") == "")))
    pairs = counts.filter("instr(phrase, ' ') > 0")
    first = counts.select("lang", F.col("phrase").alias("w1"), F.col("a").alias("l"))
    nodes = stored(
        pairs.withColumn("w1", F.substring_index("phrase", " ", 1)).join(first, ["lang", "w1"])
        .select("lang", "phrase", "a", _score("a", "l", "a").alias("bound"))
    )
    spark, opened, candidates, grown = documents.sparkSession, None, None, []
    while True:
        closed = _closed(nodes, opened, candidates, p)
        each = p.slice if grown else p.first * p.top
        best = top_per_key(closed, ["lang"], [F.desc("bound"), F.col("phrase")], each, "rank").orderBy("rank", "lang").limit(p.slice)
        prefixes = [(r.lang, r.phrase) for r in best.collect()]
        if not prefixes and candidates is not None:
            break
        more = spark.createDataFrame(prefixes, "lang string, phrase string")
        opened = stored(more if opened is None else opened.union(more))
        grown.append(stored(total(docs.mapInArrow(_growth(prefixes), _SCHEMA)).filter(F.col("a") >= p.least)))
        # a phrase met in several rounds has the same count in each
        longer = reduce(DataFrame.union, grown).groupBy("lang", "phrase").agg(F.max("a").alias("a"))
        candidates = stored(_settle(counts.union(longer), opened, p))
    exact = candidates.filter("exact").drop("exact")
    ranked = top_per_key(exact, ["lang"], [F.desc("score"), F.desc("a"), F.col("phrase")], p.top, "rank")
    words = counts.filter("phrase = ''").select("lang", F.col("a").alias("n"))
    return ranked.join(words, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
