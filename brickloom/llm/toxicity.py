"""Toxicity: embeddings of words and their character n-grams, averaged over a text, into a linear softmax.

Both are trained together in numpy on a bounded sample of labelled rows. A word never seen shares its n-grams with its misspelt
or inflected relatives. As softmax and average are linear in the embeddings, scoring needs one number per n-gram: its embedding
times the difference of the two classes' weights, which the tasks sum up per word and remember.
"""

from __future__ import annotations

import zlib
from array import array
from collections import Counter
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class ToxicityParams:
    per_class: int = 800  # bound of the training sample: toxic labelled documents, those of the least hash of doc_id
    buckets: int = 1 << 18
    dim: int = 4
    shortest: int = 3  # character n-grams of the word in brackets
    longest: int = 5
    batch: int = 800  # rows of a step, fewer where the sample is small
    steps: int = 400
    rate: float = 0.5
    heat: float = 40.0  # factor of the averaged embedding before the softmax
    empty: float = 0.1  # weight of the empty text beside that of both classes
    min_docs: int = 5
    damping: float = 0.999  # quantile of the buckets' gradients below which steps shrink
    clean_share: int = 2  # clean rows of the sample for every toxic one
    excerpts: int = 8  # short excerpts of every clean row, clean as well, that steady the scores of short texts
    seed: int = 7
    models: int = 3  # trainings from different starts whose weights are averaged, which steadies small samples


def words(text: str) -> list[str]:
    return text.lower().split()


def features(word: str, p: ToxicityParams) -> list[int]:
    """Buckets of the word without surrounding punctuation and of its n-grams."""
    core = word.strip(".,;:!?\"'()[]{}<>*_-") or word
    framed = f"<{core}>"
    grams = [framed[i : i + n] for n in range(p.shortest, p.longest + 1) for i in range(len(framed) - n + 1)]
    return [zlib.crc32(g.encode()) % p.buckets for g in (core, *grams)]


@dataclass
class Model:
    weights: np.ndarray  # per bucket, the difference of the classes' logits
    bias: float
    params: ToxicityParams


class Training:
    """The sample as two sparse tables: documents to words with counts, words to buckets."""

    def __init__(self, texts: list[str], p: ToxicityParams):
        vocabulary: dict[str, int] = {}
        docs, ids, counts = [], [], []
        for d, text in enumerate(texts):
            for w, n in Counter(words(text)).items():
                docs.append(d)
                ids.append(vocabulary.setdefault(w, len(vocabulary)))
                counts.append(n)
        # equal buckets of a word count as often as they occur, as in scoring
        buckets, sizes = array("i"), array("i")
        for w in vocabulary:
            own = features(w, p)
            buckets.extend(own)
            sizes.append(len(own))
        self.size = np.array(sizes, np.int64)
        # only buckets that occur are trained; positions fit 32 bits, which halves what the driver holds
        self.used, feature = np.unique(np.array(buckets, np.int32), return_inverse=True)
        self.feature = feature.astype(np.int32)
        self.word_of = np.repeat(np.arange(len(sizes), dtype=np.int32), self.size)
        self.by_feature = np.argsort(self.feature, kind="stable").astype(np.int32)
        self.feature_starts = np.searchsorted(self.feature[self.by_feature], np.arange(len(self.used))).astype(np.int32)
        self.doc, self.word = np.array(docs, np.int32), np.array(ids, np.int32)
        counts = np.array(counts, np.float64)
        total = np.bincount(self.doc, counts * self.size[self.word], len(texts)) if len(docs) else np.ones(len(texts))
        self.share = (counts / np.maximum(total, 1)[self.doc]).astype(np.float32) if len(docs) else counts
        self.by_word = np.argsort(self.word, kind="stable").astype(np.int32)
        self.word_starts = np.searchsorted(self.word[self.by_word], np.arange(len(sizes))).astype(np.int32)
        self.word_ends = np.concatenate([[0], np.cumsum(self.size)])[:-1]
        self.doc_starts = np.searchsorted(self.doc, np.arange(len(texts)))
        self.filled = np.bincount(self.doc, minlength=len(texts)) > 0

    def average(self, e: np.ndarray) -> np.ndarray:
        """Mean embedding of every document; zero for one without words."""
        by_word = np.add.reduceat(e[self.feature], self.word_ends, axis=0)
        rows = by_word[self.word] * self.share[:, None]
        out = np.zeros((len(self.filled), e.shape[1]), np.float32)
        out[self.filled] = np.add.reduceat(rows, self.doc_starts[self.filled], axis=0)
        return out

    def documents(self, buckets: int) -> np.ndarray:
        """Number of word occurrences by document of every bucket; a word counts once per document."""
        per_word = np.bincount(self.word, minlength=len(self.size))
        return np.bincount(self.used[self.feature], per_word[self.word_of], buckets).astype(np.int64)

    def spread(self, g: np.ndarray) -> np.ndarray:
        """Gradient of the embeddings from that of the documents' averages."""
        rows = (g[self.doc] * self.share[:, None])[self.by_word]
        by_word = np.add.reduceat(rows, self.word_starts, axis=0)
        return np.add.reduceat(by_word[self.word_of[self.by_feature]], self.feature_starts, axis=0)


def train(texts: list[str], toxic: list[int], p: ToxicityParams = ToxicityParams()) -> Model:
    """Mean of several trainings: scoring is linear in a model's weights, so their logits are averaged without further work."""
    found = [_train_once(texts, toxic, replace(p, seed=p.seed + k)) for k in range(p.models)]
    return Model(np.mean([m.weights for m in found], axis=0), float(np.mean([m.bias for m in found])), p)


def _train_once(texts: list[str], toxic: list[int], p: ToxicityParams) -> Model:
    """Small batches with steps that shrink by each bucket's past gradients.

    Without texts of both classes, or without any word, the model is constant: the share of toxic rows.
    """
    y = np.array(toxic, np.int64)
    if len(set(toxic)) < 2 or not any(t.split() for t in texts):
        share = min(max(float(y.mean()) if len(y) else 0.0, 1e-6), 1 - 1e-6)
        return Model(np.zeros(p.buckets, np.float32), float(np.log(share / (1 - share))), p)
    rng = np.random.default_rng(p.seed)
    short = []
    for text in (t for t, kind in zip(texts, toxic, strict=True) if not kind):
        own = text.split()
        for n in rng.integers(3, 17, p.excerpts if len(own) > 3 else 0).tolist():
            at = int(rng.integers(0, max(1, len(own) - n)))
            short.append(" ".join(own[at : at + n]))
    empty = len(texts) // 20 + 1  # an empty text is clean as well, which keeps the bias down
    texts = [*texts, *short, *[""] * empty]
    y = np.concatenate([y, np.zeros(len(short) + empty, np.int64)])
    order = rng.permutation(len(texts))
    size = min(p.batch, max(64, len(order) // 16))
    batches = [order[i : i + size] for i in range(0, len(order), size)]
    rows = [Training([texts[i] for i in own], p) for own in batches]
    seen = np.zeros(p.buckets, np.int64)
    for part in rows:
        seen += part.documents(p.buckets)
    live = seen >= p.min_docs  # what hardly any document has would only be learnt by heart; it stays zero
    e = rng.normal(0, 0.05, (p.buckets, p.dim)).astype(np.float32) * live[:, None]
    w = rng.normal(0, 0.5, (p.dim, 2)).astype(np.float32)
    b = np.zeros(2, np.float32)
    se, sw, sb = np.full(p.buckets, 1e-8, np.float32), np.full_like(w, 1e-8), np.full_like(b, 1e-8)
    want = np.eye(2, dtype=np.float32)[y]
    weight = (0.5 * len(y) / np.bincount(y, minlength=2))[y].astype(np.float32)[:, None]  # either class counts half
    weight[-empty:] = p.empty * len(y) / empty
    for epoch in range(-1, -(-p.steps // len(batches))):
        for i in rng.permutation(len(rows)):
            part, own = rows[i], batches[i]
            if not part.filled.any():
                continue
            x = part.average(e[part.used]) * p.heat
            z = x @ w + b
            z -= z.max(1, keepdims=True)
            prob = np.exp(z)
            prob /= prob.sum(1, keepdims=True)
            g = (prob - want[own]) * weight[own] / len(own)
            ge = part.spread((g @ w.T) * p.heat) * live[part.used][:, None]
            se[part.used] += (ge * ge).mean(1)
            if epoch < 0:
                continue  # the first pass only measures the gradients
            gw, gb = x.T @ g, g.sum(0)
            e[part.used] -= p.rate * ge / np.sqrt(se[part.used])[:, None]
            sw += gw * gw
            sb += gb * gb
            w -= p.rate * gw / np.sqrt(sw)
            b -= p.rate * gb / np.sqrt(sb)
        if epoch < 0 and live.any():
            # buckets of small gradients take small steps, so chance differences of rare n-grams stay small
            np.maximum(se, np.quantile(se[live], p.damping), out=se)
    return Model(p.heat * (e @ (w[:, 1] - w[:, 0])), float(b[1] - b[0]), p)


class Scorer:
    """Scores texts with the words' sums remembered; forgotten when there are many."""

    def __init__(self, model: Model, limit: int = 600_000):
        self.model, self.limit, self.known = model, limit, {}

    def score(self, text: str) -> float:
        known = self.known
        if len(known) > self.limit:
            known.clear()
        total = n = 0.0
        for word, k in Counter(words(text)).items():
            got = known.get(word)
            if got is None:
                f = features(word, self.model.params)
                got = known[word] = (float(self.model.weights[f].sum()), len(f))
            total += k * got[0]
            n += k * got[1]
        z = self.model.bias + (total / n if n else 0.0)
        return float(1 / (1 + np.exp(-max(-500.0, min(500.0, z)))))


def held_out(doc_id):
    """Whether the row is kept from training; a null doc_id is."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5 == 0, F.lit(True))


def fit(documents: DataFrame, labels: DataFrame, p: ToxicityParams = ToxicityParams()) -> Model:
    """Train on at most ``per_class`` toxic and ``clean_share`` times as many clean documents, those of the least hash of doc_id."""
    spark = documents.sparkSession
    rows = labels.filter(~held_out(F.col("doc_id"))).select("doc_id", "toxic").distinct()
    picked = None
    for kind in (0, 1):
        own = rows.filter(F.col("toxic") == kind).orderBy(F.xxhash64("doc_id"), "doc_id").limit(p.per_class * (1 if kind else p.clean_share))
        picked = own if picked is None else picked.union(own)
    ids = picked.toPandas()  # at most (1 + clean_share) * per_class rows
    if ids.empty:
        return train([], [], p)
    ids = spark.createDataFrame(list(ids.itertuples(index=False, name=None)), "doc_id long, toxic int")
    sample = (
        documents.select("doc_id", "text").join(F.broadcast(ids), "doc_id").filter("text IS NOT NULL")
        .orderBy(F.xxhash64("doc_id"), "doc_id", F.xxhash64("text")).limit((1 + p.clean_share) * p.per_class).toPandas()
    )
    return train(sample["text"].tolist(), sample["toxic"].tolist(), p)


def score(documents: DataFrame, model: Model) -> DataFrame:
    """All columns of documents (but those of these names) with score (0 to 1, higher: more likely toxic) and predicted.

    A null or empty text, or one without words, gets the score of the bias alone. Rows are scored one by one, so repeated
    rows get equal scores and nothing is shuffled; an empty table gives no row.
    """
    kept = [c for c in documents.columns if c not in ("score", "predicted")]
    rows = documents.select(*[F.col(f"`{c}`") for c in kept])
    names = [f.name for f in rows.schema]
    shared = documents.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        scorer = Scorer(shared.value)
        for batch in batches:
            got = [scorer.score(t or "") for t in batch["text"].to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(got, pa.float64()), pa.array([int(s >= 0.5) for s in got], pa.int32())],
                names=[*names, "score", "predicted"],
            )

    from pyspark.sql import types as T

    schema = T.StructType([*rows.schema.fields, T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())])
    return rows.mapInArrow(run, schema)
