"""Language of every word of a text by a linear-chain conditional random field, and of the text from its words.

A word is a run of non-white-space that holds a letter. Its features are its ends (affixes), its character n-grams and its place in
the learned lexicon of each language; transitions between the languages of neighbouring words are learned with them. The
probability of a language at a word comes from forward-backward over the whole text, so that a passage in another
language shows as such and a single odd word does not.

The learning texts have one language each. They are cut into spans, and spans of different languages are strung together, which
gives sequences with known changes of language.

Texts are handled in stretches of equal length, all at once: first every stretch's product of transfer matrices, then the chain
from stretch to stretch, then forward and backward inside the stretches. That is exact and needs few steps for texts of any length.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brickloom.llm.common import batched
from brickloom.operators.scans import top_per_key

_TOKEN = re.compile(r"\S+")
_MIX = np.uint64(0x9E3779B97F4A7C15)


@dataclass(frozen=True)
class LanguageParams:
    documents: int = 300  # bound of the learning sample per language: documents of the least hash of doc_id
    languages: int = 64  # and of the languages, those with the most documents
    spans: int = 6  # spans taken from a learning document, spread evenly over the whole of it
    words: int = 24  # words of a span
    strung: int = 4  # spans of a learning sequence, each of any language
    lexicon: int = 2000  # words of a language's lexicon
    buckets: int = 1 << 16
    steps: int = 250
    batch: int = 96  # sequences of a step
    rate: float = 0.15
    decay: float = 1e-5
    stretch: int = 64
    seed: int = 13


def learns(doc_id):
    """Rows that may be learned from; a row without doc_id is neither learned from nor held out."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string")), F.lit(3)) != 1, F.lit(False))


def held_out(doc_id):
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string")), F.lit(3)) == 1, F.lit(False))


def words(text: str) -> list[str]:
    return [w for w in text.split() if has_letter(w)]


def has_letter(word: str) -> bool:
    return word.isalpha() or any(map(str.isalpha, word))


def core(word: str) -> str:
    """The word in lower case from its first letter to its last; digits and marks inside stay."""
    w = word.lower()
    a, b = 0, len(w)
    while a < b and not w[a].isalpha():
        a += 1
    while b > a and not w[b - 1].isalpha():
        b -= 1
    return w[a:b] or word


def features(cores: list[str], lexicon: dict[str, int], buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Features of many words as (number of the word, number of the feature) pairs, all words at once.

    Character n-grams of one to three characters, those at the start and at the end once more as affixes, and the word's lexicon.
    """
    n = len(cores)
    size = np.fromiter(map(len, cores), np.int64, n)
    code = np.frombuffer("".join(cores).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    owner, end = np.repeat(np.arange(n), size), np.cumsum(size)
    at, first = np.arange(len(code)), end - size
    h, owners, found = np.zeros(len(code), np.uint64), [], []
    for k in (1, 2, 3):
        use = at + k <= end[owner]
        at, owner, h = at[use], owner[use], (h[use] * _MIX) ^ code[at[use] + k - 1]
        for kind, some in ((3, slice(None)), (4, at == first[owner]), (5, at + k == end[owner])):
            g = (h[some] + np.uint64(kind * 8 + k)) * _MIX
            owners.append(owner[some])
            found.append((g >> np.uint64(32)) % np.uint64(buckets))
    owners.append(np.arange(n))
    found.append(np.fromiter((lexicon.get(c, 0) for c in cores), np.int64, n) + buckets)
    return np.concatenate(owners), np.concatenate([f.astype(np.int64) for f in found])


@dataclass
class Model:
    languages: list[str]
    lexicon: dict[str, int]  # word to the number of its language, from 1 on; other words are 0
    weights: np.ndarray  # features x languages
    transitions: np.ndarray  # languages x languages
    params: LanguageParams

    def emissions(self, cores: list[str]) -> np.ndarray:
        """Factor of each language at each word; the mean of its features keeps long words in bounds."""
        return _factors(self.weights, *features(cores, self.lexicon, self.params.buckets), len(cores))[0]


def _factors(weights: np.ndarray, owner: np.ndarray, feature: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    count = np.bincount(owner, minlength=n)[:, None]
    score = np.stack([np.bincount(owner, w, n) for w in weights[feature].T], axis=1) / count
    return np.exp(score - score.max(axis=1, keepdims=True)), count


def _chain(e: np.ndarray, move: np.ndarray, mask: np.ndarray, start: np.ndarray, end: np.ndarray):
    """Posterior of every position of each row; ``start`` and ``end`` come from before and after the row."""
    n, length, k = e.shape
    alpha, beta = np.empty_like(e), np.empty_like(e)
    a = start
    for t in range(length):
        step = (a @ move) * e[:, t]
        a = np.where(mask[:, t, None], step / step.sum(axis=1, keepdims=True), a)
        alpha[:, t] = a
    b = end
    for t in range(length - 1, -1, -1):
        beta[:, t] = b
        step = (b * e[:, t]) @ move.T
        b = np.where(mask[:, t, None], step / step.sum(axis=1, keepdims=True), b)
    post = alpha * beta
    return post / post.sum(axis=2, keepdims=True)


def posteriors(emissions: list[np.ndarray], move: np.ndarray, stretch: int) -> list[np.ndarray]:
    """Forward-backward over every sequence (words x languages) from an even start, stretches side by side."""
    k = len(move)
    counts = np.array([-(-len(e) // stretch) for e in emissions], int)
    first = np.concatenate([[0], np.cumsum(counts)])
    n = int(first[-1])
    if not n:
        return [np.empty((0, k)) for _ in emissions]
    e, mask = np.ones((n * stretch, k)), np.zeros(n * stretch, bool)
    for at, own in zip(first[:-1] * stretch, emissions, strict=True):
        e[at : at + len(own)] = own
        mask[at : at + len(own)] = True
    e, mask = e.reshape(n, stretch, k), mask.reshape(n, stretch)
    carry = np.broadcast_to(np.eye(k), (n, k, k)).copy()
    for t in range(stretch):
        step = (carry.reshape(n * k, k) @ move).reshape(n, k, k) * e[:, t, None]
        carry = np.where(mask[:, t, None, None], step / step.sum(axis=(1, 2), keepdims=True), carry)
    start, end = np.full((n, k), 1.0 / k), np.full((n, k), 1.0 / k)
    for j in range(1, int(counts.max())):
        at = first[:-1][counts > j] + j
        a = np.einsum("nk,nkl->nl", start[at - 1], carry[at - 1])
        start[at] = a / a.sum(axis=1, keepdims=True)
    for j in range(1, int(counts.max())):
        at = first[1:][counts > j] - 1 - j
        b = np.einsum("nkl,nl->nk", carry[at + 1], end[at + 1])
        end[at] = b / b.sum(axis=1, keepdims=True)
    post = _chain(e, move, mask, start, end).reshape(n * stretch, k)
    return [post[at : at + len(own)] for at, own in zip(first[:-1] * stretch, emissions, strict=True)]


def _spans(p: LanguageParams):
    """Spans of each text, spread over the whole of it; what reaches the driver is bounded by the sample."""

    def run(batches):
        for batch in batches:
            out = []
            for lang, text in zip(batch["lang"].to_pylist(), batch["text"], strict=True):
                w = words(text.as_py() or "")
                places = np.unique(np.linspace(0, max(0, len(w) - p.words), p.spans).astype(int)).tolist() if w else []
                # a word of the sample is at most 64 characters
                out += [{"lang": lang, "span": [x[:64] for x in w[i : i + p.words]]} for i in places]
            yield pa.RecordBatch.from_pylist(out, pa.schema([("lang", pa.string()), ("span", pa.list_(pa.string()))]))

    return run


def sample(documents: DataFrame, p: LanguageParams) -> list[tuple[str, list[str]]]:
    """Spans (lang, words) of the learning rows: a bounded number of documents of each of a bounded number of languages."""
    rows = documents.filter(learns(F.col("doc_id")) & F.col("lang").isNotNull() & F.col("text").isNotNull())
    most = rows.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(p.languages).select("lang")
    ids = rows.select("doc_id", "lang").join(F.broadcast(most), "lang", "left_semi")
    ids = ids.select("doc_id", "lang", F.xxhash64("doc_id").alias("h"))
    chosen = top_per_key(ids, ["lang"], [F.col("h"), F.col("doc_id")], p.documents, "r").select("doc_id").distinct()
    picked = rows.join(F.broadcast(chosen), "doc_id", "left_semi")  # at most documents x languages ids
    spans = picked.select("lang", "text").mapInArrow(_spans(p), "lang string, span array<string>")
    bound = p.documents * p.languages * p.spans  # rows that repeat a doc_id can pass it
    return sorted((r.lang, r.span) for r in spans.limit(bound).collect())


def fit(spans: list[tuple[str, list[str]]], p: LanguageParams = LanguageParams()) -> Model:
    """Train on (lang, words) spans; without any, a model without languages."""
    languages = sorted({lang for lang, _ in spans})
    k = len(languages)
    place = {lang: i for i, lang in enumerate(languages)}
    seen = [Counter() for _ in languages]
    for lang, span in spans:
        seen[place[lang]].update({core(w) for w in span})
    lexicon = {}
    for i in range(k):
        # words of at least three spans, twice as frequent here as in all other languages together, hence of one language only
        own = {w: n for w, n in seen[i].items() if n >= 3 and n >= 2 * sum(c[w] for j, c in enumerate(seen) if j != i)}
        lexicon |= {w: i + 1 for w in sorted(own, key=lambda w: (-own[w], w))[: p.lexicon]}
    model = Model(languages, lexicon, np.zeros((p.buckets + k + 1, k)), np.zeros((k, k)), p)
    if k:
        _train(model, spans, place)
    return model


def _train(model: Model, spans: list, place: dict) -> None:
    """Gradient steps on the log-likelihood of strung sequences, with steps scaled by past gradients."""
    p, k = model.params, len(place)
    rng = np.random.default_rng(p.seed)
    vocabulary: dict[str, int] = {}
    coded = [(place[lang], np.array([vocabulary.setdefault(core(w), len(vocabulary)) for w in span])) for lang, span in spans]
    owner_of, feature_of = features(list(vocabulary), model.lexicon, p.buckets)
    order = np.argsort(owner_of, kind="stable")
    flat, sizes = feature_of[order], np.bincount(owner_of, minlength=len(vocabulary))
    offset = np.concatenate([[0], np.cumsum(sizes)])
    by_language = [[s for lang, s in coded if lang == i] for i in range(k)]
    past_w, past_t = np.full(model.weights.shape, 1e-6), np.full((k, k), 1e-6)
    length = p.words * p.strung
    for _ in range(p.steps):
        x, y, mask = np.zeros((p.batch, length), int), np.zeros((p.batch, length), int), np.zeros((p.batch, length), bool)
        for row in range(p.batch):
            at = 0
            for lang in rng.integers(0, k, p.strung):
                span = by_language[lang][rng.integers(len(by_language[lang]))]
                span = span[: rng.integers(1, len(span) + 1)]
                x[row, at : at + len(span)], y[row, at : at + len(span)] = span, lang
                at += len(span)
            mask[row, :at] = True
        used, inverse = np.unique(x[mask], return_inverse=True)
        which = np.concatenate([flat[offset[w] : offset[w + 1]] for w in used])
        owner = np.repeat(np.arange(len(used)), sizes[used])
        factor, count = _factors(model.weights, owner, which, len(used))
        e = np.ones((p.batch, length, k))
        e[mask] = factor[inverse]
        post, pair = _expected(e, np.exp(model.transitions), mask)
        miss = np.eye(k)[y[mask]] - post[mask]
        per_word = np.stack([np.bincount(inverse, miss[:, j], len(used)) for j in range(k)], axis=1) / count
        total = mask.sum()
        grad = np.stack([np.bincount(which, per_word[owner, j], len(model.weights)) for j in range(k)], axis=1) / total
        both = mask[:, 1:] & mask[:, :-1]
        moves = np.zeros((k, k))
        np.add.at(moves, (y[:, :-1][both], y[:, 1:][both]), 1.0)
        grad_t = (moves - pair) / total
        past_w += grad**2
        past_t += grad_t**2
        model.weights += p.rate * grad / np.sqrt(past_w) - p.decay * model.weights
        model.transitions += p.rate * grad_t / np.sqrt(past_t)


def _expected(e: np.ndarray, move: np.ndarray, mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Posteriors of all positions and the expected number of every move; rows are full from the left, so the first word has no move."""
    n, length, k = e.shape
    alpha, beta = np.empty_like(e), np.empty_like(e)
    for t in range(length):
        step = (alpha[:, t - 1] @ move if t else np.ones((n, k))) * e[:, t]
        alpha[:, t] = np.where(mask[:, t, None], step / step.sum(axis=1, keepdims=True), alpha[:, t - 1] if t else 1.0 / k)
    beta[:, -1] = 1.0 / k
    pair = np.zeros((k, k))
    for t in range(length - 2, -1, -1):
        after = e[:, t + 1] * beta[:, t + 1]
        joint = alpha[:, t, :, None] * move * after[:, None]
        joint /= joint.sum(axis=(1, 2), keepdims=True)
        pair += joint[mask[:, t + 1]].sum(axis=0)
        step = after @ move.T
        beta[:, t] = np.where(mask[:, t + 1, None], step / step.sum(axis=1, keepdims=True), beta[:, t + 1])
    post = alpha * beta
    return post / post.sum(axis=2, keepdims=True), pair


class _Emissions(dict):
    """Words met, numbered (-1 without a letter), and the table of their emissions, which ``fill`` brings up to date."""

    def __init__(self, model: Model):
        super().__init__()
        self.model, self.new, self.table, self.n = model, [], np.empty((1024, len(model.languages))), 0

    def __missing__(self, word: str) -> int:
        n = -1
        if has_letter(word):
            n = self.n + len(self.new)
            self.new.append(core(word))
        self[word] = n
        return n

    def fill(self) -> np.ndarray:
        for part in batched(((c,) for c in self.new), 50_000, 1_000_000):
            found = self.model.emissions([c for (c,) in part])
            while self.n + len(found) > len(self.table):
                self.table = np.concatenate([self.table, np.empty_like(self.table)])
            self.table[self.n : self.n + len(found)] = found
            self.n += len(found)
        self.new = []
        return self.table

    def forget(self) -> None:
        self.clear()
        self.n = 0


def _labelled(texts: list[str], model: Model, known: _Emissions) -> list[tuple[np.ndarray, np.ndarray]]:
    """Per text the places of its words among its runs of non-white-space, and their posteriors."""
    if len(known) > 300_000:
        known.forget()
    found = [np.fromiter(map(known.__getitem__, t.split()), np.int64) for t in texts]
    table = known.fill()
    places = [np.flatnonzero(f >= 0) for f in found]
    move = np.exp(model.transitions - model.transitions.max())
    return list(zip(places, posteriors([table[f[at]] for f, at in zip(found, places, strict=True)], move, model.params.stretch), strict=True))


def identify(documents: DataFrame, model: Model) -> DataFrame:
    """documents(doc_id, text) -> doc_id, lang_pred, score, shares: the language most of a text's words are likeliest in.

    score is the mean probability of that language over the words, shares those of all languages in their order; ties go to the smaller name. Null and
    empty texts, and texts without a letter, are ``und`` with score 0, as is every text where the model knows no language. Texts of any length are read
    whole; repeated rows are judged each by itself; further columns are not used; an empty table gives no row.
    """

    def run(batches):
        known = _Emissions(model)
        for batch in batches:
            rows = zip(batch["text"].to_pylist(), batch["doc_id"].to_pylist(), strict=True)
            for part in batched(rows, 4096, 2_000_000):
                texts = [t or "" for t, _ in part]
                means = [post.mean(axis=0) if len(at) else None for at, post in _labelled(texts, model, known)] if model.languages else [None] * len(texts)
                best = [None if m is None else int(m.argmax()) for m in means]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([i for _, i in part], pa.int64()),
                        pa.array(["und" if b is None else model.languages[b] for b in best], pa.string()),
                        pa.array([0.0 if b is None else min(1.0, float(m[b])) for b, m in zip(best, means, strict=True)], pa.float64()),
                        pa.array([[] if m is None else m.tolist() for m in means], pa.list_(pa.float64())),
                    ],
                    names=["doc_id", "lang_pred", "score", "shares"],
                )

    return documents.select("doc_id", "text").mapInArrow(run, "doc_id long, lang_pred string, score double, shares array<double>")


def label_words(documents: DataFrame, model: Model) -> DataFrame:
    """documents(doc_id, text) -> doc_id, start, end, lang, probability: runs of neighbouring words whose likeliest language is the same.

    start and end are code points, end exclusive; probability is the mean over the run's words. Odd rows are as in ``identify``; texts without words give no row.
    """

    def run(batches):
        known = _Emissions(model)
        for batch in batches:
            rows = zip(batch["text"].to_pylist(), batch["doc_id"].to_pylist(), strict=True)
            for part in batched(rows, 4096, 2_000_000):
                out = []
                labelled = _labelled([t or "" for t, _ in part], model, known) if model.languages else []
                for (text, doc_id), (at, post) in zip(part, labelled, strict=False):
                    if not len(at):
                        continue
                    places = [m.span() for m in _TOKEN.finditer(text or "")]
                    best = post.argmax(axis=1)
                    cuts = np.flatnonzero(np.diff(best)) + 1
                    for run_ in np.split(np.arange(len(at)), cuts):
                        lang = int(best[run_[0]])
                        out.append({
                            "doc_id": doc_id, "start": places[at[run_[0]]][0], "end": places[at[run_[-1]]][1],
                            "lang": model.languages[lang], "probability": float(post[run_, lang].mean()),
                        })
                fields = [("doc_id", pa.int64()), ("start", pa.int64()), ("end", pa.int64()), ("lang", pa.string()), ("probability", pa.float64())]
                yield pa.RecordBatch.from_pylist(out, pa.schema(fields))

    return documents.select("doc_id", "text").mapInArrow(run, "doc_id long, start long, end long, lang string, probability double")
