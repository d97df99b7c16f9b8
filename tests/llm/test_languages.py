import zlib
from itertools import product

import numpy as np
import pytest

from brickloom.llm import languages, queries

SF = "/root/testdata/sf0.01"


def test_forward_backward_against_all_paths():
    r = np.random.default_rng(5)
    move = r.random((3, 3))
    sequences = [r.random((n, 3)) for n in (0, 1, 2, 6, 7)]
    for e, post in zip(sequences, languages.posteriors(sequences, move, 2), strict=True):
        want = np.zeros_like(e)
        for path in product(range(3), repeat=len(e)):
            # from an even start: the sum over the language before the first word
            weight = move[:, path[0]].sum() * e[0, path[0]] if path else 0.0
            for t in range(1, len(path)):
                weight *= move[path[t - 1], path[t]] * e[t, path[t]]
            for t, lang in enumerate(path):
                want[t, lang] += weight
        assert post == pytest.approx(want / want.sum(axis=1, keepdims=True)) if len(e) else post.shape == (0, 3)


def test_expected_moves_are_the_gradient_of_the_partition():
    r = np.random.default_rng(6)
    scores, move = r.random((1, 4, 2)), np.log(r.random((2, 2)))
    mask = np.array([[True, True, True, False]])

    def partition(move):
        paths = product(range(2), repeat=3)
        return np.log(sum(np.exp(sum(scores[0, t, y] for t, y in enumerate(p)) + sum(move[p[t - 1], p[t]] for t in (1, 2))) for p in paths))

    _, pair = languages._expected(np.exp(scores), np.exp(move), mask)
    for i, j in product(range(2), repeat=2):
        step = np.zeros((2, 2))
        step[i, j] = 1e-5
        assert pair[i, j] == pytest.approx((partition(move + step) - partition(move - step)) / 2e-5, abs=1e-6)


@pytest.fixture(scope="module")
def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="module")
def model(documents):
    return languages.fit(languages.sample(documents, languages.LanguageParams()))


def test_held_out_languages(spark, documents):
    got = queries.QUERIES["op13_word_languages"](spark, SF).join(documents.select("doc_id", "lang"), "doc_id").collect()
    assert len(got) == documents.count()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and 0 <= r.score <= 1 for r in got)
    held = [r for r in got if r.held_out]
    assert np.mean([r.lang_pred == r.lang for r in held]) >= 0.98


def test_code_switched_passages(spark, documents, model):
    """Passages of held-out documents strung together: their words get their own languages, and so do the spans."""
    rows = documents.filter(languages.held_out(documents["doc_id"])).select("lang", "text").collect()
    r = np.random.default_rng(7)
    texts, truth = [], []
    for _ in range(40):
        parts, own = [], []
        for k in r.integers(0, len(rows), 3):
            w = languages.words(rows[k].text)
            at = int(r.integers(0, max(1, len(w) - 25)))
            parts += w[at : at + 25]
            own += [rows[k].lang] * len(w[at : at + 25])
        texts.append(" ".join(parts))
        truth.append(own)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    runs = languages.label_words(df, model).collect()
    right = total = 0
    for i, own in enumerate(truth):
        at = 0
        for w, lang in zip(texts[i].split(" "), own, strict=True):
            right += sum(s.lang == lang for s in runs if s.doc_id == i and s.start <= at and at + len(w) <= s.end)
            total += 1
            at += len(w) + 1
    assert right / total >= 0.95


def test_odd_rows(odd_documents, no_documents, model):
    got = languages.identify(odd_documents, model).collect()
    assert len(got) == odd_documents.count() and all(0 <= r.score <= 1 for r in got)
    by_id = {r.doc_id: r for r in got}
    assert [(by_id[i].lang_pred, by_id[i].score) for i in (2, 3, 4)] == [("und", 0.0)] * 3
    assert by_id[7].lang_pred in model.languages
    assert languages.identify(no_documents, model).collect() == []
    starts = {(r.doc_id, r.start) for r in languages.label_words(odd_documents, model).collect()}
    assert {i for i, _ in starts} == {1, 5, None, 7, 8, 9} and (7, 0) in starts
    assert languages.label_words(no_documents, model).collect() == []


def test_without_learning_rows(spark, odd_documents):
    nothing = languages.sample(spark.createDataFrame([(1, None, "en"), (None, "a b", "en"), (3, "x y", None)], "doc_id long, text string, lang string"), languages.LanguageParams())
    assert nothing == []
    assert {(r.lang_pred, r.score) for r in languages.identify(odd_documents, languages.fit(nothing)).collect()} == {("und", 0.0)}
    one = languages.fit([("en", ["only", "words"])])
    assert {r.lang_pred for r in languages.identify(odd_documents, one).collect()} == {"en", "und"}


def test_labels_of_held_out_rows_do_not_matter(spark, documents):
    p = languages.LanguageParams(documents=20)
    changed = documents.withColumn("lang", queries.F.when(languages.held_out(documents["doc_id"]), "xx").otherwise(documents["lang"]))
    assert languages.sample(changed, p) == languages.sample(documents, p)
