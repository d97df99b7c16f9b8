from collections import defaultdict

import numpy as np
import pytest

from brickloom.llm import links, near_dup, neighbours, queries

SF = "/root/testdata/sf0.001"


def words(text):
    return (text or "").encode().lower().split()


def plain_groups(rows, size, percent=80):
    """All pairs of different texts compared on their sets; (doc_id, set size, least reachable doc_id)."""
    sets, up = {}, {}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, t in rows:
        w = words(t)
        sets[i] = set(zip(*[w[k:] for k in range(size)], strict=False)) if len(w) >= size else ({tuple(w)} if w else set())
        up[i] = i
    ids = sorted(sets)
    for x, i in enumerate(ids):
        for j in ids[:x]:
            a, b = sets[i], sets[j]
            if a and b and find(i) != find(j) and 100 * len(a & b) >= percent * len(a | b):
                lo, hi = sorted((find(i), find(j)))
                up[hi] = lo
    return {(i, len(sets[i]), find(i), find(i) == i) for i in sets}


def families(seed, groups=4, each=30):
    """Groups of near copies with one to many changed words, chains of small changes, exact copies and loners."""
    r = np.random.default_rng(seed)
    rows = []
    for g in range(groups):
        base = [f"w{x}" for x in r.integers(0, 400, 60)]
        for k in range(each):
            w = list(base)
            for at in r.integers(0, 60, int(r.integers(0, 5))):
                w[at] = f"z{r.integers(0, 10_000)}"
            rows.append((" ".join(w)))
            if k % 10 == 0:
                rows.append(" ".join(w).upper())
        chain = list(base[::-1])
        for k in range(12):
            chain[3 * k] = f"c{g}.{k}"
            rows.append(" ".join(chain))
    rows += ["", " ", "one two", "One  Two", "one two three", "a b c d"]
    return [(int(i), t) for i, t in zip(r.permutation(len(rows)), rows, strict=True)]


@pytest.mark.parametrize("size", [4, 5])
def test_near_duplicates_against_all_pairs(spark, size):
    rows = families(size)
    # small blocks, so that lists are cut into several
    p = near_dup.NearParams(shingle=size, outside=4, inside=8)
    got = near_dup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), p).collect()
    assert {tuple(r) for r in got} == plain_groups(rows, size)


def test_near_duplicates_of_the_table(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    assert {tuple(r) for r in queries.QUERIES["op8_near_duplicates"](spark, SF).collect()} == plain_groups(rows, 4)


def test_near_duplicates_of_odd_rows(spark, odd_documents, no_documents):
    got = near_dup.near_duplicates(odd_documents).collect()
    assert len(got) == 10
    by = defaultdict(list)
    for r in got:
        by[r.doc_id].append((r.n_shingles, r.component_id, r.kept))
    assert (by[2], by[3], by[4]) == ([(0, 2, True)], [(0, 3, True)], [(0, 4, True)])
    assert by[1] == [(7, 1, True)] and by[5] == [(7, 1, False)] * 2 and by[None] == [(7, None, True)] and by[9] == [(1, 9, True)]
    assert near_dup.near_duplicates(no_documents).count() == 0


def test_components_of_chains_and_stars(spark):
    pairs = [(i, i + 1) for i in range(1, 60)] + [(100, 100 + k) for k in range(1, 40)] + [(205, 201), (203, 205)]
    got = {r.node: r.component for r in links.components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert {got[i] for i in range(1, 61)} == {1} and {got[100 + k] for k in range(40)} == {100} and {got[i] for i in (201, 203, 205)} == {201}
    assert links.components(spark.createDataFrame([], "a long, b long")).count() == 0


def plain_nearest(rows, every, top):
    ids = np.array(sorted({i for i, _ in rows}))
    x = np.array([dict(rows)[i] for i in ids.tolist()], np.float64)
    out = {}
    for i in np.flatnonzero(ids % every == 0):
        s = (x * x[i]).sum(1)
        out[int(ids[i])] = [(int(ids[j]), s[j]) for j in np.lexsort((ids, -s)) if j != i][:top]
    return out


def test_nearest_in_small_blocks_is_exact_when_all_leaves_are_visited(spark):
    r = np.random.default_rng(5)
    x = r.normal(size=(600, 8)).astype(np.float32)
    x[100:400] = x[100]  # one very common vector
    rows = [(int(i), v.tolist()) for i, v in zip(r.permutation(600), x, strict=True)]
    odd = [(10_000, None), (10_020, [0.0] * 8), (10_040, [float("nan")] + [1.0] * 7), (10_060, [None] + [1.0] * 7), (10_080, [1.0, 2.0]), (None, [1.0] * 8), rows[0]]
    df = spark.createDataFrame([(i, v, 1) for i, v in rows + odd], "vec_id long, embedding array<float>, rank int")
    p = neighbours.TreeParams(leaf=40, least=2, recall=1.01, vectors=32, queries=8)
    got = defaultdict(list)
    for q in neighbours.nearest(df, p=p).orderBy("query_id", "rank").collect():
        got[q.query_id].append((q.vec_id, q.score))
    assert got == plain_nearest(rows, 20, 20)


def test_recall_of_the_table(spark):
    got = defaultdict(set)
    for r in queries.QUERIES["op3_nearest_vectors"](spark, "/root/testdata/sf0.01").collect():
        got[r.query_id].add(r.vec_id)
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet").collect()]
    want = plain_nearest(rows, 20, 20)
    assert got.keys() == want.keys()
    assert sum(len(got[q] & {i for i, _ in w}) for q, w in want.items()) >= 0.9 * sum(map(len, want.values()))


def test_recall_reaches_the_calibrated_share(spark):
    df = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    got = {(r.query_id, r.vec_id) for r in neighbours.nearest(df).collect()}
    want = {(q, i) for q, w in plain_nearest([(r.vec_id, r.embedding) for r in df.collect()], 20, 20).items() for i, _ in w}
    assert len(got & want) >= 0.97 * len(want)


def test_few_or_no_vectors(spark):
    schema = "vec_id long, embedding array<float>"
    assert neighbours.nearest(spark.createDataFrame([], schema)).count() == 0
    got = neighbours.nearest(spark.createDataFrame([(20, [1.0, 0.0]), (3, [0.5, 0.5]), (4, [0.5, -0.5])], schema)).collect()
    assert [(r.query_id, r["rank"], r.vec_id) for r in sorted(got, key=lambda r: r["rank"])] == [(20, 1, 3), (20, 2, 4)]
