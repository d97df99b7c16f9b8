import hashlib
from collections import defaultdict

import numpy as np
import pytest

from brickloom.llm import codes

SCHEMA = "vec_id long, embedding array<float>, label int, part int, error string, entry long"


def plain(rows, parts=8, entries=16, rounds=6):
    """The same codebooks from Python integers and plain squared distances; rows are (vec_id, embedding, label)."""
    kept = [(i, v, t) for i, v, t in rows if v is not None and all(x is not None and np.isfinite(x) for x in v)]
    width = -(-max((len(v) for _, v, _ in kept), default=0) // parts) or 1
    cut = []
    for _, v, _ in kept:
        whole = [(int(np.float64(x).as_integer_ratio()[0]) * 4096) // int(np.float64(x).as_integer_ratio()[1]) for x in v]
        whole += [0] * (parts * width - len(whole))
        cut.append([tuple(whole[j * width : (j + 1) * width]) for j in range(parts)])
    ids = sorted({i for i, _, _ in kept if i is not None})[:entries]
    least = [min((tuple(v), c) for (k, v, _), c in zip(kept, cut, strict=True) if k == i)[1] for i in ids]
    books = [[c[j] for c in least] for j in range(parts)]

    def nearest(x, book):
        d = [sum((a - b) ** 2 for a, b in zip(x, y, strict=True)) for y in book]
        return d.index(min(d)), min(d)

    for _ in range(rounds):
        for j in range(parts):
            own = defaultdict(list)
            for c in cut:
                own[nearest(c[j], books[j])[0]].append(c[j])
            for e, xs in own.items():
                books[j][e] = tuple(sum(col) // len(xs) for col in zip(*xs, strict=True))
    sha = hashlib.sha256(",".join(str(x) for b in books for y in b for x in y).encode()).hexdigest()
    out, by_label = [], defaultdict(int)
    for (i, _, t), c in zip(kept, cut, strict=True):
        found = [nearest(c[j], books[j]) for j in range(parts)]
        out.append((i, "".join(f"{e:02x}" for e, _ in found), sum(d for _, d in found), t))
        by_label[t] += out[-1][2]
    long = lambda x: x if x < 1 << 63 else None
    return sorted(((i, c, long(e), long(by_label[t]), sha) for i, c, e, t in out), key=str)


def coded(spark, vectors, **p):
    df = spark.createDataFrame([(i, v, t, 1, "x", 2) for i, v, t in vectors], SCHEMA)
    return sorted(map(tuple, codes.compress(df, codes.CodeParams(**p)).collect()), key=str)


@pytest.mark.parametrize("width", [1, 2, 4, 8, 32])
def test_sequency_counts_sign_changes(width):
    rows = codes.walsh(np.eye(width, dtype=np.int64)).T
    assert [int((np.diff(r) != 0).sum()) for r in rows] == list(range(width))


def test_nearest_equals_plain_distances():
    r = np.random.default_rng(1)
    for width in (1, 3, 5, 8, 13):
        x, y = r.integers(-40, 40, (300, width)), r.integers(-40, 40, (16, width))
        y[9] = y[2]  # ties go to the lower entry
        d = ((x[:, None] - y[None]) ** 2).sum(axis=2)
        got, far = codes.nearest(codes.walsh(x), codes.walsh(y))
        assert (got == d.argmin(axis=1)).all() and (far == d.min(axis=1)).all()
        big = np.frompyfunc(int, 1, 1)(x) * 10**15
        got, far = codes.nearest(codes.walsh(big), codes.walsh(np.frompyfunc(int, 1, 1)(y) * 10**15))
        assert (got == d.argmin(axis=1)).all() and far.tolist() == [int(v) * 10**30 for v in d.min(axis=1)]


def test_codes_against_plain_integers(spark):
    r = np.random.default_rng(2)
    rows = [(int(i), [float(np.float32(x)) for x in r.normal(size=24) * 0.3], int(t)) for i, t in zip(r.permutation(150), r.integers(0, 4, 150), strict=True)]
    assert coded(spark, rows, rows=37) == plain(rows)


def test_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [
        (4, None, 1), (5, [1.0, None], 1), (6, [nan], 1), (7, [inf] * 16, 1), (8, [-inf], None),
        (1, [0.5] * 16, None), (2, [-0.25] * 16, None), (2, [-0.5] * 16, 3), (2, [-0.5] * 16, 3), (None, [0.1] * 16, 3), (9, [], 2), (10, [0.125] * 5, 2),
    ]
    assert coded(spark, rows) == plain(rows)
    assert coded(spark, rows[:5]) == [] and coded(spark, []) == []


def test_errors_beyond_64_bits_are_null(spark):
    rows = [(i, [float(np.float32(1e36 * i)), -1.0], 0) for i in range(1, 30)] + [(30, [1e5, 2.0], 1)]
    got = coded(spark, rows)
    assert got == plain(rows) and any(r[2] is None for r in got)
