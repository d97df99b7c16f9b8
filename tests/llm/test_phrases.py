import re
from collections import Counter, defaultdict

import numpy as np

from brickloom.llm import phrases

SCHEMA = "lang string, text string, phrase string, a long, n int"


def plain(rows, p):
    """Every phrase counted and compared with every longer one."""
    f, n = defaultdict(Counter), Counter()
    for lang, text in rows:
        lang, text = "und" if lang is None else lang, re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", text):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            for m in (1, 2, 3, 4):
                f[lang].update(tuple(w[i : i + m]) for i in range(len(w) - m + 1))
    out = []
    for lang, c in f.items():
        found = []
        for x, a in c.items():
            if len(x) < 2 or a < p.least:
                continue
            longer = (b for y, b in c.items() if len(y) > len(x) and b >= p.least and any(y[i : i + len(x)] == x for i in range(len(y))))
            if any(100 * b >= p.percent * a for b in longer):
                continue
            s, _, l, r = min((2000000 * a // (c[x[:k]] + c[x[k:]]), k, c[x[:k]], c[x[k:]]) for k in range(1, len(x)))
            found.append((-s, -a, " ".join(x).encode(), l, r))
        for rank, (s, a, x, l, r) in enumerate(sorted(found)[: p.top], 1):
            out.append((lang, rank, x.decode(), -a, l, r, n[lang], -s))
    return sorted(out)


def mined(spark, rows, p):
    df = spark.createDataFrame([(lang, t, "x", 1, 2) for lang, t in rows], SCHEMA)
    return sorted(map(tuple, phrases.mine(df.repartition(3), p).collect()))


def texts(seed, n=120):
    """Words of very unequal frequency, with set phrases of two to six words that recur whole or in part."""
    r = np.random.default_rng(seed)
    fixed = [[f"f{seed}{k}{i}" if i % 2 else f"W{r.integers(0, 12)}" for i in range(int(r.integers(2, 7)))] for k in range(12)]
    rows = []
    for _ in range(n):
        w = []
        for _ in range(40):
            if r.random() < 0.2:
                f = fixed[int(r.zipf(1.6)) % len(fixed)]
                w += f if r.random() < 0.8 else f[: int(r.integers(1, len(f) + 1))]
            else:
                w.append(f"w{int(r.zipf(1.4)) % 40}")
            if r.random() < 0.1:
                w.append(str(r.choice([".", ", ", "\n", "?"])))
        rows.append((str(r.choice(["en", "de"])), " ".join(w)))
    return rows


def test_phrases_against_all_counts(spark):
    p = phrases.PhraseParams(least=3, top=15, first=1, slice=40, flush=700)
    rows = texts(3)
    assert mined(spark, rows, p) == plain(rows, p)


def test_ties_at_the_last_rank(spark):
    p = phrases.PhraseParams(least=2, top=5, first=1, slice=4)
    rows = [("en", f"x{k} y{k} z{k}. x{k} y{k} z{k}") for k in range(12)] + [("en", "q r. q r. q s")]
    assert mined(spark, rows, p) == plain(rows, p)


def test_odd_rows(spark):
    p = phrases.PhraseParams(least=2, top=10)
    rows = [
        (None, "a b\tc  d"), ("und", "A b c D."), ("en", None), ("en", ""), ("en", " \t "), ("en", "..."), ("fr", "é É é É x é É"),
        ("en", "one"), ("en", "one two! one two" * 3000), ("en", "one two! one two" * 3000), ("zz", "\x00 \x01 \x00 \x01\x1c y \x1c y"),
    ]
    assert mined(spark, rows, p) == plain(rows, p)
    assert mined(spark, [], p) == [] and mined(spark, [("en", None)], p) == []
