import hashlib
import re

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from brickloom.llm import fingerprint, pii, queries

SF = "/root/testdata/sf0.001"
PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)",
    "card": r"[0-9](?:[\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(d):
    return sum(x if i % 2 == 0 else x * 2 - 9 * (x > 4) for i, x in enumerate(int(c) for c in reversed(d))) % 10 == 0


def base_spans(text):
    out = []
    for kind, pattern in PLAIN.items():
        for m in re.finditer(pattern, text, re.ASCII):
            d = re.sub("[^0-9]", "", m[0])
            if {
                "email": True,
                "ip": all(int(x) <= 255 for x in m[0].split(".")) if kind == "ip" else True,
                "card": 13 <= len(d) <= 19 and luhn(d or "0"),
                "phone": 9 <= len(d) <= 15,
            }[kind]:
                out.append(f"{kind}:{m.start()}:{m.end()}")
    return out


TEXTS = [
    None, "", "no data here",
    "ü a.b@c.de and x@y.z.w_q@r.st, 1.2.3.4 999.1.1.1 001.2.3.004.5 4111 1111 1111 1111 or 4111-1111-1111-1112 +1 (555) 123-4567.",
    "\U0001f600 me@host.org" * 50, "+49 30 1234567 +1 2", "a@b a@b.c@d.e @x.y 1.2.3.4.5.6.7.8", "1" * 3000, "a" * 50_000 + "@b.cd",
    "IBAN DE89370400440532013000 for the account; DE89370400440532013001 is wrong", "his ssn is 123-45-6789, part 123-45-6789-1; see 987-65-4321",
]


def test_personal_data_spans(spark):
    df = spark.createDataFrame([(i, t, "clash") for i, t in enumerate(TEXTS)], "doc_id int, text string, spans string").repartition(2)
    got = {r.doc_id: r for r in pii.find_spans(df).withColumn("j", pii.joined(F.col("spans"))).collect()}
    for i, t in enumerate(TEXTS):
        assert [s for s in got[i].j.split(",") if s and s.split(":")[0] in PLAIN] == base_spans(t or ""), t
    extra = [[s.kind for s in got[i].spans if s.kind not in PLAIN] for i in (9, 10)]
    assert extra == [["iban"], ["ssn"]]
    assert pii.find_spans(df.limit(0)).count() == 0


def test_cards_of_single_separated_digits(spark):
    texts = [sep.join("4111111111111111") for sep in " -"] + ["pay " + "4-1 " * 3 + "by", " ".join("4111111111111112")]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    got = pii.find_spans(df).withColumn("j", pii.joined(F.col("spans")))
    assert {r.doc_id: r.j for r in got.collect()} == {i: ",".join(base_spans(t)) for i, t in enumerate(texts)}
    assert {r.doc_id: r.text for r in pii.mask(got).collect()} == {0: "[card]", 1: "[card]", 2: texts[2], 3: texts[3]}


def test_masking(spark):
    df = spark.createDataFrame([(0, "to a.b@c.de at 1.2.3.4!"), (1, None), (2, "nothing")], "doc_id int, text string")
    got = {r.doc_id: r.text for r in pii.mask(pii.find_spans(df)).collect()}
    assert got == {0: "to [email] at [ip]!", 1: None, 2: "nothing"}


def test_personal_data_equals_sql(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{SF}/documents.parquet')")
    df = queries.QUERIES["op9_personal_data"](spark, SF)
    cur = con.execute(queries.ORACLES["op9_personal_data"])
    names = [d[0] for d in cur.description]
    want = sorted(tuple(r[names.index(c)] for c in df.columns) for r in cur.fetchall())
    assert sorted(map(tuple, df.collect())) == want


def edited(rows):
    """(doc_id, text) by descending doc_id -> (n_chars, hash of the edited text, the edited text, the next text)."""
    order = sorted(rows, reverse=True)
    for (doc, text), (_, after) in zip(order, order[1:] + order[:1], strict=True):
        m = len(text) // 3
        yield doc, text, text[: len(text) - m] + after[:m], after


def windows(text):
    w = [x for x in re.split(r"[\x20\x09-\x0D]+", text.lower()) if x]
    return {" ".join(w[i : i + 5]): 0 for i in range(max(1, len(w) - 4))} if w else {}


def jaccard(a, b):
    weights = {s: len(s) for s in [*windows(a), *windows(b)]}
    both = sum(weights[s] for s in windows(a) if s in windows(b))
    return both / sum(weights.values()) if weights else 1.0


def test_fingerprints_follow_the_weighted_similarity(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    got = {r.doc_id: r for r in queries.QUERIES["op6_weighted_fingerprints"](spark, SF).collect()}
    gaps = []
    for doc, text, other, after in edited(rows):
        r = got[doc]
        assert r.n_chars == len(text) and r.edited_sha256 == hashlib.sha256(other.encode()).hexdigest()
        gaps += [r.near_edited - jaccard(text, other), r.near_next - jaccard(text, after)]
    assert abs(np.mean(gaps)) < 0.03 and np.sqrt(np.mean(np.square(gaps))) < 0.15
    prints = {}
    for doc, text in rows:
        assert prints.setdefault(text, got[doc].fingerprint) == got[doc].fingerprint


def test_fingerprint_error(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    got = {r.doc_id: r.near_edited for r in queries.QUERIES["op6_weighted_fingerprints"](spark, SF).collect()}

    def exact(a, b):
        a, b = windows(a).keys(), windows(b).keys()
        return sum(map(len, a & b)) / sum(map(len, a | b))

    assert np.sqrt(np.mean([(got[doc] - exact(text, other)) ** 2 for doc, text, other, _ in edited(rows)])) < 0.11


def test_fingerprints_of_odd_rows(spark, odd_documents, no_documents):
    got = fingerprint.fingerprints(odd_documents).collect()
    assert len(got) == 10 and len({r.fingerprint for r in got if r.doc_id in (1, 5)}) == 1
    assert {r.fingerprint for r in got if r.doc_id in (2, 3, 4)} == {""}
    assert all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in got)
    assert fingerprint.fingerprints(no_documents).count() == 0
    one = fingerprint.fingerprints(odd_documents.filter("doc_id = 1")).collect()
    assert len(one) == 1 and one[0].near_next == 1.0


@pytest.mark.parametrize("column", ["n_chars", "near_next"])
def test_fingerprint_columns(spark, column):
    assert column in queries.QUERIES["op6_weighted_fingerprints"](spark, SF).columns
