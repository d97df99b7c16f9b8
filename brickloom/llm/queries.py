"""One query per operator, with its parameters for production, and the SQL that gives the same rows where SQL can."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brickloom.llm import (
    bpe, codes, fingerprint, html_text, languages, near_dup, neighbours, packing, phrases, pii, token_files, toxicity, urls,
)  # fmt: skip
from brickloom.llm.common import ORACLES, QUERIES, query, table  # noqa: F401


@query("op6_weighted_fingerprints")
def _fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.fingerprints(table(spark, sf_dir, "documents", "doc_id", "text"))


def _pii_sql() -> str:
    """Every kind as one row of the pattern list; \\x20 and possessive forms are written as RE2 has them."""
    plain = {
        "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+",
        "card": r"[0-9](?:[ -]?[0-9])+", "phone": r"\+[0-9][ ().0-9-]+[0-9]", "iban": pii.IBAN, "ssn": pii.SSN,
    }  # fmt: skip
    kinds = ", ".join(f"({i}, '{k.name}', '{plain[k.name]}', {k.base}, '{k.context}', {k.accept})" for i, k in enumerate(pii.KINDS))
    return rf"""
WITH kinds(ord, kind, pattern, base, context, accept) AS (VALUES {kinds}),
docs AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
found AS (
  SELECT r, ord, kind, base, context, accept, regexp_extract_all(text, pattern) AS m, string_split_regex(text, pattern) AS p
  FROM docs, kinds WHERE regexp_matches(text, pattern)),
each AS (
  SELECT *, unnest(generate_series(1, len(m))) AS i FROM found),
spans AS (
  SELECT r, ord, kind, base, context, accept, m[i] AS v, p[i] AS before, p[i + 1] AS after,
    coalesce(list_sum(list_transform(p[1:i], lambda x: length(x))), 0)::BIGINT
      + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0)::BIGINT AS s,
    regexp_replace(m[i], '[^0-9]', '', 'g') AS d,
    m[i][5:] || m[i][1:4] AS turned
  FROM each),
checked AS (
  SELECT *, CASE kind
    WHEN 'ip' THEN len(list_filter(string_split(v, '.'), lambda x: length(ltrim(x, '0')) > 3 OR (ltrim(x, '0') || '')::VARCHAR <> '' AND TRY_CAST(ltrim(x, '0') AS INT) > 255)) = 0
    WHEN 'card' THEN length(d) BETWEEN 13 AND 19 AND list_sum(list_transform(generate_series(0, length(d) - 1), lambda k:
      CASE WHEN k % 2 = 0 THEN substr(d, (length(d) - k)::INT, 1)::INT
           WHEN substr(d, (length(d) - k)::INT, 1)::INT > 4 THEN substr(d, (length(d) - k)::INT, 1)::INT * 2 - 9
           ELSE substr(d, (length(d) - k)::INT, 1)::INT * 2 END)) % 10 = 0
    WHEN 'phone' THEN length(d) BETWEEN 9 AND 15
    WHEN 'iban' THEN NOT regexp_matches(right(before, 1), '[A-Za-z0-9]') AND NOT regexp_matches(left(after, 1), '[A-Za-z0-9]')
      AND list_reduce(list_prepend(0::HUGEINT, list_transform(string_split(turned, ''), lambda c: CASE WHEN c >= 'A' THEN ord(c) - 55 ELSE ord(c) - 48 END::HUGEINT)),
        lambda a, b: CASE WHEN b > 9 THEN (a * 100 + b) % 97 ELSE (a * 10 + b) % 97 END) = 1
    WHEN 'ssn' THEN NOT regexp_matches(right(before, 1), '[A-Za-z0-9]') AND NOT regexp_matches(left(after, 1), '[A-Za-z0-9]')
    ELSE true END AS good,
    base + CASE WHEN regexp_matches(right(before, {pii.WINDOW}) || ' ' || left(after, {pii.WINDOW}),
      '(?i)(?:^|[^A-Za-z])(?:' || context || ')(?:$|[^A-Za-z])') THEN {pii.RAISE} ELSE 0 END AS score
  FROM spans),
kept AS (SELECT *, kind || ':' || s || ':' || (s + length(v)) AS span FROM checked WHERE good AND score >= accept)
SELECT doc_id,
  count(*) FILTER (kind = 'email') AS n_email, count(*) FILTER (kind = 'ip') AS n_ip,
  count(*) FILTER (kind = 'card') AS n_card, count(*) FILTER (kind = 'phone') AS n_phone,
  sha256(coalesce(string_agg(span, ',' ORDER BY ord, s) FILTER (ord < 4), '')) AS base_sha256,
  coalesce(string_agg(span, ',' ORDER BY ord, s), '') AS spans,
  coalesce(max(round(score, 2)), 0)::DOUBLE AS top_score
FROM docs LEFT JOIN kept USING (r) GROUP BY r, doc_id"""


@query("op9_personal_data", _pii_sql())
def _personal(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find_spans(table(spark, sf_dir, "documents", "doc_id", "text"))
    spans = F.col("spans")
    of = lambda kind: F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")  # noqa: E731
    return found.select(
        "doc_id",
        *[of(k).alias(f"n_{k}") for k in pii.BASE],
        F.sha2(pii.joined(F.filter(spans, lambda s: s["kind"].isin(*pii.BASE))), 256).alias("base_sha256"),
        pii.joined(spans).alias("spans"),
        F.coalesce(F.round(F.array_max(F.transform(spans, lambda s: s["score"])), 2), F.lit(0.0)).alias("top_score"),
    )


@query("op10_url_templates")
def _urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge(table(spark, sf_dir, "pages", "page_id", "url"))


def vocabulary(name: str) -> str:
    """Place of a public tokenizer's file, the same on every machine of the cluster."""
    import public_tokenizers

    return public_tokenizers.path(name)


@query("op2_token_files")
def _token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.write_and_read(table(spark, sf_dir, "documents", "doc_id", "text"), vocabulary("word_bpe_49k.json"))


@query("op5_packed_sequences")
def _packed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed(table(spark, sf_dir, "documents", "doc_id", "text"), vocabulary("byte_bpe_50k.json"))


@query("op7_byte_bpe")
def _byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    return bpe.round_trips(docs, vocabulary("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


@query("op1_toxicity_scores")
def _toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    model = toxicity.fit(docs, table(spark, sf_dir, "labels", "doc_id", "toxic"))
    scored = toxicity.score(docs, model)
    return scored.select("doc_id", toxicity.held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


@query("op4_main_text")
def _main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(table(spark, sf_dir, "pages", "page_id", "url", "html"))


@query("op3_nearest_vectors")
def _nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.nearest(table(spark, sf_dir, "embeddings", "vec_id", "embedding"))


@query("op8_near_duplicates")
def _near(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    return near_dup.near_duplicates(docs, near_dup.NearParams(shingle=4))


def _codes_sql(p: codes.CodeParams = codes.CodeParams()) -> str:
    """Every round as one table of assignments and one of codebooks, with plain squared distances."""
    steps = []
    for r in range(p.rounds + 1):
        steps.append(f"""
a{r} AS MATERIALIZED (
  SELECT v, part, arg_min(entry, d * 256 + entry) AS entry, min(d) AS d FROM (
    SELECT v, part, entry, sum((x - y) * (x - y)) AS d FROM c JOIN b{r} USING (part, pos) GROUP BY ALL) GROUP BY ALL)""")
        if r < p.rounds:
            steps.append(f"""
b{r + 1} AS MATERIALIZED (
  SELECT part, entry, pos, CASE WHEN n IS NULL THEN y ELSE (s - ((s % n) + n) % n) // n END AS y
  FROM b{r} LEFT JOIN (
    SELECT part, entry, pos, sum(x) AS s, count(*) AS n FROM c JOIN a{r} USING (v, part) GROUP BY ALL) USING (part, entry, pos))""")
    return f"""
WITH kept AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY vec_id) AS v, vec_id, label, embedding FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
c AS MATERIALIZED (
  SELECT v, i // (w // {p.parts}) AS part, i % (w // {p.parts}) AS pos, floor({p.scale} * e::DOUBLE)::HUGEINT AS x FROM (
    SELECT v, len(embedding) AS w, unnest(embedding) AS e, unnest(range(len(embedding))) AS i FROM kept)),
b0 AS MATERIALIZED (SELECT part, v - 1 AS entry, pos, x AS y FROM c WHERE v <= {p.entries}),{",".join(steps)},
coded AS (
  SELECT v, string_agg(printf('%02x', entry::INT), '' ORDER BY part) AS code, sum(d)::BIGINT AS error FROM a{p.rounds} GROUP BY v)
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error,
  (SELECT sha256(string_agg(y::VARCHAR, ',' ORDER BY part, entry, pos)) FROM b{p.rounds}) AS codebooks_sha256
FROM kept JOIN coded USING (v)"""


@query("op11_vector_codes", _codes_sql())
def _codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return codes.compress(table(spark, sf_dir, "embeddings", "vec_id", "embedding", "label"))


def _phrases_sql(p: phrases.PhraseParams = phrases.PhraseParams()) -> str:
    """Every phrase counted, every cut scored, every longer phrase looked at."""
    return rf"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?
-]')) AS piece FROM documents),
words AS MATERIALIZED (SELECT lang, regexp_extract_all(piece, '[^ 	]+') AS w FROM pieces),
totals AS (SELECT lang, sum(len(w))::BIGINT AS n FROM words GROUP BY lang),
f AS MATERIALIZED (
  SELECT lang, m, array_to_string(w[i:i + m - 1], ' ') AS phrase, count(*) AS a FROM (
    SELECT lang, m, w, unnest(range(1, len(w) - m + 2)) AS i FROM words, (VALUES (1), (2), (3), (4)) AS sizes(m))
  GROUP BY ALL HAVING count(*) >= {p.least}),
inside AS (
  SELECT lang, array_to_string(string_split(phrase, ' ')[i:i + k - 1], ' ') AS phrase, max(a) AS longest FROM (
    SELECT lang, phrase, a, k, unnest(range(1, m - k + 2)) AS i FROM f, (VALUES (2), (3)) AS part(k) WHERE k < m)
  GROUP BY ALL),
alive AS (SELECT f.* FROM f LEFT JOIN inside USING (lang, phrase) WHERE m > 1 AND NOT coalesce(100 * longest >= {p.percent} * a, false)),
parts AS (
  SELECT lang, phrase, a, k, array_to_string(string_split(phrase, ' ')[:k], ' ') AS first, array_to_string(string_split(phrase, ' ')[k + 1:], ' ') AS rest
  FROM alive, (VALUES (1), (2), (3)) AS cut(k) WHERE k < m),
cuts AS (
  SELECT parts.*, x.a AS l, y.a AS r, (2000000::HUGEINT * parts.a // (x.a + y.a))::BIGINT AS score
  FROM parts JOIN f AS x ON x.lang = parts.lang AND x.phrase = first JOIN f AS y ON y.lang = parts.lang AND y.phrase = rest),
lowest AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, encode(phrase)) AS rank FROM lowest)
SELECT lang, rank, phrase, a, l, r, n, score FROM ranked JOIN totals USING (lang) WHERE rank <= {p.top}"""


@query("op12_collocations", _phrases_sql())
def _collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.mine(table(spark, sf_dir, "documents", "lang", "text"))


@query("op13_word_languages")
def _languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "text", "lang")
    model = languages.fit(languages.sample(docs, languages.LanguageParams()))
    found = languages.identify(docs, model).withColumn("held_out", languages.held_out(F.col("doc_id")))
    return found.select("doc_id", "held_out", "lang_pred", "score", F.to_json("shares").alias("shares"))
