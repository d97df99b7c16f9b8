"""Every query has a stable schema, and a sample agrees with its SQL at the smallest scale.

``tools/check.py`` compares all of them.
"""

import duckdb
import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
SAMPLE = [
    "part_dims", "catalog_search", "top_inventory", "merge_queue", "theme_root", "catalog_update_columns", "taxonomy_counts",
    "sequence_index", "ldraw_lines", "html_set_index", "gallery_json", "page_assignment", "queue_state", "stream_dedupe",
]


def canon(v):
    return repr(0.0 if v == 0 else v) if isinstance(v, float) else str(v)


@pytest.mark.parametrize("name", SAMPLE)
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for table in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{SF}/{table}.parquet')")
    df = entry.queries()[name](spark, SF)
    cols = sorted(df.columns)
    got = sorted(tuple(canon(v) for v in r) for r in df.select(*cols).collect())
    cur = con.execute(entry.oracle_sql()[name])
    names = [d[0] for d in cur.description]
    want = sorted(tuple(canon(r[names.index(c)]) for c in cols) for r in cur.fetchall())
    assert sorted(names) == cols and got == want


def test_entry_runs(spark):
    assert entry.entry(spark).limit(1).count() == 1


def test_oracles_belong_to_queries():
    assert set(entry.oracle_sql()) <= set(entry.queries())
