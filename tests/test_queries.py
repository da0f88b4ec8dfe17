"""Each table query against its SQL, on the smallest tables."""

from collections import Counter

import duckdb
import pytest

from veilframe.plans import queries

TABLES = "region nation customer supplier part orders lineitem events documents".split()


@pytest.fixture(scope="module")
def con(sf):
    c = duckdb.connect()
    c.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query(name, spark, sf, con):
    got = queries.queries()[name](spark, sf)
    want = con.execute(queries.oracle_sql()[name])
    columns = [d[0] for d in want.description]
    assert sorted(columns) == sorted(got.columns)
    rows = Counter(repr(tuple(r[c] for c in columns)) for r in got.collect())
    assert rows == Counter(map(repr, want.fetchall()))


def test_words_are_tested_in_whole_texts(spark, tmp_path):
    rows = [(1, "write to a@b.org\nor c.d@e.co.uk 1234567890123"), (2, "x@y.zz first"), (3, "none\t4111-1111-1111-1111 @b"), (4, ""), (5, None)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: (r.emails, r.long_numbers) for r in queries.queries()["pii_words"](spark, str(tmp_path)).collect()}
    assert got == {1: (2, 1), 2: (1, 0), 3: (0, 1), 4: (0, 0), 5: (None, None)}
