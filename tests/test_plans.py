import math
from pathlib import Path

import pytest

from quern import plans

SF = Path("/root/testdata/sf0.001")
CHECKED = ["majority_vote_verdicts", "category_summary", "category_expand_fuzzy", "describe_numeric", "tokenise_ngram_counts", "similar_pairs_lexical", "kappa_by_field", "weighted_metrics", "graph_nodes", "keyword_search", "low_features", "feature_recommendations", "stratified_sample", "resume_anti_join"]


def rows_of(rows, names):
    def plain(x):
        return None if x is None or isinstance(x, float) and math.isnan(x) else float(x) if isinstance(x, (int, float)) and not isinstance(x, bool) else str(x)

    return sorted((tuple(plain(r[n]) for n in names) for r in rows), key=repr)


def duck(sf):
    import duckdb

    c = duckdb.connect()
    for p in sf.glob("*.parquet"):
        c.execute(f"create view {p.stem} as select * from '{p}'")
    return c


def compare(spark, query, sql):
    found = query(spark, str(SF))
    names = sorted(found.columns)
    cursor = duck(SF).execute(sql)
    columns = [d[0] for d in cursor.description]
    assert sorted(columns) == names
    assert rows_of([r.asDict() for r in found.collect()], names) == rows_of([dict(zip(columns, r)) for r in cursor.fetchall()], names)


def test_every_sql_has_a_query():
    assert set(plans.oracle_sql()) <= set(plans.queries())


@pytest.mark.skipif(not SF.exists(), reason="no test data")
@pytest.mark.parametrize("name", CHECKED)
def test_against_sql(spark, name):
    compare(spark, plans.queries()[name], plans.oracle_sql()[name])


@pytest.mark.skipif(not SF.exists(), reason="no test data")
def test_flagship(spark):
    rows = plans.flagship(spark, str(SF)).collect()
    assert rows and all(r.support >= 1 and r.n_members >= r.support for r in rows)
