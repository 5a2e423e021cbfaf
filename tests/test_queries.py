"""Every registered query of the library against its SQL on the smallest tables."""

import math
import os
from collections import Counter

import duckdb
import pytest
from conftest import TESTDATA

from newsquant import registry

SF = f"{TESTDATA}/sf0.001"


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for name in os.listdir(SF):
        con.execute(f"create view {name.removesuffix('.parquet')} as select * from '{SF}/{name}'")
    return con


def plain(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return None
    return f"{v:.9g}" if isinstance(v, float) else str(v)


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_equals_sql(spark, db, name):
    rows = registry.queries()[name](spark, SF)
    found = db.execute(registry.oracle_sql()[name])
    columns = [c[0] for c in found.description]
    assert sorted(columns) == sorted(rows.columns)
    key = lambda r: str(r)
    assert sorted(([plain(r[c]) for c in columns] for r in rows.collect()), key=key) == sorted(([plain(v) for v in r] for r in found.fetchall()), key=key)


def test_clusters_take_in_every_article(spark):
    """The one query without SQL: k-means cannot be said in it."""
    assert set(registry.queries()) - set(registry.oracle_sql()) == {"M2_cluster_topics"}
    rows = registry.queries()["M2_cluster_topics"](spark, SF).collect()
    sizes = Counter(r["topic_id"] for r in rows)
    assert len({r["article_id"] for r in rows}) == len(rows) == spark.read.parquet(f"{SF}/embeddings.parquet").count()
    topics = sorted(t for t in sizes if t >= 0)
    assert topics == list(range(len(topics))) and all(sizes[a] >= sizes[b] >= 8 for a, b in zip(topics, topics[1:]))


def test_names_need_no_session():
    """The lists can be read in a process that never starts Spark."""
    import subprocess
    import sys

    code = "import __spark_entry__ as e; assert set(e.oracle_sql()) <= set(e.queries())"
    subprocess.run([sys.executable, "-c", code], cwd=os.path.dirname(os.path.dirname(os.path.abspath(__file__))), check=True)
