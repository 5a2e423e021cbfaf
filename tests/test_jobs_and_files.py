"""Streams, caches, snapshots and report files on planted rows."""

from datetime import datetime

import pandas as pd
import pytest

from newsquant.functions.columns import safe_integer
from newsquant.operators import matching, reporting, selection
from newsquant.sources import readers
from newsquant.streaming import status
from pyspark.sql import functions as F

AT = lambda m: datetime(2024, 1, 1, 0, m)
LOG = [
    (1, AT(0), "pending", None, None), (1, AT(1), "running", None, ""), (1, AT(5), "completed", "r1", None), (2, AT(2), "failed", None, "first fault"),
    (2, AT(4), "failed", None, "second fault"), (2, AT(9), "running", None, None), (3, AT(3), "completed", "r3", None), (3, AT(3), "completed", "r3", None), (4, AT(1), "pending", None, None),
]


def test_status_stream_equals_batch(spark, tmp_path):
    source, target, state = (f"file://{tmp_path}/{n}" for n in ("source", "target", "state"))
    late = [LOG[i] for i in (2, 5, 6, 3)], [LOG[i] for i in (0, 7, 4)], [LOG[i] for i in (1, 8)]
    for rows in late:  # early events come last
        spark.createDataFrame(rows, status.EVENTS).repartition(2).write.mode("append").parquet(source)
        status.follow_status(spark, source, target, state, files_at_once=1)
    status.follow_status(spark, source, target, state)  # nothing new
    got = {r["job_id"]: tuple(r)[1:] for r in status.read_status(spark, target).collect()}
    assert got == {r["job_id"]: tuple(r)[1:] for r in reporting.latest_status(spark.createDataFrame(LOG, status.EVENTS)).collect()}
    assert got == {
        1: ("completed", AT(5), AT(5), "r1", None, 3), 2: ("running", AT(9), None, None, "second fault", 3),
        3: ("completed", AT(3), AT(3), "r3", None, 2), 4: ("pending", AT(1), None, None, None, 1),
    }


def test_logit_cache_asks_once(spark, tmp_path):
    path, seen = f"file://{tmp_path}/cache", spark.sparkContext.accumulator(0)

    def score(rows: pd.DataFrame) -> pd.Series:
        seen.add(len(rows))
        return rows["hypothesis"].str.len() + rows["more"]

    kind = "desc_md5 string, hypothesis string, more double"
    first = spark.createDataFrame([("aa1", "x", 0.5), ("aa1", "x", 0.5), ("bb2", "yy", 0.0), (None, "z", 0.0)], kind)
    assert matching.read_logits(spark, path).collect() == []
    assert matching.fill_logits(spark, path, first, score) == 2
    assert matching.fill_logits(spark, path, first, score) == 0
    more = spark.createDataFrame([("aa1", "x", 9.0), ("aa1", "zzz", 0.0)], kind)
    assert matching.fill_logits(spark, path, more, score) == 1 and seen.value == 3
    got = {(r["part"], r["desc_md5"], r["hypothesis"]): r["logit"] for r in matching.read_logits(spark, path).collect()}
    assert got == {("aa", "aa1", "x"): 1.5, ("bb", "bb2", "yy"): 2.0, ("aa", "aa1", "zzz"): 3.0}


KIND = "Ticker string, Name string, Description string, Keywords string, Sector string, Industry string"


def test_snapshots_keep_what_is_known(spark, tmp_path):
    path = f"file://{tmp_path}/companies"
    assert readers.read_snapshot(spark, path) is None
    old = spark.createDataFrame([("A", "Al", "old text", "k1, k2", "s", ""), ("B", "Bo", "b", "kb", "", "i"), ("C", "Ce", "c", "kc", "", "")], KIND)
    new = spark.createDataFrame([("A", "", " ", "ignored", "t", None), ("B", "Bob", "b2", "", None, ""), ("D", "De", None, "kd", "", "")], KIND)
    assert sorted(map(tuple, readers.update_companies(spark, path, old).collect())) == sorted(map(tuple, old.collect()))
    got = {r["Ticker"]: tuple(r)[1:] for r in readers.update_companies(spark, path, new).collect()}
    assert got == {"A": ("Al", "old text", "k1, k2", "t", ""), "B": ("Bob", "b2", "", "", "i"), "C": ("Ce", "c", "kc", "", ""), "D": ("De", "", "kd", "", "")}
    # a version without its mark of completion is not read
    spark.createDataFrame([("Z", "", "", "", "", "")], KIND).write.parquet(f"{path}/v=9")
    (tmp_path / "companies" / "v=9" / "_SUCCESS").unlink()
    assert {r["Ticker"] for r in readers.read_snapshot(spark, path).collect()} == {"A", "B", "C", "D"}


def test_companies_and_numbers_from_files(spark, tmp_path):
    (tmp_path / "c.csv").write_text('Ticker , Name,Description,Keywords\n AB ,"Al, ""the"" Co","two\nlines",k\n,No ticker,d,k\nCD,,d,k\nEF,Ef Inc,,\n')
    rows = {r["ticker"]: r for r in readers.read_companies(spark, f"file://{tmp_path}/c.csv").collect()}
    assert set(rows) == {"AB", "EF"}
    assert (rows["AB"]["name"], rows["AB"]["description"], rows["AB"]["combined_text"]) == ('Al, "the" Co', "two\nlines", 'al, "the" co two\nlines k')
    assert rows["EF"]["combined_text"] == "ef inc  " and rows["EF"]["ticker_lower"] == "ef"
    (tmp_path / "cik.txt").write_text("aapl\t320193\nbad line\na\tb\tc\nmsft\t789019\naapl\t1\n")
    assert {tuple(r) for r in readers.read_cik_map(spark, f"file://{tmp_path}/cik.txt").collect()} == {("AAPL", "0000000001"), ("MSFT", "0000789019")}


def test_reports_are_named_and_listed(spark, tmp_path):
    folder = f"file://{tmp_path}/reports"
    columns = ", ".join(f"{n} {'string' if d is None and n not in ('Topic_ID',) else 'double' if d is not None else 'int'}" for n, _, d, _ in reporting.REPORT)
    report = spark.createDataFrame([tuple(1 if n == "Topic_ID" else None for n, _, _, _ in reporting.REPORT)], columns)
    for depth, at, user in ((1, datetime(2024, 5, 6, 7), None), (2, datetime(2024, 5, 7, 0), None), (3, datetime(2025, 1, 1), "u7")):
        readers.write_named_report(report, folder, depth, at, user)
    (tmp_path / "reports" / "topic_notes.csv").write_text("x")
    got = reporting.report_catalog(readers.list_files(spark, folder)).collect()
    assert [(r["name"], r["depth"], r["made_at"]) for r in got] == [("topic_companies_multitimeframe_depth-2_05-07-2024_00.csv", 2, datetime(2024, 5, 7)), ("topic_companies_multitimeframe_depth-1_05-06-2024_07.csv", 1, datetime(2024, 5, 6, 7))]
    assert all(r["length"] > 0 for r in got) and (tmp_path / "reports" / "u7_topic_companies_multitimeframe_depth-3_01-01-2025_00.csv").exists()


@pytest.mark.parametrize("buckets", [1, 16])
def test_selection_by_words_and_dates(spark, buckets):
    long = "filler " * 60
    rows = [(i, f"{long} Alpha beta alphabet {'alpha ' * (i % 3)}", datetime(2024, 1, 1 + i)) for i in range(20)] + [(50, "alpha", datetime(2024, 1, 5)), (51, long, datetime(2024, 1, 5)), (52, long + "gamma Delta", None)]
    articles = spark.createDataFrame(rows, "article_id long, body string, date timestamp")
    asked = spark.createDataFrame([(0, ["ALPHA", "beta alphabet"]), (1, ["gamma delta", "none"]), (2, ["lph"])], "query_id int, alternatives array<string>")
    at = lambda d: F.lit(f"2024-01-{d:02}").cast("timestamp")
    out = selection.select_articles(articles, asked, at(3), at(15), most=4, buckets=buckets)
    best = sorted((i for i in range(2, 15)), key=lambda i: (-(2 + i % 3), i))[:4]
    assert sorted(map(tuple, out.collect())) == [(0, i, 2 + i % 3, k) for k, i in enumerate(best, 1)]
    assert {(r["query_id"], r["article_id"]) for r in selection.select_articles(articles, asked, most=1000).where("query_id > 0").collect()} == {(1, 52)}
    assert "NestedLoop" not in out._jdf.queryExecution().executedPlan().toString()


def test_safe_integers(spark):
    given = {"12.9": 12, "-3.7": -3, "1e15": 10**15, "1.1e15": None, "x": None, "NaN": None, "inf": None, None: None, "-1e300": None}
    df = spark.createDataFrame([(k,) for k in given], "x string").select("x", safe_integer(F.col("x")).alias("n"))
    assert {r["x"]: r["n"] for r in df.collect()} == given
