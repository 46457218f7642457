"""Every query with SQL against DuckDB on the smallest tables; invariants for the rest."""

import glob
import os

import duckdb
import pandas as pd
import pytest

from quarry.operators.gates import _candidates, deal_gate, duplicates_of, learn_patterns
from quarry.operators.listing import write_csv, write_json
from quarry.operators.notices import notify_match
from quarry.operators.upkeep import insert_or_ignore, read_snapshot, upsert, write_snapshot
from quarry.plans import catalog
from quarry.sources import landed, tables
from quarry.sources.tables import Tables
from quarry.streaming.feeds import add_patterns, learning_gate, merged_batches

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for path in glob.glob(f"{DATA}/*.parquet"):
        c.sql(f"create view {os.path.basename(path)[:-8]} as select * from '{path}'")
    return c


def plain(x):
    if x is None or x is pd.NA or x is pd.NaT or x != x:
        return None
    if hasattr(x, "isoformat"):
        return str(x)[:26].replace(" 00:00:00", "")
    if isinstance(x, float) and x == int(x):
        return int(x)
    return x.item() if hasattr(x, "item") else x


def rows(frame):
    frame = frame[sorted(frame.columns)]
    return list(frame.columns), sorted(repr(tuple(map(plain, r))) for r in frame.astype(object).itertuples(index=False, name=None))


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_query_equals_sql(spark, duck, name):
    assert rows(catalog.queries()[name](spark, DATA).toPandas()) == rows(duck.sql(catalog.oracle_sql()[name]).df())


def test_queries_without_sql_have_tests_of_their_own():
    assert set(catalog.queries()) - set(catalog.oracle_sql()) == {"article_text"}  # tests/test_pages.py holds it against the pages' markup


def test_gate_gives_each_candidate_one_outcome(spark):
    t = Tables(spark, DATA)
    got = deal_gate(_candidates(t), t.firms, t.deals.where("id % 10 <> 3"), learn_patterns(t)).collect()
    assert len(got) == len({x.id for x in got}) == _candidates(t).count()
    assert {x.reason for x in got} >= {None, "bad_name", "bad_name_pattern", "empty_name", "vc_firm", "duplicate"}
    assert all((x.reason is None) == (x.confidence_score is not None) for x in got)


def test_duplicates_by_fuzzy_names(spark):
    """Brute force over the rule: a name that is not stored but holds, or is held by, a stored one of nearly its length."""
    deal = "id long, company_name string, company_name_normalized string, stage string, amount_usd double, date_announced date"
    old = [(1, "Acme Robotics", "acmerobotics", "Seed", 5e6, None), (2, "Northern Light Insurance Holdings", "northernlightinsuranceholdings", "Seed", None, None), (3, "Zed", "zed", "Seed", None, None)]
    new = [(11, "Acme Robotics AI", "", "Seed", 6e6, None), (12, "Acme Robotics AI", "", "Series A", 5e7, None), (13, "Northern Light Insurance Holding", "", "Unknown", None, None), (14, "Acme", "", "Seed", None, None), (15, "Zed Inc", "", "Seed", None, None)]
    got = duplicates_of(spark.createDataFrame(new, deal), spark.createDataFrame(old, deal)).collect()
    assert {x.id for x in got} == {11, 13}


def test_streams_go_on_where_they_stopped(spark, tmp_path):
    source, folder = str(tmp_path / "in"), str(tmp_path / "out")
    spark.createDataFrame([("a", 1)], "event_type string, user_id long").selectExpr("*", "timestamp'2024-01-01' as ts").write.parquet(source)
    rows = spark.readStream.schema("event_type string, user_id long, ts timestamp").parquet(source)
    first = merged_batches(rows, add_patterns, "p", folder)
    spark.createDataFrame([("a", 1), ("b", 2)], "event_type string, user_id long").selectExpr("*", "timestamp'2024-01-02' as ts").write.mode("append").parquet(source)
    second = merged_batches(rows, add_patterns, "p", folder)
    assert first != second and {(r.event_type, r.hits) for r in spark.read.parquet(second).collect()} == {("a", 2), ("b", 1)}
    assert merged_batches(rows, add_patterns, "p", folder) == second


def test_patterns_learned_in_a_batch_reject_in_the_next(spark, tmp_path):
    """Three batches, a restart on the same folder, and a fourth: five rejections of a name teach those after them."""
    source, folder = str(tmp_path / "in"), str(tmp_path / "gate")
    firms = spark.createDataFrame([("Acme Capital",)], "name string")
    stream = lambda: spark.readStream.schema("event_id long, name string, ts timestamp").option("maxFilesPerTrigger", 1).parquet(source)
    land = lambda start, *names: spark.createDataFrame([(start + i, x) for i, x in enumerate(names)], "event_id long, name string").selectExpr("*", "timestamp'2024-01-01' as ts").coalesce(1).write.mode("append").parquet(source)
    for n in range(3):
        land(10 * n, *["Acme Capital"] * 2, "Ramp", "x", *["ACME capital"] * (n == 1))
    first = {r.event_id: (r.batch, r.reason) for r in learning_gate(stream(), firms, folder).collect()}
    assert {r for _, r in first.values()} == {"vc_firm", None, "empty_name"} or first[20] == (2, "auto_reject")
    assert first[0] == (0, "vc_firm") and first[10] == (1, "vc_firm") and first[14] == (1, "vc_firm") and first[20] == (2, "auto_reject") and first[22] == (2, None) and first[23] == (2, "empty_name")
    land(30, "acme-capital", "Ramp")
    again = {r.event_id: (r.batch, r.reason) for r in learning_gate(stream(), firms, folder).collect()}
    assert {k: v for k, v in again.items() if k < 30} == first and again[30] == (3, "auto_reject") and again[31] == (3, None)
    assert spark.read.parquet(f"{folder}/patterns/v3").where("reason = 'vc_firm'").first().hits == 5


def test_partitions_of_links_grow_with_the_table(spark, duck, monkeypatch):
    monkeypatch.setattr(tables, "PART_ROWS", 500)
    t = Tables(spark, DATA)
    assert t.parts >= 12 and t.deal_firms.rdd.getNumPartitions() == t.deal_investors.rdd.getNumPartitions() == t.parts
    for name in ("coinvestors", "partners_by_category", "portfolio_linked", "insert_or_ignore", "rawtext_investors"):
        assert rows(catalog.queries()[name](spark, DATA).toPandas()) == rows(duck.sql(catalog.oracle_sql()[name]).df())


def test_matches_are_not_sorted_and_known_ones_left_out(spark):
    """Users told of none, some and very many new deals, a user without an id, and one of both preferences."""
    t = Tables(spark, DATA)
    t.preferences = spark.createDataFrame([(u, "sectors", '["A"]') for u in (1, 2, 3, None)] + [(u, "stages", '["Seed"]') for u in (1, 4)] + [(5, "sectors", "{broken")], "user_id long, key string, value string")
    t.categories = spark.createDataFrame([(7, "A"), (8, "B")], "id long, name string")
    new = spark.createDataFrame([(i, 7 + i % 2, "Seed" if i % 3 == 0 else "Unknown") for i in range(200)] + [(200, None, "Seed")], "id long, category_id long, stage string")
    known = {(2, i) for i in range(0, 8, 2)} | {(3, i) for i in range(100)} | {(4, 3)}
    sent = spark.createDataFrame([(u, d, "match") for u, d in known] + [(1, 0, "follow_on")], "user_id long, deal_id long, kind string")
    got = notify_match(new, t, sent)
    wanted = [(u, i) for i in range(201) for u in (1, 2, 3, None, 4) if i % 2 == 0 and i < 200 and u != 4 or (i % 3 == 0 or i == 200) and u in (1, 4)]
    assert sorted(map(str, ((r.user_id, r.deal_id) for r in got.collect()))) == sorted(str(x) for x in wanted if x not in known)
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate" not in plan  # matches are not made distinct


def test_upserts(spark, tmp_path):
    old = spark.createDataFrame([(1, "a", None), (2, "b", "x")], "id int, name string, site string")
    new = spark.createDataFrame([(2, None, "y"), (3, "c", None)], "id int, name string, site string")
    got = upsert(old, new, ["id"])
    assert sorted(map(tuple, got.collect())) == [(1, "a", None), (2, "b", "y"), (3, "c", None)]
    assert sorted(map(tuple, upsert(got, new, ["id"]).collect())) == sorted(map(tuple, got.collect()))
    assert insert_or_ignore(old, new, ["id"]).count() == 3
    path = write_snapshot(got, str(tmp_path / "t"))
    assert read_snapshot(spark, path).count() == 3 and write_snapshot(got, str(tmp_path / "t")) != path


def test_sinks_and_files(spark, tmp_path):
    rows_ = spark.createDataFrame([(1, "a"), (2, "b,c")], "id int, name string")
    write_csv(rows_, str(tmp_path / "csv"))
    write_json(rows_, str(tmp_path / "json"))
    assert spark.read.option("header", True).csv(str(tmp_path / "csv")).count() == 2 and spark.read.json(str(tmp_path / "json")).count() == 2
    (tmp_path / "feed.xml").write_text("<rss><channel><item><title>Acme raises $5M &amp; more</title><link>https://a</link><pubDate>Wed, 12 Feb 2025 08:00:00 GMT</pubDate></item><item><title>Weather</title></item></channel></rss>")
    got = landed.read_rss(spark, str(tmp_path / "feed.xml")).collect()
    assert len(got) == 1 and got[0].title == "Acme raises $5M & more" and str(got[0].date_announced) == "2025-02-12"
    (tmp_path / "awards.csv").write_text("Firm,State,Award Date,Amount\nAcme,NY,02/12/2025,\"$1,000\"\nZed,TX,2025-01-01,5\n")
    assert [(r.firm, r.amount) for r in landed.read_awards(spark, str(tmp_path / "awards.csv")).collect()] == [("Acme", 1000.0)]
