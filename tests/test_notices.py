"""Matches of new deals and users: small blocks against brute force, and what they take when written."""

import os

from quarry.operators import notices
from quarry.sources.tables import Tables

DATA = "/root/testdata/sf0.001"


def tables(spark, wants):
    t = Tables(spark, DATA)
    t.preferences = spark.createDataFrame(wants, "user_id long, key string, value string")
    t.categories = spark.createDataFrame([(7, "A"), (8, "B"), (9, "C"), (9, "D")], "id long, name string")
    return t


def test_matches_in_many_blocks_equal_brute_force(spark, monkeypatch):
    """Also deals and users without an id, deals of two sectors, users of several wishes and those told of nearly all."""
    monkeypatch.setattr(notices, "BLOCK", 8, raising=False)
    monkeypatch.setattr(notices, "RUN", 3, raising=False)
    monkeypatch.setattr(notices, "MET", 2, raising=False)
    stages = ("Seed", "Series A", "Unknown")
    listed = {u: {"ABCD"[u % 4], "ABCD"[u % 3]} for u in range(60)} | {None: {"A"}}
    staged = {u: {stages[u % 3]} for u in range(0, 60, 5)}
    wants = [(u, "sectors", '["' + '", "'.join(sorted(x)) + '"]') for u, x in listed.items()] + [(u, "stages", f'["{y}"]') for u, x in staged.items() for y in x]
    deals = [(i if i else None, None if i % 11 == 10 else 7 + i % 3, stages[i % 2 + i % 5 % 2]) for i in range(90)]
    names = {7: {"A"}, 8: {"B"}, 9: {"C", "D"}, None: set()}
    known = {(u, d) for u in range(60) for d in range(1, 90) if (u * d) % 7 == 3 or u == 9 and d > 4 or d == 12}
    sent = [(u, d, "match") for u, d in known] + [(None, 5, "match"), (1, None, "match"), (2, 6, "follow_on")]
    got = notices.notify_match(spark.createDataFrame(deals, "id long, category_id long, stage string"), tables(spark, wants), spark.createDataFrame(sent, "user_id long, deal_id long, kind string"))
    users = [*range(60), None]
    wanted = [(u, d) for d, k, s in deals for u in users if (listed.get(u, set()) & names[k] or s in staged.get(u, ())) and (u, d) not in known]
    assert sorted(str((r.user_id, r.deal_id)) for r in got.collect()) == sorted(map(str, wanted)) and len(wanted) > 1000


def test_written_matches_take_little_room(spark, tmp_path):
    t = tables(spark, [(u * 3, "sectors", '["A"]') for u in range(100)])
    new = spark.range(40000).selectExpr("id", "7L as category_id", "'Seed' as stage")
    sent = spark.createDataFrame([(3, 5, "match")], "user_id long, deal_id long, kind string")
    path = str(tmp_path / "out")
    notices.notify_match(new, t, sent).write.parquet(path)
    rows = spark.read.parquet(path).count()
    size = sum(os.path.getsize(os.path.join(path, f)) for f in os.listdir(path) if f.endswith(".parquet"))
    assert rows == 100 * 40000 - 1 and size < 0.5 * rows
