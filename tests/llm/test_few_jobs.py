"""Near-dedup's components are worked out only where links are new: every job's plan and tasks stay in the driver's memory."""

from pyspark.sql import functions as F

from quarry.llm import components, groups


def test_components_stop_at_the_first_round_without_a_change(spark, monkeypatch):
    written = []
    monkeypatch.setattr(components, "staged", lambda df, name, staged=components.staged: written.append(name) or staged(df, name))
    links = spark.createDataFrame([(5, 1), (5, 9), (7, 8)], "a long, b long")
    assert sorted(map(tuple, components.connected_components(links).collect())) == [(1, 1), (5, 1), (7, 7), (8, 7), (9, 1)]
    assert len(written) == 5, written  # links, first roots, two for a round, one to see that nothing changed


def test_no_components_without_new_links(spark, monkeypatch):
    asked = []
    monkeypatch.setattr(groups, "connected_components", lambda links: asked.append(1) or components.connected_components(links))
    # seven shingles are common to all and three to two nodes each, so no two of forty are similar
    shared = [[1000 * d + min(i, i ^ d) for d in (1, 2, 4)] + list(range(10**6, 10**6 + 7)) for i in range(40)]
    sets = spark.createDataFrame([*enumerate(shared), (40, shared[0])], "node long, has array<long>")
    lists = sets.select(F.lit(1).cast("long").alias("key"), "node", F.lit(10).alias("n"), F.lit(41).cast("long").alias("c"))
    got = sorted(map(tuple, groups.verified_links(lists, sets, 0.8).collect()))
    assert got == [(0, 0), (40, 0)] and len(asked) == 1, (got, len(asked))
