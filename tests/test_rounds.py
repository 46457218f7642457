"""Clusters of rounds against a fold over each company's deals."""

import datetime
import random

from quarry.operators.cleaning import merge_duplicates, round_clusters

DEAL = "id long, company_name_normalized string, stage string, amount_usd double, date_announced date"


def fold(deals):
    leads, out = {}, {}
    for i, name, stage, amount, day in sorted(deals, key=lambda r: r[0]):
        if not name:
            continue
        for lead in leads.setdefault(name, []):
            similar = None if not amount or not lead[3] else max(amount, lead[3]) / max(min(amount, lead[3]), 1) <= 2
            close = None if day is None or lead[4] is None else abs((day - lead[4]).days) <= 180
            same = len({stage, lead[2]} - {"Unknown"}) <= 1
            if similar is True and close is not False or close is True and similar is None or similar is None and close is not False and same:
                out[i] = lead[0]
                break
        else:
            leads[name].append((i, name, stage, amount, day))
            out[i] = i
    return out


def made(seed, n, names, years=6):
    pick, start = random.Random(seed), datetime.date(2015, 1, 1)
    ids = pick.sample(range(10 * n), n)
    return [(i, pick.choice(names), pick.choice(["Seed", "Series A", "Unknown"]), pick.choice([None, 0.0, 0.5, pick.uniform(1e5, 1e8), 2e6]), None if pick.random() < 0.1 else start + datetime.timedelta(pick.randint(0, 365 * years))) for i in ids]


def clusters(spark, deals):
    return {r.id: r.lead_id for r in round_clusters(spark.createDataFrame(deals, DEAL)).collect()}


def test_clusters_equal_the_fold(spark):
    for seed, n, names in ((1, 300, ["a", "b", "c", "", None]), (2, 250, ["one"])):
        deals = made(seed, n, names)
        assert clusters(spark, deals) == fold(deals)


def test_folded_and_joined_companies_agree(spark):
    deals = made(4, 400, ["a", "b", "c"]) + [(10_000 + i, "one" + str(i % 40), "Seed", 1e6 * (i + 1), None) for i in range(80)]
    frame = spark.createDataFrame(deals, DEAL)
    for most in (0, 2, 130, 2000):
        assert {r.id: r.lead_id for r in round_clusters(frame, most).collect()} == fold(deals)


def test_small_companies_take_no_rounds(spark, monkeypatch):
    """Rounds of joins over all deals made the merges grow beyond their time; companies with few deals don't need them."""
    from quarry.operators import cleaning

    monkeypatch.setattr(cleaning, "_by_rounds", None)
    deals = made(5, 200, ["a", "b"])
    assert clusters(spark, deals) == fold(deals)


def test_clusters_of_a_chain_of_dates(spark):
    """Each deal fits the one before it, so that openers depend on openers."""
    day = datetime.date(2010, 1, 1)
    deals = [(i, "chain", "Seed", None, day + datetime.timedelta(100 * i)) for i in range(30)]
    assert clusters(spark, deals) == fold(deals)


def test_a_company_of_a_hundred_thousand_deals(spark):
    deals = made(3, 100_000, ["hot"], 3)
    assert clusters(spark, deals) == fold(deals)


def test_no_deals(spark):
    assert clusters(spark, []) == {} and clusters(spark, [(1, "", "Seed", None, None), (2, None, "Seed", None, None)]) == {}


def test_merge_moves_links_and_drops_metadata(spark):
    kind = DEAL + ", confidence_score double, company_website string, company_description string"
    day = datetime.date(2020, 1, 1)
    deals = spark.createDataFrame([(1, "a", "Seed", 1e6, day, 0.5, None, "d"), (2, "a", "Seed", 1.5e6, day, 0.9, None, ""), (3, "a", "Seed", 9e6, day, 0.4, "w", None), (4, "", "Seed", None, None, 0.1, None, None)], kind)
    firms = spark.createDataFrame([(1, 7, "lead"), (2, 7, "participant"), (3, 8, "lead")], "deal_id long, firm_id long, role string")
    people = spark.createDataFrame([(1, 5), (2, 5), (1, 6)], "deal_id long, investor_id long")
    facts = spark.createDataFrame([(1, "k", "x"), (2, "k", "y"), (3, "k", "z")], "deal_id long, key string, value string")
    d, f, p, m = merge_duplicates(deals, firms, people, facts)
    assert sorted((r.id, r.amount_usd, r.company_website, r.company_description) for r in d.collect()) == [(2, 1.5e6, None, "d"), (3, 9e6, "w", None), (4, None, None, None)]
    assert sorted(map(tuple, f.collect())) == [(2, 7, "lead"), (3, 8, "lead")] and sorted(map(tuple, p.collect())) == [(2, 5), (2, 6)]
    assert sorted(map(tuple, m.collect())) == [(2, "k", "y"), (3, "k", "z")]
