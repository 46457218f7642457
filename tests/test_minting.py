"""Links, minted firms and people, against a loop over mentions."""

from quarry.operators.minting import link_tables

MENTION = "deal_id long, place int, name string, role string"


def run(spark, said, firms=((1, "Acme Capital"), (2, "Beta Partners"), (3, "acme capital")), people=((10, "Jane Doe", None), (11, "Jane Doe", 1), (12, "Bo Ek", 2), (13, "O'Neil Smith", None))):
    m = spark.createDataFrame([(d, p, n, r) for d, p, n, r in said], MENTION)
    out = link_tables(m, spark.createDataFrame(list(firms), "id long, name string"), spark.createDataFrame(list(people), "id long, name string, firm_id long"))
    return {k: sorted(map(tuple, v.collect())) for k, v in out.items()}


def test_five_tables(spark):
    said = [
        (1, 0, "ACME CAPITAL", "lead"), (1, 1, "Beta Partners LP", None), (1, 2, "Gamma Growth Fund", "participant"), (1, 3, "acme capital", "participant"), (1, 4, "Jane Doe", "lead"), (1, 5, "Bo Ek", "lead"),
        (2, 0, "GAMMA growth FUND", "lead"), (2, 1, "50 investors", "lead"), (2, 2, "Alpha Fund and Beta Fund", None), (2, 3, "Oneil Smith", None), (2, 4, "Cy Day Jr", "lead"), (2, 5, "Intel", None), (3, 0, "Acme Ventures", None),
        (3, 1, None, "lead"), (3, 2, " ", "lead"), (4, 0, "cy day jr", None)]
    got = run(spark, said)
    # ids in the order of names: gamma growth fund, intel; acmeventures (two capitalized words), boek (people of a firm don't count), cydayjr
    assert got["new_firms"] == [(4, "Gamma Growth Fund"), (5, "Intel")]
    assert got["new_investors"] == [(14, "Acme Ventures"), (15, "Bo Ek"), (16, "Cy Day Jr")]
    assert got["deal_firms"] == [(1, 1, "lead"), (1, 2, "participant"), (1, 4, "participant"), (2, 4, "lead"), (2, 5, "participant")]
    assert got["deal_investors"] == [(1, 10), (1, 15), (2, 13), (2, 16), (3, 14), (4, 16)]
    assert got["leads"] == [(1, 10), (2, 16)]
    assert run(spark, said[::-1]) == got  # the order of rows doesn't matter, a repeated run gives the same ids


def test_nothing_to_link(spark):
    assert run(spark, []) == run(spark, [(1, 0, None, "lead")]) == {"deal_firms": [], "deal_investors": [], "new_firms": [], "new_investors": [], "leads": []}
    got = run(spark, [(1, 0, "Gamma Growth Fund", None), (1, 1, "Jane Doe", None)], firms=(), people=())
    assert got["new_firms"] == [(1, "Gamma Growth Fund")] and got["new_investors"] == [(1, "Jane Doe")]
