"""Names of companies in lists, and backers in texts: golden rows and brute force."""

import itertools
import re

from pyspark.sql import functions as F

from quarry.functions import portfolio as P
from quarry.operators.enrichment import investor_candidates, text_backers

GOOD = (
    "Ramp", "FJ Labs", "Fintechly", "AIrtable", "Spacelift", "SocialChorus Inc", "Securityx", "Acquire.com", "Acquired.io", "Hardware Club", "MediaMath", "Consumer Physics", "23andMe", "Loom",
    "Series", "Bay Area Foods", "New Yorker", "Filterly", "Alloy", "Climate Corp", "The Browser Company", "Status Money", "Strategy", "Education2", "Aboutly")
BAD = (
    "", " ", "x", "2021", "12345", "Learn More", "About Acme", "FintechHealthcareSaaS", "AIConsumer", "Media/Commerce", "AI & Security2020", "Hardware", "Consumer Media 2019", "Acme Sector: Fintech",
    "AcmeSectorAI", "AcmeAllHR", "Exitfalse", "Acquired by Google", "Exited to X", "IPOVentures", "NYCALLother", "StatusLive", "ConsumerExited", "Investment Year2025", "SpyceFoodAll", "CountryUS",
    "saas", "London", "Showcasing our best", "a@b.co", "@acme", "LinkedIn Icon", "Seed RoundSeedSeries A", "StrategySoftware", "Founders' First Portfolio", "It is a thing.", "The age of agents",
    "Acme Robotics is a platform for all of us here", "we build the tools for people in need", "AI-powered widgets", "A very long name that ends as some Platform", "Media2020", "Invested2021",
    "AI2024", "(stealth)", "Acq: Beta", "NYSE: ABC", "Built by Acme", "Austin, TX Acme", "Filter by sector", "Social Starts Series A", "New York, NY and Enterprise", "a" * 61)


def judged(spark, names, rule=P.is_company_name):
    rows = spark.createDataFrame([(x,) for x in names], "n string").repartition(2)
    return {r.n: r.v for r in rows.select("n", rule(F.col("n")).alias("v")).collect()}


def test_company_names(spark):
    got = judged(spark, [*GOOD, *BAD, None])
    wrong_good = [x for x in GOOD if x not in ("Strategy", "Hardware Club") and not got[x]]
    assert not wrong_good and got["Strategy"] is False and got[None] is False
    assert [x for x in BAD if got[x]] == []


def falls(text, tokens):
    fits = [True] + [False] * len(text)
    for i in range(1, len(text) + 1):
        fits[i] = any(text[:i].endswith(t) and fits[i - len(t)] for t in tokens)
    return bool(text) and fits[-1]


def test_glued_words_equal_brute_force(spark):
    tokens = ("A", "AB", "BA", "CAB", "DD")
    texts = ["".join(x) for n in range(6) for x in itertools.product("ABCD", repeat=n)]
    rows = spark.createDataFrame([(x,) for x in texts], "n string")
    got = {r.n: r.v for r in rows.select("n", P.glued_of(F.col("n"), tokens).alias("v")).collect()}
    assert got == {x: falls(x, tokens) for x in texts}


def test_glued_words_of_tokens_that_begin_no_other_are_one_pattern(spark):
    tokens = ("AB", "B", "CA", "&", " ")
    texts = ["".join(x) for n in range(6) for x in itertools.product("ABC&", repeat=n)] + ["AB\n", "B CA "]
    rows = spark.createDataFrame([(x,) for x in [*texts, None]], "n string")
    value = P.glued_of(F.col("n"), tokens)
    assert {r.n: r.v for r in rows.select("n", value.alias("v")).collect()} == {x: falls(x, tokens) for x in texts} | {None: False}
    assert "aggregate" not in str(value) and "aggregate" not in str(P.is_company_name(F.col("n")))  # no fold over letters


def test_every_glue_of_two_to_four_category_words_is_rejected(spark):
    c = P.CATEGORY_TOKENS
    glued = [a + b for a in c for b in c] + [a + b + d for a in c[:9] for b in c[::3] for d in c[1::4]] + [c[i % 25] + c[i % 7] + c[i % 11] + c[i % 13] for i in range(90)]
    assert not any(judged(spark, glued).values())
    assert all(judged(spark, [x + "ly" for x in c if x not in ("AI", "Strategy", "Featured")] + [f"{x} Works" for x in c if x not in ("AI", "Brands", "Featured")]).values())


def test_junk_rows(spark):
    got = judged(spark, ["1999", "Acme Exit", "Acme" + "x" * 30 + "Exit", "country: US", "Go-To-Market Services", "Canada", "Spotlight on: Acme", "Spotlight Acme", "Filter", "Filter it all", "Austin, TX", "Austin, TX 77", "Acme", "NYSE", "play video", None], P.is_junk_row)
    assert {x for x, v in got.items() if not v} == {"Acme" + "x" * 30 + "Exit", "Spotlight Acme", "Austin, TX", "Acme", None}


TEXTS = {
    1: ("Acme", "Acme raises $5M led by Sequoia Capital and Jane Doe. It was backed by Lux Capital Management group, the Big Fund"),
    2: ("Beta", "Beta, LED BY alpha ventures!\nParticipation from A Fund, Index Ventures & Thrive Capital; more"),
    3: ("Gamma", "Gamma has raised $7.5M from Gamma, One Two Three Four Five Capital and Bessemer Venture Partners"),
    4: ("Delta", "$12M From Unknown People, with funding from Known Firm. Whose investors include Ab and Investment  from Founders Fund"),
    5: ("Eps", "Series B from Accel Labs; nothing"), 6: ("Zeta", None), 7: ("Eta", "led by someone"), 8: ("Theta", "no phrase here"),
}


def test_backers_of_texts(spark):
    rows = spark.createDataFrame([(i, c, x) for i, (c, x) in TEXTS.items()], "id long, company_name string, text string")
    firms = spark.createDataFrame([("known firm",)], "name string")
    got = sorted((r.id, r.name, r.known) for r in text_backers(rows, firms).collect())
    assert got == [
        (1, "Lux Capital", False), (1, "Sequoia Capital", False), (2, "Index Ventures", False), (2, "Thrive Capital", False), (2, "alpha ventures", False),
        (3, "Bessemer Venture Partners", False), (4, "Founders Fund", False), (4, "Investment from Founders Fund", False), (4, "Known Firm", True), (4, "with funding from Known Firm", False), (5, "Accel Labs", False)]


def test_backers_equal_brute_force(spark):
    def plain(text):
        out = set()
        for p in ("led\\s+by", "backed\\s+by", "participation\\s+from", "investors\\s+include", "Series\\s+[A-Z]\\d?\\s+from", "raised\\s+\\$[\\d,.]+[MBK]?\\s+from", "\\$[\\d,.]+[MBK]?\\s+from", "(?:funding|investment)\\s+from"):
            for m in re.finditer(p + r"\s+([A-Z][^.!?\n]{2,80})", text or "", re.I):
                for part in re.split(r"\s*(?:,\s*and\s+|,\s*|\s+and\s+|\s*&\s*)\s*", re.split("[.!?;]", m[1])[0].strip()):
                    words = []
                    for w in part.split():
                        words.append(w)
                        if w.lower().rstrip(".,;") in ("capital", "ventures", "partners", "management", "advisors", "group", "fund", "invest", "investments", "equity", "holdings", "labs", "studio", "studios", "accelerator") or len(words) == 5:
                            break
                    name = " ".join(words).strip(",").strip(".")
                    if 3 <= len(name) <= 60 and not re.match("(a|the|an) ", name, re.I):
                        out.add(name)
        return out

    rows = spark.createDataFrame([(i, x) for i, (_, x) in TEXTS.items()], "id long, text string")
    got = {(r.id, r.name) for r in investor_candidates(rows).collect()}
    assert got == {(i, n) for i, (_, x) in TEXTS.items() for n in plain(x)}
