"""Reports: golden pages of both kinds."""

import datetime

from quarry.operators.reports import read_daily_reports, read_roundups


def frame(spark, *pages):
    return spark.createDataFrame([(i, url, body) for i, (url, body) in enumerate(pages)], "page_id long, url string, html string")


def test_daily_reports(spark):
    body = (
        "<html><head><title>Report 2/3/2024</title></head><body><article><h1>News</h1><p>Acme Robotics, an AI maker of arms, has raised $5.5M in Series A funding. The round was led by Lux Capital."
        " Money from investors that include Index, Thrive and Jane Doe. Founded by Ann Lee and Bo Ek in 2019, it has raised a total of $9M.</p>"
        "<p>Beta, a bank, has raised 2 billion in Seed funding.</p><p>Gamma, a tool, is closing.</p><p>Zed has raised $750K in pre-seed funding from nobody</p></article></body></html>")
    got = [tuple(r)[1:] for r in read_daily_reports(frame(spark, ("https://x/r", body))).orderBy("amount_usd").collect()]
    day = datetime.date(2024, 2, 3)
    assert got == [
        (day, "Zed", None, 750e3, "Pre-Seed", None, [], None, None, None, "https://x/r"),
        (day, "Acme Robotics", "AI maker of arms", 5.5e6, "Series A", "Lux Capital", ["Lux Capital", "Index", "Thrive", "Jane Doe"], "Ann Lee and Bo Ek", 2019, 9e6, "https://x/r"),
        (day, "Beta", "bank", 2e9, "Seed", None, [], None, None, None, "https://x/r")]


def test_days_of_reports(spark):
    deal = "<body><p>Acme, a shop, has raised $5M in seed funding.</p></body>"
    got = read_daily_reports(frame(spark, ("https://x/report-12-31-2023", deal), ("https://x/2022/07/p", deal), ("https://x/", deal), ("https://x/", None), ("https://x/", ""))).collect()
    assert {r.page_id: str(r.date_announced) for r in got} == {0: "2023-12-31", 1: "2022-07-01", 2: "None"}


def test_roundups(spark):
    body = (
        "<h2>Intro</h2><p>Round: no deal</p><h3>12. Acme Robotics $20.5M</h3><p>Total equity funding raised: $30M</p><p>Founders: Ann Lee,<br>Bo Ek</p><p>ROUND: Series B – $20.5M</p>"
        "<p>Description: makes robot arms</p><p>for plants &amp; farms</p><p>Investors in the round: led by Lux Capital with participation from Index and Thrive</p><p>Founded: 2018</p>"
        "<h2>11. Beta</h2><p>It took $750K.</p><p>Founding year: unknown</p><hr><p>Round: of an advert</p><h2>Not a deal</h2><p>Round: Seed</p><h2>10. Gamma 5M</h2>")
    got = [(r.company_name, r.description, r.amount_usd, r.round_type, r.stage, r.lead, r.investors, r.founders, r.founded, r.total_raised, str(r.date_announced)) for r in read_roundups(frame(spark, ("https://x/2024/02/top", body))).orderBy("amount_usd").collect()]
    assert got == [
        ("Beta", None, 750e3, "Unknown", "Unknown", None, [], None, None, None, "2024-02-29"), ("Gamma", None, 5e6, "Unknown", "Unknown", None, [], None, None, None, "2024-02-29"),
        ("Acme Robotics", "makes robot arms for plants & farms", 20.5e6, "Series B", "Series B", "Lux Capital", ["Lux Capital", "Index", "Thrive"], "Ann Lee, Bo Ek", 2018, 30e6, "2024-02-29")]
    stamped = read_roundups(frame(spark, ("https://x/2024/02/top", "<time datetime='2024-02-10T08:00'>x</time>" + body))).select("date_announced").distinct().collect()
    assert [str(r[0]) for r in stamped] == ["2024-02-10"] and read_roundups(frame(spark, ("u", None), ("u", ""))).count() == 0
