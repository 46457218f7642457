"""Cards of pages in one pass: against nodes and windows, entries read to their end, and names judged once."""

import random

import pytest
from pyspark.sql import functions as F

from quarry.operators import pages as P
from quarry.sources.markup import SHOWN, Card, boxed, cards, first_kind, first_of_card, glued, of_class, page_cards, page_nodes

LONG = "word " * 300
URL = "https://www.firm.com/portfolio"


@pytest.mark.parametrize("listing, body, title, about", [
    ("rounds", f"<div><table><tr class='ng-row'><td>{LONG}</td><td>Acme <b>raises</b> $5M in Brooklyn</td></tr></table></div>", LONG + "Acme raises $5M in Brooklyn", LONG + "Acme raises $5M in Brooklyn"),
    ("press", f"<a class='news' href='/1'>{LONG}funding</a>", LONG + "funding", None),
    ("funded", f"<div class='company-card'><b class='name'>{LONG}</b><p>{LONG}<i>end</i></p></div>", LONG + "raises funding", LONG + LONG + "end"),
    ("tag", f"<article><h2>{LONG}</h2><p>{LONG}closes a round</p></article>", LONG.strip(), LONG + "closes a round"),
])
def test_long_entries_are_read_to_their_end(spark, listing, body, title, about):
    pages = spark.createDataFrame([(1, URL, body, listing)], "page_id long, url string, html string, listing string")
    assert [(r.title, r.description) for r in P.read_listings(pages).collect()] == [(title, about)]


def made(seed, n):
    pick = random.Random(seed)
    parts = ("<div class='post'>", "<div class='post box'>", "<div class='box'>", "</div>", "</div>", "<article>", "</article>", "<h2>", "</h2>", "<a href='/x'>", "<a>", "</a>", "<br class='post'>", "a", "b c", "d &amp; e", "<script>f</script>")
    return ["".join(pick.choices(parts, k=pick.randint(0, 25))) for _ in range(n)] + [None, ""]


def test_cards_equal_nodes_and_windows(spark):
    pages = spark.createDataFrame(list(enumerate(made(3, 1500))), "page_id long, html string").withColumn("url", F.lit("u"))
    n = boxed(page_nodes(pages).where("tag <> '#text'"), box=of_class("box", tag="div"))
    tag, of = F.col("tag"), ("page_id", "card_kind", "card")
    boxed_link = (tag == "a") & (F.col("node_box") > F.col("card"))
    rows = first_kind(cards(n, {1: tag == "article", 2: of_class("post")}), 2)
    rows = rows.groupBy(*of).agg(F.coalesce(first_of_card(glued(), boxed_link), first_of_card(glued(), tag == "h2")).alias("name"), first_of_card(F.col("link"), (tag == "a") & F.col("link").isNotNull()).alias("link"))
    anything = lambda *_: True
    fields = {"name": ((("a",), lambda x, card, page: x.boxes.get("box", -1) > card.node), (("h2",), anything)), "link": ((("a",), lambda x, *_: x.link is not None),)}
    kinds = {1: Card(("article",), anything, fields), 2: Card(None, lambda x, *_: "post" in x.classes, fields)}
    got = page_cards(pages, {None: kinds}, boxes={"box": (("div",), lambda x: "box" in x.classes)}, first=(1, 2), least=2)
    got = sorted((*(r[x] for x in of), r.name and r.name.replace("\x1f", ""), r.link) for r in got.collect())
    assert [str(x) for x in got] == [str(tuple(r[x] for x in (*of, "name", "link"))) for r in rows.orderBy(*of).collect()] and len(got) > 500


def test_links_that_are_never_closed_keep_little(spark):
    pages = spark.createDataFrame([(1, URL, "<a href='https://x.io'>all " + "".join(f"<a href='https://x.io/{i}'>name {i} " for i in range(3000)))], "page_id long, url string, html string")
    got = page_cards(pages, {None: {1: Card(("a",), lambda *_: True, {}, links=True)}}).collect()
    assert len(got) == 3001 and max(len(r.name) for r in got) <= SHOWN


def test_names_are_judged_once_and_nodes_not_written(spark, monkeypatch):
    kept, write = [], P.written
    monkeypatch.setattr(P, "written", lambda df, name: kept.append((name, write(df, name))) or kept[-1][1])
    body = "<a href='https://acme.io'>Acme</a><a href='https://b.io'>Beta Co</a><a href='https://c.io'>View all</a>"
    pages = spark.createDataFrame([(i, URL, body) for i in range(30)], "page_id long, url string, html string")
    assert P.read_portfolios(pages, parts=3).count() == 60
    judged = {name: df.count() for name, df in kept}
    assert "nodes" not in judged and judged["names"] == 3 and judged["companies"] == 2
