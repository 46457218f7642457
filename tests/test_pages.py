"""Page operators: golden pages for each layout, and the given pages by brute force."""

import html
import re

import pytest

from quarry.operators import pages as P
from quarry.sources.markup import page_nodes
from quarry.sources.tables import Tables

DATA = "/root/testdata/sf0.001"
URL = "https://www.firm.com/portfolio"


def frame(spark, bodies, url=URL, **more):
    rows = [(i, url, b, *(v[i] for v in more.values())) for i, b in enumerate(bodies)]
    return spark.createDataFrame(rows, ", ".join(["page_id long, url string, html string", *[f"{k} string" for k in more]]))


def companies(spark, *bodies, **how):
    got = P.read_portfolios(frame(spark, bodies), **how).orderBy("page_id", "place").collect()
    return [(r.page_id, r.layout, r.company_name, r.company_website, r.description) for r in got]


def test_nodes(spark):
    got = page_nodes(frame(spark, ["<div class='a b'>x <p>y &amp; z<br>w</div><script>no</script><style>no</style>t", None, "plain"])).orderBy("page_id", "node").collect()
    show = [(r.page_id, r.node, r.last, r.parent, r.tag, r.classes, r.text) for r in got]
    assert show == [
        (0, 0, 5, None, "div", ["a", "b"], "x\x1fy & z\x1fw"), (0, 1, 1, 0, "#text", [], "x"), (0, 2, 5, 0, "p", [], "y & z\x1fw"), (0, 3, 3, 2, "#text", [], "y & z"), (0, 4, 4, 2, "br", [], ""),
        (0, 5, 5, 2, "#text", [], "w"), (0, 6, 6, None, "script", [], ""), (0, 7, 7, None, "style", [], ""), (0, 8, 8, None, "#text", [], "t"), (2, 0, 0, None, "#text", [], "plain")]


def test_portfolio_layouts(spark):
    rows = "<div class='m__list-row'><a href='https://acme.io'>Acme</a><a href='https://www.firm.com/x'>Own Name</a><a href='/in'>Inner Link</a></div>" * 2
    mobile = "<div class='m__list-row m__list-row--mobile'><a href='https://b.io'>Beta Co</a></div>"
    card = "<div class='portfolio-card'><div class='container'><span>Gamma</span><h2>not this</h2></div><a href='/x'>x</a><a href='https://www.firm.com/g'>Visit</a><div class='portfolio-card__accordion'>About<b>gamma</b></div></div>"
    filters = "<div class='portfolio-card'><div class='container'><h3>YearFilter</h3></div></div><div class='portfolio-card'>no container</div>"
    wrap = "<div class='portfolio-wrap'><h3>No</h3><div class='h3'>Nor This</div><div class='portfolio-title'><div class='h3'>Delta</div></div><div class='text-14px'>Makes maps. Read more.</div></div><div class='portfolio-wrap'><h3>Epsilon</h3></div>"
    plain = "".join(f"<article class='portfolio big'><a href='/c/{x}'>{x}</a><p>{x} does</p><p>more</p></article>" for x in ("Eta", "Theta", "Iota"))
    links = "<a href='https://kappa.io'>Kappa</a><a href='https://kappa.io'>Kappa</a><a href='https://l.io'>lower</a><a href='https://m.io'>two words</a><a href='https://github.com/n'>Name Here</a><a href='https://www.firm.com/o'>Omega</a><a href='https://p.io'>View all</a><a href='https://q.io'>2021</a>"
    assert companies(spark, rows + mobile, card + filters, wrap, plain, plain[: plain.index("Theta")], links, "<p>nothing</p>") == [
        (0, 1, "Acme", "https://acme.io", None), (1, 2, "Gamma", None, "Aboutgamma"), (2, 3, "Delta", None, "Makes maps."), (2, 3, "Epsilon", None, None),
        *[(3, 4, x, f"https://www.firm.com/c/{x}", f"{x} does") for x in ("Eta", "Theta", "Iota")], (5, 5, "Kappa", "https://kappa.io", None), (5, 5, "two words", "https://m.io", None)]


def test_first_layout_with_a_company_counts(spark):
    empty = "<div class='m__list-row'><a href='https://x.io'>Learn More</a></div>"
    assert companies(spark, empty + "<a href='https://acme.io'>Acme</a>") == [(0, 5, "Acme", "https://acme.io", None)]
    many = "".join(f"<a href='https://x.io/{i}'>Name {i} Co</a>" for i in range(9))
    assert len(companies(spark, many)) == 9 and [x[2] for x in companies(spark, many, most=2)] == ["Name 0 Co", "Name 1 Co"]


def test_given_pages_list_no_other_sites(spark):
    pages = Tables(spark, DATA).raw("pages")
    assert not [r for r in pages.collect() if re.search(r"<a[^>]*href=[\"']?http", r.html or "")] and P.read_portfolios(pages).count() == 0


def people(spark, *bodies):
    return sorted((r.page_id, r.name, r.title, r.linkedin_url) for r in P.read_people(frame(spark, bodies)).collect())


def test_people_of_linked_data(spark):
    ld = "<script type='application/ld+json'>%s</script>"
    one = '{"@type":["Person","Thing"],"name":"Ann Lee","jobTitle":"Partner","sameAs":"https://linkedin.com/in/ann"}'
    two = '{"@type":"Person","name":" Bo Ek ","jobTitle":"","sameAs":["https://x.com/b","https://linkedin.com/in/bo"],"knows":{"@type":"Person","name":"Cy Day","jobTitle":"HR Manager"}}'
    bodies = [ld % one, ld % f"[{one},[{two}]]", ld % f'{{"@graph":[{{"a":{{"b":[{two}]}}}}]}}', ld % "{broken" + "<h2>Dee Fox</h2><p>Partner</p>", ld % '{"@type":"Person","name":" "}' + ld % one]
    assert people(spark, *bodies) == [
        (0, "Ann Lee", "Partner", "https://linkedin.com/in/ann"), (1, "Ann Lee", "Partner", "https://linkedin.com/in/ann"), (1, "Bo Ek", None, "https://linkedin.com/in/bo"),
        (2, "Bo Ek", None, "https://linkedin.com/in/bo"), (3, "Dee Fox", "Partner", None), (4, "Ann Lee", "Partner", "https://linkedin.com/in/ann")]


def test_people_of_cards(spark):
    cards = "<div class='x team-member'><h4>Ann Lee</h4><p>Ann LeeManaging Partner</p><div class='team-member'><a href='https://www.linkedin.com/in/ann'>in</a></div></div>"
    cards += "<div class='team-member'><b>Bo Ek</b><span>likes cats</span><span>PrincipalExperienceEducation</span></div><div class='team-member'><h3>Our Team</h3></div><div class='team-member'><h3>Partner</h3></div><div class='team-member'><h3>Agent 7</h3></div>"
    one = "<div class='team-member'><h2>Cy Day</h2><p>Founder</p></div>"
    heads = "<main><h2>Dee Fox</h2><p>Principal</p><h2>Not a Name Here At All</h2><h3>Eve Gray</h3><div>Office Manager</div><h3>Flo Hill</h3></main><p>Analyst</p>"
    got = people(spark, cards, one, heads)
    assert got == [(0, "Ann Lee", "Managing Partner", "https://www.linkedin.com/in/ann"), (0, "Bo Ek", "Principal", None), (1, "Cy Day", "Founder", None), (2, "Dee Fox", "Principal", None), (2, "Eve Gray", None, None), (2, "Flo Hill", None, None)]


def test_firm_news(spark):
    body = "<article><p>x</p><a href='/n/1'>Acme raises money</a><time datetime='2024-01-02'>then</time></article><article><h2>Cats</h2></article><article><h3>Fund II</h3><span class='postDate'>May</span></article>"
    posts = "<div class='post'><h1>Seed news</h1><div class='post-x'><h2>Round two</h2></div></div>"
    got = [tuple(r) for r in P.read_firm_news(frame(spark, [body, posts, ""])).orderBy("page_id", "title").collect()]
    assert got == [(0, "Acme raises money", "https://www.firm.com/n/1", "2024-01-02"), (0, "Fund II", None, "May"), (1, "Seed news", None, None)]
    assert P.read_firm_news(frame(spark, [body]), most=1).count() == 1


def test_bodies(spark):
    bodies = ["<body><nav>menu</nav><main>main <article>first <footer>foot</footer><b>b</b></article><article>second</article></main></body>", "<body>x<main>only <aside>no</aside>main</main></body>", "<body><header>h</header>whole &amp; all</body>", "no body", "", None]
    got = {r.page_id: r.body for r in P.read_bodies(frame(spark, bodies)).collect()}
    assert got == {0: "first b", 1: "only main", 2: "whole & all", 3: "", 4: "", 5: ""}
    assert {r.body for r in P.read_bodies(frame(spark, bodies[:1]), most=3).collect()} == {"fir"}


def test_bodies_of_the_given_pages(spark):
    """Each has one article; its text is what is left without tags, scripts and asides."""
    t = Tables(spark, DATA)
    want = {}
    for r in t.raw("pages").collect():
        part = re.search(r"<article.*?(?=</article>)", r.html, re.S)[0]
        part = re.sub(r"<(script|style|nav|footer|aside|header)\b.*?</\1>|<!--.*?-->", " ", part, flags=re.S)
        want[r.page_id] = " ".join(" ".join(html.unescape(x).split()) for x in re.split(r"<[^>]*>", part) if html.unescape(x).strip())
    got = {r.page_id: r.body for r in P.article_text(t).collect()}
    same = sum(got[i].replace(" ", "") == want[i].replace(" ", "") for i in want)
    assert got.keys() == want.keys() and same == len(want), [(i, got[i][-200:], want[i][-200:]) for i in want if got[i].replace(" ", "") != want[i].replace(" ", "")][:2]


@pytest.mark.parametrize("listing, body, want", [
    ("rounds", "<div class='result'>x</div><grid-row>Acme raises $5M in <b>Brooklyn</b><a href='/r'>r</a></grid-row><grid-row>Beta raises, Boston</grid-row>", [("Acme raises $5M in Brooklyn r", "https://www.firm.com/r", "Acme raises $5M in Brooklyn r")]),
    ("rounds", "<p><a href='/funding_round/7'>Zed closes seed, NYC</a></p>", [("Zed closes seed, NYC", "https://www.firm.com/funding_round/7", "Zed closes seed, NYC")]),
    ("press", "<a class='newsreleaseconsolidatelink big' href='https://p.io/1'>Acme funding</a><div class='card'><h3><a href='/2'>Beta round</a></h3></div>", [("Acme funding", "https://p.io/1", None)]),
    ("press", "<div class='card'><h3><a href='/2'>Beta round</a></h3><a href='/3'>Seed</a></div><a class='news' href='/4'>Series</a>", [("Beta round", "https://www.firm.com/2", None)]),
    ("funded", "<div class='company-card'><div class='co-title'>Acme</div><a href='/a'>go</a></div><div class='company-card'><p>no name</p></div>", [("Acme raises funding", "https://www.firm.com/a", "Acme go")]),
    ("tag", "<div class='article'><h3>No</h3></div><div class='post'><h3>Acme</h3><a href='/t'>t</a><p>closes a round</p></div><div class='post'><h2>Cats</h2></div>", [("Acme", "https://www.firm.com/t", "closes a round")]),
])
def test_listings(spark, listing, body, want):
    got = P.read_listings(frame(spark, [body], listing=[listing])).collect()
    assert [(r.title, r.url, r.description) for r in got] == want


def test_pieces_of_text_are_not_kept_where_elements_tell(spark, monkeypatch):
    from quarry.operators import pages as module

    kept, write = [], module.written
    monkeypatch.setattr(module, "written", lambda df, name: kept.append((name, write(df, name))) or kept[-1][1])
    one = spark.createDataFrame([(1, "https://a.example.com", "<article><h2><a href='/n'>Acme raises $5M</a></h2></article>")], "page_id long, url string, html string")
    assert [r.title for r in module.read_firm_news(one).collect()] == ["Acme raises $5M"]
    assert {r.tag for name, df in kept if name == "nodes" for r in df.collect()} == {"article", "h2", "a"}
