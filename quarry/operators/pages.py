"""What web pages list: portfolios, people, news, article texts and listings, by grouping a page's nodes."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.functions import rules as R
from quarry.operators.gates import valid_portfolio_name
from quarry.plans.registry import query
from quarry.sources.markup import GAP, Card, boxed, cards, class_says, first_kind, first_of_card, glued, of_class, page_cards, page_nodes, page_texts, spaced
from quarry.sources.staging import written
from quarry.sources.tables import Tables

# Sites of which a link is no company's, names of filters, longest description.
PLATFORMS = (
    "twitter.com", "linkedin.com", "facebook.com", "instagram.com", "youtube.com", "github.com", "medium.com", "crunchbase.com",
    "google.com", "apple.com/app", "play.google.com")
FILTER_NAMES = ("yearfilter", "filter", "all")
DESCRIPTION = 200
# Elements of which each is a company, in the order in which they are tried.
COMPANY_CARDS = (("div", "portfolio-company"), ("div", "company-card"), ("article", "portfolio"), ("div", "portfolio-item"), ("li", "portfolio-item"))
LEAST_CARDS = 3
# Elements of which each is a person, by tag and part of the class, in the order in which they are tried.
PERSON_CARDS = (
    ("div", "team-member"), ("div", "team_member"), ("div", "person"), ("li", "team"), ("div", "member"), ("article", "team"), ("div", "staff"), ("div", "bio"),
    ("div", "leader"), ("div", "partner"))
LEAST_PEOPLE = 2
# Texts in headings that are no names, titles that stand where names do, titles of investing people, and
# titles of others. Short ones count as words, others wherever they stand.
NO_NAMES = (
    "portfolio", "team", "about", "contact", "investment", "our ", "meet ", "what we", "how we", "we invest", "values", "our focus", "our blog", "startups",
    "our model", "our network", "founder catalyst", "startup weekend", "program tracks", "no results", "privacy", "connect")
BARE_TITLES = ("Managing Partner", "Vice President", "Partner", "General Partner", "Principal", "Associate")
INVESTING = (
    "partner", "managing director", "principal", "vice president", "vp", "analyst", "associate", "venture partner", "general partner", "founding partner",
    "managing partner", "investment director", "director", "managing member", "co-founder", "cofounder", "founder")
NOT_INVESTING = (
    "office manager", "executive assistant", "administrative", "receptionist", "marketing manager", "marketing coordinator", "marketing associate",
    "marketing director", "communications", "human resources", "hr", "accounting", "legal counsel", "legal assistant", "it manager", "it director", "it support",
    "graphic design", "event")
WHOLE_WORDS = ("vp", "associate", "hr")
# Words of news about investments.
NEWS_WORDS = ("invest", "fund", "raise", "round", "seed", "series", "pre-seed", "announce", "back", "lead", "capital", "million", "closes", "secures")
HEADINGS = ("h2", "h3", "h4")
PERSON = r"^[A-Z][a-z]+(?:\s+[A-Z][a-z]+){1,3}$"


def _host(url: str = "url") -> Column:
    return F.coalesce(F.try_parse_url(url, F.lit("HOST")), F.lit(""))


def _absolute(link: Column, url: str = "url") -> Column:
    root = F.concat(F.try_parse_url(url, F.lit("PROTOCOL")), F.lit("://"), _host(url))
    return F.when(link.startswith("/") & ~link.startswith("//"), F.concat(root, link)).otherwise(link)


def _says(c: Column, listed: tuple[str, ...]) -> Column:
    """Whether a text holds one of ``listed``; those of ``WHOLE_WORDS`` as words."""
    low = F.lower(c)
    words = F.split(low, r"[^a-z0-9]+")
    parts = [x for x in listed if x not in WHOLE_WORDS]
    own = [x for x in listed if x in WHOLE_WORDS]
    hit = F.exists(F.array(*map(F.lit, parts)), lambda x: F.contains(F.regexp_replace(low, r"\s+", " "), x))
    return F.coalesce(hit | F.arrays_overlap(words, F.array(*map(F.lit, own))) if own else hit, F.lit(False))


def _has(name: str) -> Callable:
    return lambda x, *_: name in x.classes


def _told(part: str) -> Callable:
    return lambda x, *_: part in " ".join(x.classes)


def _any(x, *_) -> bool:
    return True


def _leads(x, card, page: dict) -> bool:
    """Whether a link leads to another site."""
    return x.link is not None and x.link.startswith("http") and not (page["host"] and page["host"] in x.link)


def read_portfolios(pages: DataFrame, most: int | None = None, parts: int | None = None) -> DataFrame:
    """``page_id``, ``layout``, ``place``, ``company_name``, ``company_website`` and ``description`` of listed companies.

    Layouts are tried in order: rows of links (1), cards with a container (2), wraps with a title (3), at least three
    company cards with a heading (4), and links to other sites (5); the first that gives a company is the page's. Names
    that are no company's are dropped, as are links to the page's own site and to platforms where only links tell.
    ``most`` keeps the first so many of a page. Many pages list the same companies, so each name is judged once; rows
    are shuffled into ``parts`` partitions, if given.
    """
    apart = lambda rows, key: rows if parts is None else rows.repartition(parts, key)
    heads, linked, http = (HEADINGS, _any), (("a",), lambda x, *_: x.link is not None), (("a",), lambda x, *_: (x.link or "").startswith("http"))
    kinds = {
        0: Card(("div",), lambda x, *_: "m__list-row" in x.classes and "m__list-row--mobile" not in x.classes, {}),
        1: Card(("a",), _leads, {}, links=True, within=0),
        2: Card(("div",), _has("portfolio-card"), {
            "name": ((("h2", "h3", "h4", "p", "span", "div"), lambda x, card, page: x.node > x.boxes.get("container", x.node) > card.node),), "link": (http,), "about": ((("div",), _has("portfolio-card__accordion")),)}),
        3: Card(("div",), _has("portfolio-wrap"), {
            "name": ((("div",), lambda x, card, page: "h3" in x.classes and x.boxes.get("title", -1) > card.node), (("div",), _has("h3")), (("h3",), _any)),
            "about": ((("div",), _has("short-desc")), (("div",), _has("text-14px")))})}
    kinds |= {4 + i: Card((tag,), _has(name), {"name": (heads, (("a",), _any)), "link": (linked,), "about": ((("p",), _any),)}) for i, (tag, name) in enumerate(COMPANY_CARDS)}
    last = 4 + len(COMPANY_CARDS)
    kinds[last] = Card(("a",), lambda x, card, page: _leads(x, card, page) and not any(site in x.link for site in PLATFORMS), {}, links=True)
    boxes = {"container": (("div",), _has("container")), "title": (("div",), _has("portfolio-title"))}
    c = page_cards(pages.withColumn("host", _host()), {None: kinds}, boxes=boxes, first=tuple(range(4, last)), least=LEAST_CARDS, more=("host",))
    kind, link, name = F.col("card_kind"), F.col("link"), glued("name")
    layout = F.when(kind == last, 5).when(kind >= 4, 4).otherwise(kind)
    inner = F.coalesce(F.contains(link, F.col("host")) & (F.col("host") != ""), F.lit(False))
    site = F.when(kind.isin(1, last) | (kind == 2) & ~inner, link).when(kind >= 4, _absolute(link))
    about = F.substring(glued("about"), 1, DESCRIPTION)
    about = F.when((kind == 3) & F.endswith(about, F.lit("Read more.")), F.rtrim(F.left(about, F.char_length(about) - 10))).otherwise(about)
    shaped = name.rlike(r"^\p{Lu}") | (name.contains(" ") & ~name.startswith("#"))
    c = c.where(F.when(kind == 2, ~F.lower(name).isin(*FILTER_NAMES)).when(kind == last, shaped).otherwise(True))
    rows = written(c.select("page_id", layout.alias("layout"), F.col("card").alias("place"), name.alias("company_name"), site.alias("company_website"), about.alias("description")), "listed")
    # written before and after they are judged, or the rule would move to where each row is read
    names = written(apart(rows.select("company_name").distinct(), "company_name"), "names")
    names = written(names.where(valid_portfolio_name(F.col("company_name"))), "companies")
    rows = apart(rows, "company_name").join(apart(names, "company_name").hint("shuffle_hash"), "company_name", "left_semi")
    rows = apart(rows, "page_id").withColumn("__first", F.min("layout").over(Window.partitionBy("page_id"))).where("layout = __first")
    if most is not None:
        rows = rows.withColumn("__n", F.row_number().over(Window.partitionBy("page_id").orderBy("place"))).where(F.col("__n") <= most)
    return rows.select("page_id", "layout", "place", "company_name", "company_website", "description")


#: Companies on a rendered page.
PAGE = 40


def _paged(rows: DataFrame, key: Column, order: str, html: Column, before: Column, url: Column, size: int = PAGE, parts: int | None = None) -> DataFrame:
    """Pages of ``size`` rows of a key: ``page_id`` from key and number, ``url`` and ``html``, the rows in order."""
    # numbered before they are rendered, so that the sort carries columns and not html
    rows = rows.withColumn("__k", key).withColumn("__p", F.floor((F.row_number().over(Window.partitionBy("__k").orderBy(order)) - 1) / size))
    rows = rows.select(F.col("__k").alias("k"), F.col("__p").alias("p"), F.col(order).alias("o"), html.alias("h"), before.alias("b"), url.alias("url"))
    pages = rows.groupBy("k", "p").agg(F.first("url").alias("url"), F.first("b").alias("b"), F.sort_array(F.collect_list(F.struct("o", "h"))).alias("x"))
    body = F.array_join(F.transform("x", lambda r: r["h"]), "\n")
    pages = pages.select((F.col("k") * 100000 + F.col("p")).alias("page_id"), "url", F.concat(F.lit("<html><head><title>t</title></head><body>"), "b", body, F.lit("</body></html>")).alias("html"))
    return pages.repartition(parts or int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), "page_id")  # small pages, much work


def portfolio_pages(t: Tables) -> DataFrame:
    """Portfolios as pages of firms in five layouts, with links and buttons that are no companies."""
    firm, name = F.col("firm_id"), F.col("company_name")
    cust = (F.col("id") - firm * 10000000).cast("string")
    site, about = F.concat(F.lit("https://www.c"), cust, F.lit(".example.org")), F.concat("sector", F.lit(" company &amp; more"))
    own = F.concat(F.lit("https://firm"), firm.cast("string"), F.lit(".example.com"))
    text = lambda *parts: F.concat(*[F.lit(x) if isinstance(x, str) else x for x in parts])
    forms = (
        text("<div class='m__list-row x'><a href='", site, "'>", name, "</a><a href='", own, "/story'>Our Story</a><a href='", site, "'>Learn More</a></div><div class='m__list-row m__list-row--mobile'><a href='https://m.example.org'>Mobile Twin</a></div>"),
        text("<div class='portfolio-card'><a href='/in'>in</a><div class='container wide'><h3> ", name, " </h3><p>", "sector", "</p></div><a href='", F.when(F.col("id") % 4 == 0, own).otherwise(site), "'>Visit Website</a><div class='portfolio-card__accordion'>", about, "</div></div>"),
        text("<div class='portfolio-wrap'><div class='h3'>Series A</div><div class='portfolio-title'><div class='h3'>", name, "</div></div><div class='short-desc'>", about, " Read more.</div></div>"),
        text("<li class='portfolio-item'><a href='/company/", cust, "'><h4>", name, "</h4></a><p>", about, "</p><p>second</p></li>"),
        text("<p><a href='", site, "'>", name, "</a> <a href='https://twitter.com/x'>Twitter Page</a> <a href='", own, "/x'>Our Name</a> <a href='", site, "'>", name, "</a><a href='https://a.example.org'>View all</a></p>"))
    html = forms[-1]
    for i, form in enumerate(forms[:-1]):
        html = F.when(firm % 5 == i, form).otherwise(html)
    return _paged(t.portfolio, firm, "id", html, F.lit("<nav><a href='/'>Home</a></nav>"), text(own, "/portfolio"), parts=t.parts)


@query("portfolio_from_html", f"""
with p as (
  select *, firm_id % 5 + 1 as layout, id - firm_id * 10000000 as cust, (row_number() over (partition by firm_id order by id) - 1) // {PAGE} as n from portfolio),
q as (select *, firm_id * 100000 + n as page_id, count(*) over (partition by firm_id, n) as size from p)
select page_id, cast(layout as integer) as layout, company_name,
  case layout when 1 then 'https://www.c' || cust || '.example.org' when 2 then case when id % 4 <> 0 then 'https://www.c' || cust || '.example.org' end
    when 4 then 'https://firm' || firm_id || '.example.com/company/' || cust when 5 then 'https://www.c' || cust || '.example.org' end as company_website,
  case when layout in (2, 3, 4) then sector || ' company & more' end as description
from q where layout <> 4 or size >= {LEAST_CARDS}""")
def portfolio_from_html(t: Tables) -> DataFrame:
    """The portfolios read back from firms' pages in five layouts."""
    return read_portfolios(portfolio_pages(t), parts=t.parts).drop("place")


def linked_data(nodes: DataFrame) -> DataFrame:
    """``page_id``, ``value`` of every object in the pages' linked data, however deep in arrays and objects.

    Scripts become variants; each round opens arrays and objects of the last, until nothing is left to open.
    """
    rows = nodes.where("tag = 'script' and kind = 'application/ld+json'").select("page_id", F.try_parse_json("text").alias("value")).where("value is not null")
    spark, found = nodes.sparkSession, None
    while True:
        rows = written(rows, "linked_data")
        objects = rows.where(F.schema_of_variant("value").startswith("OBJECT"))
        found = objects if found is None else found.unionByName(objects)
        inner = rows.lateralJoin(spark.tvf.variant_explode(F.col("value").outer()).select(F.col("value").alias("inner"))).select("page_id", F.col("inner").alias("value"))
        rows = inner.where(F.schema_of_variant("value").rlike("^(OBJECT|ARRAY)"))
        if rows.isEmpty():
            return found


def _people_of_data(nodes: DataFrame) -> DataFrame:
    rows = linked_data(nodes)
    get = lambda path, kind="string": F.try_variant_get("value", f"$.{path}", kind)
    types = F.coalesce(F.try_variant_get("value", "$['@type']", "array<string>"), F.array(F.try_variant_get("value", "$['@type']", "string")))
    same = F.coalesce(get("sameAs", "array<string>"), F.array(get("sameAs")))
    rows = rows.where(F.array_contains(types, "Person")).select(
        "page_id", F.trim(get("name")).alias("name"), F.nullif(F.trim(get("jobTitle")), F.lit("")).alias("title"), F.get(F.filter(same, lambda x: F.contains(x, F.lit("linkedin.com/in/"))), F.lit(0)).alias("linkedin_url"))
    return rows.where("name <> ''")


def read_people(pages: DataFrame) -> DataFrame:
    """``page_id``, ``name``, ``title``, ``linkedin_url``: people of linked data, else of repeated cards, else of headings.

    Cards are tried by class in order, two at least; without any, each heading that is shaped like a name begins one.
    People whose title is none of investing are dropped. The same person twice on a page is one row.
    """
    n = written(page_nodes(pages).where("tag <> '#text'"), "nodes")
    tag, link = F.col("tag"), F.col("link")
    told = written(_people_of_data(n), "people")
    rest = n.join(told.select("page_id").distinct().hint("merge"), "page_id", "left_anti")
    kinds = {i: class_says(part, t) for i, (t, part) in enumerate(PERSON_CARDS, 1)}
    last = len(PERSON_CARDS) + 1
    c = cards(rest, kinds | {last: tag.isin(*HEADINGS) & glued().rlike(PERSON)}, {last: "parent_last"})
    size = F.sum((F.col("node") == F.col("card")).cast("int")).over(Window.partitionBy("page_id", "card_kind"))
    # one person's heading is enough, where no class tells
    c = first_kind(c.withColumn("__size", size).where((F.col("__size") >= LEAST_PEOPLE) | (F.col("card_kind") == last)).drop("__size"))
    name = F.coalesce(first_of_card(glued(), tag.isin(*HEADINGS)), first_of_card(glued(), tag.isin("strong", "b")))
    texts = F.sort_array(F.collect_list(F.when(tag.isin("p", "span", "div", "h5", "h6") & (F.col("node") > F.col("card")) & _says(glued(), INVESTING), F.struct("node", glued().alias("text")))))
    people = c.groupBy("page_id", "card").agg(name.alias("name"), texts.alias("texts"), first_of_card(link, (tag == "a") & F.contains(link, F.lit("linkedin.com/in/"))).alias("linkedin_url"))
    no_name = F.exists(F.array(*map(F.lit, NO_NAMES)), lambda x: F.contains(F.lower("name"), x))
    people = people.where(F.char_length("name").between(3, 60) & ~F.col("name").rlike(r"\d") & ~no_name & ~F.col("name").isin(*BARE_TITLES))
    title = F.get(F.filter("texts", lambda x: x["text"] != F.col("name")), F.lit(0))["text"]
    people = people.withColumn("title", title)
    title = F.trim(F.when(F.startswith("title", F.col("name")), F.expr("substring(title, length(name) + 1)")).otherwise(F.col("title")))
    title = F.trim(F.when(F.endswith(title, F.lit("ExperienceEducation")), F.left(title, F.char_length(title) - 19)).otherwise(title))
    title = F.trim(F.substring_index(title, "Bio & More", 1))
    people = people.select("page_id", "name", F.nullif(title, F.lit("")).alias("title"), "linkedin_url")
    return told.unionByName(people).where(~_says(F.coalesce("title", F.lit("")), NOT_INVESTING)).distinct()


#: Titles given to people of rendered pages, by turns.
RENDERED_TITLES = ("General Partner", "Office Manager", "Associate", "Chef", "HR Lead")


def team_pages(t: Tables) -> DataFrame:
    """People of firms as team pages: linked data as list, in a graph and under an organization, and three kinds of cards."""
    name, id_ = F.initcap("name"), F.col("id").cast("string")
    title = F.element_at(F.array(*map(F.lit, RENDERED_TITLES)), (F.col("id") % 5 + 1).cast("int"))
    url = F.concat(F.lit("https://www.linkedin.com/in/p"), id_)
    text = lambda *parts: F.concat(*[F.lit(x) if isinstance(x, str) else x for x in parts])
    data = text('{"@type":"Person","name":" ', name, ' ","jobTitle":"', title, '","sameAs":["https://example.org","', url, '"]}')
    rows = t.investors.where("firm_id is not null").select("firm_id", "id", name.alias("name"), F.struct(
        data.alias("data"), text("<div class='team-member big'><h3>", name, "</h3><p class='role'>", title, "</p><a href='", url, "'>in</a></div>").alias("card"),
        text("<li class='our-team'><strong>", name, "</strong><span>", title, "</span></li>").alias("item"), text("<section><h3>", name, "</h3><p>", title, "</p></section>").alias("head")).alias("form"))
    pages = rows.groupBy("firm_id").agg(F.array_sort(F.collect_list(F.struct("id", "form"))).alias("x"))
    joined = lambda field, by: F.array_join(F.transform("x", lambda r: r["form"][field]), by)
    script = lambda *parts: text("<script type='application/ld+json'>", *parts, "</script><h2>Jane Doe</h2><p>Partner</p>")
    forms = (
        script("[", joined("data", ","), "]"), script('{"@context":"x","@graph":[{"@type":"WebPage","name":"Team"},', joined("data", ","), "]}"),
        script('{"@type":"Organization","name":"Firm","department":{"@type":"Organization","employee":[', joined("data", ","), "]}}"),
        joined("card", ""), text("<h1>Our Team</h1><ul>", joined("item", ""), "</ul>"), text("<script type='application/ld+json'>{broken</script><h2>Our Team</h2>", joined("head", "")))
    html = forms[-1]
    for i, form in enumerate(forms[:-1]):
        html = F.when(F.col("firm_id") % 6 == i, form).otherwise(html)
    return pages.select(F.col("firm_id").alias("page_id"), F.concat(F.lit("https://firm"), F.col("firm_id").cast("string"), F.lit(".example.com/team")).alias("url"), html.alias("html"))


_TITLE = "case id % 5 " + " ".join(f"when {i} then '{x}'" for i, x in enumerate(RENDERED_TITLES)) + " end"


@query("team_from_html", f"""
with p as (
  select firm_id, id, count(*) over (partition by firm_id) as size, {_TITLE} as title, 'https://www.linkedin.com/in/p' || id as link,
    array_to_string(list_transform(string_split(name, ' '), lambda w: upper(w[1]) || w[2:]), ' ') as name from investors where firm_id is not null)
select distinct firm_id as page_id, name, case when firm_id % 6 < 3 or title in ('General Partner', 'Associate') then title end as title, case when firm_id % 6 < 4 then link end as linkedin_url
from p where (firm_id % 6 < 3 or firm_id % 6 = 5 or size >= {LEAST_PEOPLE}) and (title not in ('Office Manager', 'HR Lead') or firm_id % 6 >= 3)""")
def team_from_html(t: Tables) -> DataFrame:
    """Firms' people read back from linked data of three nestings, cards, list items and headings."""
    return read_people(team_pages(t))


def read_firm_news(pages: DataFrame, most: int | None = None) -> DataFrame:
    """``page_id``, ``title``, ``link``, ``date`` of a page's articles that speak of funding, ``most`` of its first ones."""
    n = written(page_nodes(pages).where("tag <> '#text'"), "nodes")
    tag = F.col("tag")
    c = first_kind(cards(n, {1: tag == "article", 2: class_says("post", "div")}))
    dated = tag.isin("span", "div") & F.array_join("classes", " ").rlike("(?i)date|time")
    rows = c.groupBy("page_id", "url", "card").agg(
        first_of_card(glued(), tag.isin("h1", "h2", "h3", "a")).alias("title"), first_of_card(F.col("link"), (tag == "a") & F.col("link").isNotNull()).alias("link"),
        F.coalesce(first_of_card(F.coalesce("stamp", glued()), tag == "time"), first_of_card(glued(), dated)).alias("date"))
    if most is not None:
        rows = rows.withColumn("n", F.row_number().over(Window.partitionBy("page_id").orderBy("card"))).where(F.col("n") <= most)
    return rows.where(_says(F.col("title"), NEWS_WORDS)).select("page_id", "title", _absolute(F.col("link")).alias("link"), "date")


def news_pages(t: Tables) -> DataFrame:
    """Headlines as news pages of twenty, as articles or, on every other page, as posts; some are no funding news."""
    a = t.articles
    text = lambda *parts: F.concat(*[F.lit(x) if isinstance(x, str) else x for x in parts])
    head = F.when(F.col("id") % 6 == 0, F.concat(F.lit("Office dog of "), F.col("id").cast("string"))).otherwise(F.col("title"))
    day = F.date_format("date_announced", "yyyy-MM-dd")
    inner = text("<h2><a href='/n/", F.col("id").cast("string"), "'>", head, "</a></h2>", F.when(F.col("id") % 4 == 2, text("<time datetime='", F.coalesce(day, F.lit("-")), "'>a while ago</time>")).otherwise(text("<span class='post-Date'>", F.coalesce(day, F.lit("-")), "</span>")))
    page = F.floor(F.col("id") / 20)
    html = F.when(page % 2 == 0, text("<article><p>intro</p>", inner, "</article>")).otherwise(text("<div class='blog-post'>", inner, "<div class='post-end'>.</div></div>"))
    return _paged(a, page, "id", html, F.lit("<h1>Funding news of a firm</h1>"), text("https://firm", page.cast("string"), ".example.com/news"), parts=t.parts)


@query("firm_news_from_html", """
select (id // 20) * 100000 as page_id, title, 'https://firm' || (id // 20) || '.example.com/n/' || id as link, coalesce(strftime(date_announced, '%Y-%m-%d'), '-') as date from articles where id % 6 <> 0""")
def firm_news_from_html(t: Tables) -> DataFrame:
    return read_firm_news(news_pages(t))


def read_bodies(pages: DataFrame, most: int | None = None, between: str = " ") -> DataFrame:
    """``page_id``, ``url``, ``body``, ``title``: the text of the first article, else main part, else body of a page.

    Menus, headers, footers and asides are left out, pieces are joined by ``between``; ``most`` cuts after so many
    characters. Pages without such an element have an empty body.
    """
    body = F.replace("body", F.lit(GAP), F.lit(between))
    return page_texts(pages).select("page_id", "url", (body if most is None else F.left(body, F.lit(most))).alias("body"), "title")


@query("article_text")
def article_text(t: Tables) -> DataFrame:
    return read_bodies(t.raw("pages")).drop("title")


def read_listings(pages: DataFrame) -> DataFrame:
    """``page_id``, ``title``, ``url``, ``description`` of the entries of listing pages, their texts whole.

    ``pages`` has a column ``listing``: rounds (rows of a table, that name a New York place), press (links to releases),
    funded (cards of companies, all of them funded) or tag (articles of a topic). Each has its own elements, of which
    the first kind that a page has counts. All but ``funded`` keep entries that speak of funding.
    """
    forms = {
        "rounds": ((("grid-row",), _any), (("tr",), _told("ng")), (("div",), _told("result")), (("mat-row",), _any), (("a",), lambda x, *_: "/funding_round/" in (x.link or ""))),
        "press": ((("a",), _has("newsreleaseconsolidatelink")), (("a",), lambda x, *_: x.boxes.get("heading", -1) > x.boxes.get("card", x.node)), (("a",), _told("news"))),
        "funded": ((("div",), _told("company-card")), (("div",), _told("company")), (("article",), _any), (("div",), _told("result"))),
        "tag": ((("article",), _any), (("div",), _told("post")), (("div",), _told("article")))}
    no_card = lambda test: lambda x, card, page: x is not card and test(x)
    says = lambda *parts: lambda x, *_: any(part in " ".join(x.classes) for part in parts)
    fields = {
        "all": ((None, lambda x, card, page: x is card),), "link": ((("a",), lambda x, *_: x.link is not None),), "name": ((None, no_card(lambda x: x.tag in HEADINGS or says("name", "title")(x))),),
        "head": ((("h2", "h3"), _any),), "excerpt": ((None, lambda x, card, page: x.tag == "p" or says("excerpt", "summary")(x) and x is not card),)}
    kinds = {listing: {i: Card(tags, test, fields) for i, (tags, test) in enumerate(tests)} for listing, tests in forms.items()}
    boxes = {"card": (("div",), _has("card")), "heading": (("h3",), _any)}
    rows = page_cards(pages, kinds, "listing", boxes, first=tuple(range(max(map(len, forms.values())))), more=("listing",)).withColumnRenamed("url", "page")
    for x in ("name", "head", "excerpt"):
        rows = rows.withColumn(x, glued(x))
    kind, text = F.col("listing"), spaced("all")
    title = F.when(kind == "rounds", text).when(kind == "press", glued("all")).when(kind == "funded", F.concat("name", F.lit(" raises funding"))).otherwise(F.col("head"))
    about = F.when(kind.isin("rounds", "funded"), text).when(kind == "tag", F.coalesce("excerpt", F.lit("")))
    rows = rows.select("page_id", "page", "listing", title.alias("title"), _absolute(F.col("link"), "page").alias("url"), about.alias("description"), text.alias("text"))
    told = R.contains_any(F.lower(F.concat_ws(" ", F.when(kind == "rounds", F.col("text")).otherwise(F.concat_ws(" ", "title", "description")))), R.FUNDING_WORDS)
    near = R.first_of(F.col("text"), {"New York": R.CITY_WORDS["New York"]}, None).isNotNull()
    rows = rows.where((F.coalesce("title", F.lit("")) != "") & ((kind == "funded") | told) & ((kind != "rounds") | near))
    return rows.select("page_id", "title", "url", "description")


def listing_pages(t: Tables) -> DataFrame:
    """Headlines as listing pages of four kinds."""
    text = lambda *parts: F.concat(*[F.lit(x) if isinstance(x, str) else x for x in parts])
    id_, name = F.col("id").cast("string"), F.col("title")
    quiet = F.when(F.col("id") % 6 == 0, F.concat(F.lit("Office dog of New York no. "), id_)).otherwise(name)
    forms = {
        "rounds": text("<tr class='ng-row'><td>", quiet, "</td><td><a href='/r/", id_, "'>more</a></td></tr>"),
        "press": text("<div class='card'><h3><a href='/p/", id_, "'>", quiet, "</a></h3><a class='news' href='/no'>raises nothing</a></div>"),
        "funded": text("<div class='company-card'><span class='co-name'>Co ", id_, "</span><a href='/c/", id_, "'>about</a><div class='company'>x</div></div>"),
        "tag": text("<article><h2>", quiet, "</h2><a href='https://o.example.org/", id_, "'>read</a><p>day ", id_, "</p></article>")}
    page = F.floor(F.col("id") / 20)
    html, kind = None, None
    for i, (listing, form) in enumerate(forms.items()):
        html = F.when(page % 4 == i, form) if html is None else html.when(page % 4 == i, form)
        kind = F.when(F.floor(F.col("page_id") / 100000) % 4 == i, listing) if kind is None else kind.when(F.floor(F.col("page_id") / 100000) % 4 == i, listing)
    return _paged(t.articles, page, "id", html, F.lit("<table>"), F.lit("https://list.example.com/all"), parts=t.parts).withColumn("listing", kind)


@query("listing_cards", """
with a as (select *, id // 20 % 4 as k, case when id % 6 = 0 then 'Office dog of New York no. ' || id else title end as said from articles)
select (id // 20) * 100000 as page_id, case k when 0 then said || ' more' when 2 then 'Co ' || id || ' raises funding' else said end as title,
  case k when 0 then 'https://list.example.com/r/' || id when 1 then 'https://list.example.com/p/' || id when 2 then 'https://list.example.com/c/' || id else 'https://o.example.org/' || id end as url,
  case k when 0 then said || ' more' when 2 then 'Co ' || id || ' about x' when 3 then 'day ' || id end as description
from a where k = 2 or id % 6 <> 0 and (k <> 0 or contains(title, 'New York'))""")
def listing_cards(t: Tables) -> DataFrame:
    return read_listings(listing_pages(t))
