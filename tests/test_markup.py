"""Pages cut by one pattern against the parser, and sections and texts of pages against their nodes."""

import random

from quarry.operators.pages import read_bodies
from quarry.sources.markup import GAP, _Events, _PLAIN, _ODD, attributes, events, page_nodes, page_sections, page_texts

PARTS = (
    "<p>", "</p>", "<div class='a b'>", '<DIV id="x" class="c">', "</div>", "<h2>", "</h2>", "<h3>", "</h3>", "<hr>", "<br>", "<br/>", "<time datetime='2024-02-10'>", "</time>", "<time>", "<title>", "</title>", "<title>t</title>",
    "<article>", "</article>", "<main>", "</main>", "<nav>", "</nav>", "<body>", "</body>", "<script>a<b</script>", "<style>", "</style>", "<!-- c -->", "a &amp; b", "&lt;", "AT&T", "x < y", "<a href=/x>", "<a href='/?a&amp;b'>", "</a>",
    "<img alt>", "1. Acme $5M", "Round: Seed", "Round:", "  more of\x0bit ", "\n", "<", ">", "</ p>", "</p x>", "<é>", "<textarea>", "</textarea>")


def made(seed, n):
    pick = random.Random(seed)
    plain = [x for x in PARTS if _PLAIN.fullmatch(x) and not _ODD.search(x)]
    return ["".join(pick.choices(plain if i % 2 else PARTS, k=pick.randint(0, 25))) for i in range(n)]


def parsed(html):
    parser = _Events()
    parser.feed(html)
    parser.close()
    return [(end, tag, attributes(attrs), text) for end, tag, attrs, text in parser.found]


def test_events_equal_the_parser():
    pages = made(1, 4000)
    assert sum(bool(_PLAIN.fullmatch(x) and not _ODD.search(x)) for x in pages) > 1000
    for page in pages:
        assert [(end, tag, attributes(attrs), text) for end, tag, attrs, text in events(page)] == parsed(page), page


def frame(spark, bodies):
    return spark.createDataFrame([(i, "u", b) for i, b in enumerate(bodies)], "page_id long, url string, html string")


def test_sections_and_texts_equal_nodes(spark):
    bodies = made(2, 400) + [None, "", "<h2>" + "long " * 200 + "</h2>x"]
    pages = frame(spark, bodies)
    sections, texts, stamps = {}, {}, {}
    for i, rows in nodes_of(pages).items():
        head, stamp = None, next((r.stamp for r in rows if r.tag == "time" and r.stamp is not None), None)
        for r in rows:
            if r.tag in ("h2", "h3", "hr"):
                head = r
                if r.tag != "hr":
                    sections[i, r.node] = (stamp, r.text.replace(GAP, ""), [])
            elif r.tag == "#text" and head is not None and r.node > head.last and head.tag != "hr":
                sections[i, head.node][2].append(r.text)
        part = next((r for test in (lambda r: r.tag == "article" and not r.aside, lambda r: r.tag == "main" and not r.aside, lambda r: r.tag == "body" and not r.aside, lambda r: r.tag == "body") for r in rows if test(r)), None)
        title = next((r.text.replace(GAP, "") for r in rows if r.tag == "title"), None)
        texts[i] = (title, GAP.join(r.text for r in rows if part is not None and r.tag == "#text" and not r.aside and part.node <= r.node <= part.last))
    got = page_sections(pages, ("h2", "h3"), ("hr",)).orderBy("page_id", "section").collect()
    assert [(r.page_id, r.stamp, r.head, r.text) for r in got] == [(i, s, h, GAP.join(t)) for (i, _), (s, h, t) in sorted(sections.items())]
    assert len(got) > 200 and {r.page_id: (r.title, r.body) for r in page_texts(pages).collect()} == {i: texts.get(i, (None, "")) for i in range(len(bodies))}
    assert read_bodies(pages).count() == len(bodies)


def nodes_of(pages):
    out = {}
    for r in page_nodes(pages).orderBy("page_id", "node").collect():
        out.setdefault(r.page_id, []).append(r)
    return out
