"""Web pages as a table of nodes: a row for each element and each piece of text, made in one Arrow pass."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from html import unescape
from html.parser import HTMLParser
from itertools import islice

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Elements without an end, and elements whose text is not the page's own.
VOID = frozenset(("area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"))
ASIDE = frozenset(("nav", "footer", "aside", "header"))
#: An element's own copy of its text ends after about so many characters; pieces of text are kept whole.
SHOWN = 600
#: Between the pieces of an element's text.
GAP = "\x1f"
#: Nodes that are handed back to the JVM together.
SLICE = 5000
ARROW = {
    "page_id": pa.int64(), "url": pa.string(), "node": pa.int32(), "last": pa.int32(), "parent": pa.int32(), "parent_last": pa.int32(), "tag": pa.string(),
    "classes": pa.list_(pa.string()), "kind": pa.string(), "link": pa.string(), "stamp": pa.string(), "text": pa.string(), "aside": pa.bool_()}
NODE = (
    "page_id long, url string, node int, last int, parent int, parent_last int, tag string, classes array<string>, kind string, link string, stamp string, text string, aside boolean")


#: Pages of plain tags and texts are cut by one pattern; what could be read otherwise (comments, scripts, odd
#: attributes, texts with a "<", titles with tags) is left to the parser. Both give the same events.
_TAG = r"""<(/?)([a-zA-Z][a-zA-Z0-9]*)((?:[ \n]+[a-zA-Z][a-zA-Z-]*=(?:"[^"<>&]*"|'[^'<>&]*'))*)>"""
_EVENT = re.compile(rf"{_TAG}|([^<]+)")
_PLAIN = re.compile(rf"(?:{_TAG.replace('(/?)', '/?').replace('([a-z', '(?:[a-z').replace('((?:[ ', '(?:(?:[ ')}|[^<]++)*+")
_ODD = re.compile(r"(?i)<(?:script|style|textarea|xmp|iframe|noembed|noframes|noscript|plaintext)|<title[^>]|<title>[^<]*+(?!</title>)|</[a-z0-9]+[^>a-z0-9]")
_ATTRIBUTE = re.compile(r"""([a-zA-Z-]+)=(?:"([^"]*)"|'([^']*)')""")


class _Events(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.found: list[tuple] = []

    def updatepos(self, i, j):
        return j  # no lines are counted

    def handle_starttag(self, tag, attrs):
        self.found.append(("", tag, attrs, ""))

    def handle_endtag(self, tag):
        self.found.append(("/", tag, (), ""))

    def handle_data(self, data):
        self.found.append(("", "", (), data))


def events(html: str) -> list[tuple]:
    """A page's tags and texts in order: "/" of an end tag, its name, attributes (pairs, or as written), or a text."""
    if _PLAIN.fullmatch(html) and not _ODD.search(html):
        return [(end, tag.lower(), attrs, unescape(text) if "&" in text else text) for end, tag, attrs, text in _EVENT.findall(html)]
    parser = _Events()
    parser.feed(html)
    parser.close()
    return parser.found


def attributes(attrs) -> dict:
    return {name.lower(): one or two for name, one, two in _ATTRIBUTE.findall(attrs)} if isinstance(attrs, str) else dict(attrs)


class _Reader:
    """Collects the nodes of one page in the order of the source; elements end as their end tags say."""

    def __init__(self):
        self.rows, self.stack = [], []

    def read(self, html: str) -> list[dict]:
        for end, tag, attrs, text in events(html):
            if not tag:
                self.handle_data(text)
            elif end:
                self.handle_endtag(tag)
            else:
                self.handle_starttag(tag, attributes(attrs))
        for row in self.stack:
            row["last"] = len(self.rows) - 1
        return self.rows

    def add(self, tag: str, attrs: dict, text: list[str]) -> dict:
        above = self.stack[-1] if self.stack else None
        row = {
            "node": len(self.rows), "last": len(self.rows), "above": above, "tag": tag, "classes": (attrs.get("class") or "").split(), "kind": attrs.get("type"),
            "link": attrs.get("href"), "stamp": attrs.get("datetime"), "text": text, "size": 0, "aside": tag in ASIDE or above is not None and above["aside"]}
        self.rows.append(row)
        return row

    def handle_starttag(self, tag, attrs):
        row = self.add(tag, attrs, [])
        if tag not in VOID:
            self.stack.append(row)

    def handle_endtag(self, tag):
        if any(x["tag"] == tag for x in self.stack):
            while True:
                row = self.stack.pop()
                row["last"] = len(self.rows) - 1
                if row["tag"] == tag:
                    return

    def handle_data(self, data):
        if self.stack and self.stack[-1]["tag"] in ("script", "style"):
            if self.stack[-1]["kind"] == "application/ld+json":
                self.stack[-1]["text"].append(data)
            return
        piece = " ".join(data.split())
        if piece:
            self.add("#text", {}, [piece])
            for row in self.stack:
                if row["size"] < SHOWN:
                    row["text"].append(piece[: SHOWN - row["size"]])
                    row["size"] += len(piece)


def page_nodes(pages: DataFrame, *more: str) -> DataFrame:
    """Nodes of ``pages`` (``page_id`` of its own, ``url``, ``html``), and the columns ``more`` on each of them.

    ``node`` counts from the page's start, ``last`` is the last node within; ``text`` of an element are its pieces with
    ``GAP`` between, of a script of linked data its content. White space is one blank. ``link``, ``stamp`` and ``kind``
    are the attributes href, datetime and type. Null pages have no nodes. A page is read as a whole by one worker.
    """
    kinds = dict(pages.select(*more).dtypes) if more else {}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                page = {x: batch.column(x)[i].as_py() for x in batch.schema.names}
                found = _Reader().read(page["html"] or "")
                for at in range(0, len(found), SLICE):
                    part = found[at : at + SLICE]
                    above = [row["above"] for row in part]
                    given = {"page_id": [page["page_id"]] * len(part), "url": [page["url"]] * len(part), "parent": [x and x["node"] for x in above], "parent_last": [x and x["last"] for x in above], "text": [GAP.join(row["text"]) for row in part]}
                    columns = [pa.array(given[x] if x in given else [row[x] for row in part], kind) for x, kind in ARROW.items()]
                    columns += [pa.array([page[x]] * len(part), batch.schema.field(x).type) for x in more]
                    yield pa.RecordBatch.from_arrays(columns, [*ARROW, *more])

    return pages.select(F.col("page_id").cast("long"), "url", "html", *more).mapInArrow(run, ", ".join([NODE, *[f"{x} {kinds[x]}" for x in more]]))


def _closed(stack: list[tuple], tag: str) -> list[tuple]:
    """The open elements that an end tag ends, taken off ``stack``: those down to the last of its name, if there is one."""
    for k in range(len(stack) - 1, -1, -1):
        if stack[k][0] == tag:
            gone = stack[k:]
            del stack[k:]
            return gone
    return []


def _piece(stack: list[tuple], text: str) -> str:
    return "" if stack and stack[-1][0] in ("script", "style") else " ".join(text.split())


def _sections(html: str, heads: tuple[str, ...], ends: tuple[str, ...]) -> list[tuple]:
    stack: list[tuple] = []  # open elements by tag, with the section that they head
    found, head, stamp = [], None, None
    for end, tag, attrs, text in events(html):
        if not tag:
            if piece := _piece(stack, text):
                for _, own in stack:
                    if own is not None and own["size"] < SHOWN:
                        own["head"] += piece[: SHOWN - own["size"]]
                        own["size"] += len(piece)
                if head is not None and not head["open"]:
                    head["pieces"].append(piece)
        elif end:
            for _, own in _closed(stack, tag):
                if own is not None:
                    own["open"] = False
        else:
            own = None
            if tag in heads or tag in ends:
                own = head = {"tag": tag, "head": "", "size": 0, "open": tag not in VOID, "pieces": []}
                found.append(own)
            elif tag == "time" and stamp is None:
                stamp = attributes(attrs).get("datetime")
            if tag not in VOID:
                stack.append((tag, own))
    return [(stamp, i, x["head"], GAP.join(x["pieces"])) for i, x in enumerate(found) if x["tag"] in heads]


def _main_text(html: str) -> list[tuple]:
    stack: list[tuple] = []  # open elements: tag, whether aside, and its extent among the texts
    texts, title, firsts = [], None, {}
    for end, tag, attrs, text in events(html):
        if not tag:
            if piece := _piece(stack, text):
                texts.append((piece, bool(stack) and stack[-1][1]))
                for open_, _, own in stack:
                    if open_ == "title" and own is title and own["size"] < SHOWN:
                        own["text"] += piece[: SHOWN - own["size"]]
                        own["size"] += len(piece)
        elif end:
            for *_, own in _closed(stack, tag):
                own["to"] = len(texts)
        else:
            aside = tag in ASIDE or bool(stack) and stack[-1][1]
            own = {"from": len(texts), "to": None, "text": "", "size": 0}
            if tag == "title" and title is None:
                title = own
            if tag in ("article", "main", "body"):
                firsts.setdefault((tag, aside), own)
            if tag not in VOID:
                stack.append((tag, aside, own))
    tries = (("article", False), ("main", False), ("body", False), ("body", True))
    part = next((firsts[x] for x in tries if x in firsts), None)
    inside = [] if part is None else texts[part["from"] : part["to"]]
    return [(None if title is None else title["text"], GAP.join(piece for piece, aside in inside if not aside))]


def _read_pages(pages: DataFrame, read: Callable[[str], list[tuple]], columns: dict[str, pa.DataType], kinds: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                rows = [(i, url, *x) for i, url, html in zip(*(c.to_pylist() for c in batch.slice(at, 256).columns)) for x in read(html or "")]
                found = list(zip(*rows)) or [[]] * (2 + len(columns))
                types = {"page_id": pa.int64(), "url": pa.string(), **columns}
                yield pa.RecordBatch.from_arrays([pa.array(x, kind) for x, kind in zip(found, types.values())], list(types))

    return pages.select(F.col("page_id").cast("long"), "url", "html").mapInArrow(run, f"page_id long, url string, {kinds}")


def page_sections(pages: DataFrame, heads: tuple[str, ...], ends: tuple[str, ...] = ()) -> DataFrame:
    """A row for each element of ``heads``: ``page_id``, ``url``, ``stamp``, ``section``, ``head``, ``text``.

    ``head`` is the element's own text, ``text`` the pieces that follow on it up to the next of ``heads`` or ``ends``,
    with ``GAP`` between, ``section`` its place, ``stamp`` the page's first datetime of a time element.
    """
    columns = {"stamp": pa.string(), "section": pa.int32(), "head": pa.string(), "text": pa.string()}
    return _read_pages(pages, lambda html: _sections(html, heads, ends), columns, "stamp string, section int, head string, text string")


def page_texts(pages: DataFrame) -> DataFrame:
    """``page_id``, ``url``, ``title``, ``body`` of each page.

    ``body`` has the pieces, with ``GAP`` between, of the first article, else main part, else body, without those in
    menus, headers, footers and asides; it is empty where there is no such element.
    """
    return _read_pages(pages, _main_text, {"title": pa.string(), "body": pa.string()}, "title string, body string")


class Element:
    """An element while a page is read: its place, the places of the boxes that it is in, and its text if it is kept."""

    __slots__ = ("tag", "classes", "link", "node", "open", "boxes", "heads", "pieces", "room")

    def __init__(self, tag: str, attrs: dict, node: int):
        named = attrs.get("class")
        self.tag, self.classes, self.link, self.node, self.open = tag, named.split() if named else [], attrs.get("href"), node, tag not in VOID
        self.heads = self.pieces = None


@dataclass
class Card:
    """Elements of a tag that pass a test, and what is read of each: fields of first elements that pass theirs.

    Tests are given the element, the card and the page's row; each goes with the tags that it is for, or None. A field
    is of the first of its tests that an element passed: its text with ``GAP`` between pieces, or its link. Cards within
    others of their kind are part of these; ``links`` are rows of their own wherever they stand, with their text up to
    ``SHOWN`` characters as ``name``, one of a name for each page. ``within`` names the kind of card that one must be in.
    Cards without fields are no rows.
    """

    tags: tuple[str, ...] | None
    test: Callable
    fields: dict[str, tuple[tuple[tuple[str, ...] | None, Callable], ...]]
    links: bool = False
    within: int | None = None
    by_tag: dict = field(default_factory=dict)

    def tests(self, tag: str) -> list[tuple]:
        """The tests for a tag, with field and place among the field's tests."""
        if tag not in self.by_tag:
            self.by_tag[tag] = [((name, i), test) for name, tests in self.fields.items() for i, (tags, test) in enumerate(tests) if tags is None or tag in tags]
        return self.by_tag[tag]


def _cards(page: dict, kinds: dict[int, Card], boxes: dict[str, tuple]) -> list[tuple]:
    """Of each card of a page: kind, element, and the elements found for its fields, by field and place of the test."""
    node, stack, found, keeping = 0, [], [], []  # nodes so far, open elements, cards, elements whose text is kept
    current, inside = {}, {}  # open cards by kind, places of the open boxes
    of_tag: dict[str, tuple] = {}
    for end, tag, attrs, text in events(page["html"] or ""):
        if not tag:
            if piece := _piece(stack, text):
                node, full = node + 1, False
                for x in keeping:
                    if x.room is None:
                        x.pieces.append(piece)
                    else:
                        x.pieces.append(piece[: x.room])
                        x.room -= len(piece)
                        full |= x.room <= 0
                if full:
                    keeping = [x for x in keeping if x.room is None or x.room > 0]
        elif end:
            for _, x in _closed(stack, tag):
                x.open = False
                if x.pieces is not None and (x.room is None or x.room > 0):
                    keeping.remove(x)
                for k in x.heads or ():
                    del current[k]
                if x.node in inside.values():
                    inside = {name: at for name, at in inside.items() if at != x.node}
        else:
            x = Element(tag, attributes(attrs) if attrs else {}, node)
            node += 1
            if x.open:
                stack.append((tag, x))
            if tag not in of_tag:
                of_tag[tag] = [(name, test) for name, (tags, test) in boxes.items() if tag in tags], [(k, kind) for k, kind in kinds.items() if kind.tags is None or tag in kind.tags]
            for name, test in of_tag[tag][0]:
                if test(x):
                    inside = inside | {name: x.node}
            x.boxes = inside
            for k, kind in of_tag[tag][1]:
                if kind.links:
                    if (kind.within is None or kind.within in current) and kind.test(x, None, page):
                        found.append((k, x, {}))
                        _keep(x, keeping, SHOWN)
                elif k not in current and kind.test(x, None, page):
                    found.append((k, x, {}))
                    current[k] = found[-1]
                    x.heads = [*(x.heads or ()), k]
            for k, first, values in current.values():
                for place, test in kinds[k].tests(tag):
                    if place not in values and test(x, first, page):
                        values[place] = x
                        if place[0] not in LINKS:
                            _keep(x, keeping, None)
            if not x.open:
                for k in x.heads or ():
                    del current[k]
                if x.node in inside.values():
                    inside = {name: at for name, at in inside.items() if at != x.node}
    return found


def _keep(x: Element, keeping: list[Element], room: int | None) -> None:
    if x.pieces is None:
        x.pieces, x.room = [], room
        if x.open:
            keeping.append(x)
    elif room is None:
        x.room = None


#: Fields of cards that are links, not texts.
LINKS = ("link",)


def page_cards(pages: DataFrame, kinds: dict[str | None, dict[int, Card]], by: str | None = None, boxes: dict[str, tuple] | None = None, first: tuple[int, ...] = (), least: int = 1, more: tuple[str, ...] = ()) -> DataFrame:
    """A row for each card of ``pages``: ``page_id``, ``url``, ``more``, ``card_kind``, ``card`` and the fields of all kinds.

    ``kinds`` are those for the pages whose column ``by`` has a value, or for all pages. Of the kinds ``first`` only those
    of the first with ``least`` cards count. ``boxes`` are tests of elements of some tags; an element knows the last box that began
    before it or with it, if it is in it. Pages are read in one pass, each by one worker.
    """
    names = sorted({name for group in kinds.values() for kind in group.values() for name in (("name", "link") if kind.links else kind.fields)})
    types = {"page_id": pa.int64(), "url": pa.string()}
    own = {"card_kind": pa.int32(), "card": pa.int32()} | dict.fromkeys(names, pa.string())

    def rows(page: dict) -> Iterator[tuple]:
        group = kinds.get(page[by] if by else None, {})
        found, told = _cards(page, group, boxes or {}), set()
        counts = Counter(k for k, _, _ in found)
        one = next((k for k in first if counts[k] >= least), None)
        for k, x, values in found:
            if k in first and k != one or not group[k].links and not group[k].fields:
                continue
            if group[k].links:
                name = "".join(x.pieces)
                if (k, name) in told:
                    continue
                told.add((k, name))
                got = {"name": name, "link": x.link}
            else:
                got = {}
                for name, tests in group[k].fields.items():
                    of = next((values[name, i] for i in range(len(tests)) if (name, i) in values), None)
                    got[name] = None if of is None else of.link if name in LINKS else GAP.join(of.pieces)
            yield (page["page_id"], page["url"], *(page[x] for x in more), k, x.node, *(got.get(x) for x in names))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            schema = types | {x: batch.schema.field(x).type for x in more} | own
            made = (row for at in range(batch.num_rows) for row in rows(batch.slice(at, 1).to_pylist()[0]))
            while part := list(islice(made, SLICE)):
                yield pa.RecordBatch.from_arrays([pa.array(x, kind) for x, kind in zip(zip(*part), schema.values())], list(schema))

    read = pages.select(F.col("page_id").cast("long"), "url", "html", *dict.fromkeys([*more, *([by] if by else [])]))
    given = dict(read.dtypes)
    return read.mapInArrow(run, ", ".join(["page_id long", "url string", *[f"{x} {given[x]}" for x in more], "card_kind int", "card int", *[f"{x} string" for x in names]]))


def glued(c: Column | str = "text") -> Column:
    return F.replace(F.col(c) if isinstance(c, str) else c, F.lit(GAP), F.lit(""))


def spaced(c: Column | str = "text") -> Column:
    return F.replace(F.col(c) if isinstance(c, str) else c, F.lit(GAP), F.lit(" "))


def of_class(*names: str, tag: str | None = None) -> Column:
    """Elements with each of the classes."""
    test = F.lit(True) if tag is None else F.col("tag") == tag
    for name in names:
        test &= F.array_contains("classes", name)
    return test


def class_says(part: str, tag: str | None = None) -> Column:
    """Elements whose classes have ``part`` somewhere in them."""
    test = F.array_join("classes", " ").contains(part)
    return test if tag is None else test & (F.col("tag") == tag)


def _upto(offset: int) -> Window:
    return Window.partitionBy("page_id").orderBy("node").rowsBetween(Window.unboundedPreceding, offset)


def boxed(nodes: DataFrame, **tests: Column) -> DataFrame:
    """Columns ``node_x`` for each test x: the last element before or at a node that passes and that the node is in."""
    for name, test in tests.items():
        box = F.last(F.when(test, F.struct("node", "last")), ignorenulls=True).over(_upto(0))
        nodes = nodes.withColumn(f"node_{name}", F.when(F.col("node") <= box["last"], box["node"]))
    return nodes


def cards(nodes: DataFrame, kinds: dict[int, Column], ends: dict[int, str] | None = None) -> DataFrame:
    """Nodes of the elements that pass a test, once for each ``card_kind`` with the element's node as ``card``.

    Elements within others of their kind are part of these. ``ends`` names kinds that go up to another column than
    ``last``, or to the next of the kind. Groups are found by windows over a page's nodes, not by pairing nodes.
    """
    ends = ends or {}
    rows = nodes
    for k, test in kinds.items():
        within = F.lit(-1) if k in ends else F.coalesce(F.max(F.when(test, F.col("last"))).over(_upto(-1)), F.lit(-1))
        rows = rows.withColumn(f"__{k}", F.when(test & (F.col("node") > within), F.struct("node", F.coalesce(F.col(ends.get(k, "last")), F.lit(2**31 - 1)).alias("last"))))
    found = []
    for k in kinds:
        box = F.last(f"__{k}", ignorenulls=True).over(_upto(0))
        found.append(F.when(F.col("node") <= box["last"], F.struct(F.lit(k).alias("card_kind"), box["node"].alias("card"))))
    rows = rows.withColumn("__in", F.array_compact(F.array(*found))).where(F.size("__in") > 0)
    return rows.select(*nodes.columns, F.explode("__in").alias("x")).select(*nodes.columns, "x.card_kind", "x.card")


def first_kind(rows: DataFrame, least: int = 1) -> DataFrame:
    """Of each page the cards of the first kind that has ``least`` of them."""
    n = F.sum((F.col("node") == F.col("card")).cast("int")).over(Window.partitionBy("page_id", "card_kind"))
    rows = rows.withColumn("__n", n)
    rows = rows.withColumn("__k", F.min(F.when(F.col("__n") >= least, F.col("card_kind"))).over(Window.partitionBy("page_id")))
    return rows.where("card_kind = __k").drop("__n", "__k")


def first_of_card(value: Column, test: Column) -> Column:
    """Aggregate: ``value`` of the card's first node that passes."""
    return F.min_by(value, F.when(test, F.col("node")))
