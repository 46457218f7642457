"""Operator 10: main text of web pages by wrappers inferred from pages of the same host.

A page is read as a stream of tags and texts with every element closed where HTML closes it. The streams of a host are
aligned one after another into a wrapper, a regular expression without unions (Crescenzi et al., "RoadRunner", 2001):
elements meet by their place, the chain of tags and class words above them. What some streams lack becomes optional,
what one stream has several times in a row becomes a repeated group, elements that take turns become a repeated group
of optional ones, texts that differ become slots and texts that never do stay constants. Alignment adds and compares
place by place, so tasks align their own pages and an aggregation aligns the tasks' wrappers; nothing is cut off, and
a host of any size costs a task only its wrapper. Pages with an ``article`` or ``main`` and pages without are two
templates of a host and have a wrapper each.

The wrappers choose the text. Where pages have articles the wrapper's article groups with slots hold it, and article
groups that are the same on every page are furniture; elsewhere whatever has slots does, without groups made of links
and constants. Both need ``EVIDENCE`` pages. Menus, navigation, footers, sidebars, forms, scripts and styles go by
their element, adverts, notices and reader comments by the last word of a class name; words that may mean anything
(``related``, ``search``) only tell where the wrapper shows links or constants.

Defined cases: null and empty pages give an empty text; null urls are one host; repeated rows give equal rows; very
long pages are read in one pass with memory in proportion to the page; levels below ``DEPTH`` share one place. Other
columns than ``page_id``, ``url`` and ``html`` are not looked at, so their names cannot clash. Character references are
decoded, blanks within a block become one space, blocks follow one another on lines of their own.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm.common import SLICE_BYTES, partitions, staged, table

#: Pages of one template from which on a text that never changes counts as part of the template.
EVIDENCE = 3
#: Levels of nesting with places of their own.
DEPTH = 64
#: Items that a task aligns before it hands its wrappers on.
HELD = 100_000
#: Share of a group's characters in links from which on a loose word is believed; the share and the links in it from
#: which on a group is a menu by itself.
LINKED, MENU, LINKS = 0.5, 0.8, 3

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|<(script|style|noscript|template|textarea|title|iframe|svg|object|select|button)\b[^>]*>.*?(?:</\1\s*>|\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|\Z)",
    re.S | re.I,
)
_ATTRIBUTE = re.compile(r"([^\s=/\"'<>]+)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+))?")
_TELLING = re.compile(r"class|id|role|hidden", re.I)
_LETTERS = re.compile(r"[a-z]+")

# Names of elements, as HTML defines them.
_BLOCKS = frozenset("address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary table tbody tfoot thead tr ul".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_LEFT_OUT = frozenset("nav footer aside form menu dialog".split())
_CELLS = frozenset(("td", "th"))
_TREE = _BLOCKS | _CELLS
_ENDS_P = _BLOCKS - frozenset("body caption html legend tbody tfoot thead tr".split())
_SECTIONS = frozenset("article aside body footer form header html main nav section table".split())
_ROOTS = frozenset(("article", "main"))
#: Elements that an opening tag ends where their end tags are left away, and the elements that hide them from it.
_ENDS = {
    "li": (frozenset(("li",)), frozenset(("ul", "ol", "menu"))),
    "dt": (frozenset(("dt", "dd")), frozenset(("dl",))),
    "dd": (frozenset(("dt", "dd")), frozenset(("dl",))),
    "tr": (frozenset(("tr",)), frozenset(("table",))),
    "td": (_CELLS, frozenset(("tr", "table"))),
    "th": (_CELLS, frozenset(("tr", "table"))),
    "thead": (frozenset(("thead", "tbody", "tfoot")), frozenset(("table",))),
    "tbody": (frozenset(("thead", "tbody", "tfoot")), frozenset(("table",))),
    "tfoot": (frozenset(("thead", "tbody", "tfoot")), frozenset(("table",))),
}
_P_WALLS = frozenset("body button caption html table td th".split())

# Words of class names, ids of containers and roles. What they call furniture: the last word decides, after words for
# shapes are taken off; the loose ones are only believed with the wrapper's evidence.
_FURNITURE = frozenset("ad ads advert adverts advertisement advertising sponsored promo banner sidebar menu nav navbar navigation breadcrumb breadcrumbs footer comment comments disqus replies cookie cookies consent notice notices gdpr popup modal newsletter toolbar pagination complementary contentinfo".split())
_LOOSE = frozenset("related recommended search share sharing signup social sponsor subscribe widget".split())
_SHAPES = frozenset("area bar block bottom box container content inner item items left link links list panel region right section slot text top unit wrap wrapper zone".split())
_STATES = frozenset("has hide is no not show with without".split())
_LAYOUT = frozenset("banner footer menu nav navbar navigation sidebar toolbar".split())
_TOPS = frozenset("header masthead topbar".split())
_SITES = frozenset("global main page site top".split())
_CONTAINERS = frozenset("div dl ol section table ul".split())


@lru_cache(maxsize=1 << 14)
def _marks(name: str, attributes: str) -> tuple[str, str, bool]:
    """First class word; hint: ``out``, ``top`` (a page's header), ``loose`` or nothing; whether hidden."""
    first, hint, hidden = "", "", False
    for attribute, value in _ATTRIBUTE.findall(attributes):
        attribute, value = attribute.lower(), value.strip("\"'")
        if attribute == "hidden":
            hidden = True
        elif attribute in ("class", "role") or attribute == "id" and name in _CONTAINERS:
            for token in value.split():
                words = _LETTERS.findall(re.sub(r"([a-z])([A-Z])", r"\1 \2", token).lower())
                if attribute == "class" and words and not first:
                    first = "".join(words)[:32]
                if not words or words[0] in _STATES:
                    continue
                head = next((w for w in reversed(words) if w not in _SHAPES), words[-1])
                if head in _FURNITURE and not (name in _ROOTS and head in _LAYOUT):
                    hint = "out"
                elif not hint and head in _TOPS and set(words) <= {head} | _SITES | _SHAPES:
                    hint = "top"
                elif not hint and _LOOSE & set(words):
                    hint = "loose"
    return first, hint, hidden


@lru_cache(maxsize=1 << 16)
def place(parent: int, key: str) -> int:
    """Number of the item ``key`` below the item ``parent`` of a wrapper; zero is the page."""
    digest = xxhash.xxh64_intdigest(b"%d %s" % (parent, key.encode()))
    return digest - (1 << 64) if digest >= 1 << 63 else digest


OPEN, CLOSE, TEXT, BREAK = range(4)


def walk(page: str, out: frozenset[int] = frozenset()) -> Iterator[tuple]:
    """A page's stream, elements closed where HTML closes them, without what is ``out`` or left out by its element.

    (OPEN, item, name, parent, key, hint), (CLOSE, name), (TEXT, text, linked) and (BREAK, blank).
    """
    stack: list[tuple] = [("", 0, False, True, 0)]  # name, item, an item of its own, block, level
    open_: dict[str, int] = {}
    dead = links = roots = at = 0

    def close(i: int) -> Iterator[tuple]:
        nonlocal dead, links, roots
        while len(stack) > i:
            name, _, own, _, _ = stack.pop()
            open_[name] -= 1
            if dead:
                if len(stack) < dead:
                    dead = 0
                continue
            links -= name == "a"
            roots -= name in _ROOTS
            if own:
                yield CLOSE, name

    def reach(names: frozenset, walls: frozenset) -> int:
        for i in range(len(stack) - 1, 0, -1):
            if stack[i][0] in names:
                return i
            if stack[i][0] in walls:
                break
        return 0

    for found in _TOKEN.finditer(page):
        if found.start() > at and not dead:
            yield TEXT, page[at : found.start()], links > 0
        at = found.end()
        if not found[3]:
            continue
        name = found[3].lower()
        block = name in _TREE
        if found[2]:
            if open_.get(name):
                through = name in _SECTIONS
                for i in range(len(stack) - 1, 0, -1):
                    above = stack[i]
                    if above[0] == name:
                        yield from close(i)
                        break
                    if above[3] and not block or not through and (above[0] in _ROOTS or above[0] in _CELLS):
                        break
            if not dead:
                if name in _BLOCKS:
                    yield BREAK, ""
                elif name == "br":
                    yield BREAK, " "
            continue
        if block:
            if name in _ENDS_P and open_.get("p") and (i := reach(frozenset(("p",)), _P_WALLS)):
                yield from close(i)
            if name in _ENDS and (i := reach(*_ENDS[name])):
                yield from close(i)
        if name in _VOID:
            if not dead and name in ("br", "hr"):
                yield BREAK, " " if name == "br" else ""
            continue
        parent, level = stack[-1][1], stack[-1][4]
        open_[name] = open_.get(name, 0) + 1
        if dead:
            stack.append((name, parent, False, block, level))
            continue
        attributes = found[4]
        first, hint, hidden = _marks(name, attributes) if _TELLING.search(attributes) else ("", "", False)
        if name in ("html", "body"):
            hint, hidden, first = "", False, ""
        gone = hidden or hint == "out" or name in _LEFT_OUT or not roots and (name == "header" or hint == "top")
        own = block or hint == "loose"
        key = (name + "." + first if first else name) + ("?" if hint == "loose" else "")
        item = place(parent, key) if own and level < DEPTH else parent
        stack.append((name, item, own, block, level + own))
        if gone or own and item in out:
            dead = len(stack)
            if name in _BLOCKS:
                yield BREAK, ""
            continue
        links += name == "a"
        roots += name in _ROOTS
        if own:
            yield OPEN, item, name, parent, key, hint
    if at < len(page) and not dead:
        yield TEXT, page[at:], links > 0
    yield from close(1)


# --- wrappers

_FIELDS = "parent long, key string, root boolean, loose boolean, inside boolean, pages long, times long, chars long, linked long, links long, lo long, hi long, repeated boolean, apart boolean, at double"
ITEM = "host string, marked boolean, item long, " + _FIELDS
_MASK, _STEP = (1 << 63) - 1, 0x9E3779B97F4A7C15


def stream_items(page: str) -> tuple[bool, dict[int, list]]:
    """Whether a page marks its article, and the items of its stream with what is known of each (``_FIELDS``)."""
    out: dict[int, list] = {}
    roots = 0
    marked = False
    # item, parent, key, root, loose, inside, chars, linked, links, hash, own chars, own linked, own hash, kids, last, position
    frames: list[list] = [[0, 0, "", False, False, False, 0, 0, 0, 0, 0, 0, 0, {}, 0, 0]]

    def note(item: int, parent: int, key: str, root: bool, loose: bool, inside: bool, chars: int, linked: int, links: int, digest: int, position: int) -> None:
        known = out.get(item)
        if known is None:
            out[item] = [parent, key, root, loose, inside, 1, 1, chars, linked, links, digest, digest, False, False, float(position)]
            return
        known[6] += 1
        known[7] += chars
        known[8] += linked
        known[9] += links
        known[10], known[11] = min(known[10], digest), max(known[11], digest)

    def leave() -> None:
        item, parent, key, root, loose, inside, chars, linked, links, digest, own, own_linked, own_digest, kids, _, position = frames.pop()
        if own:
            note(place(item, "#"), item, "#", False, False, inside, own, own_linked, 0, own_digest, 0)
        note(item, parent, key, root, loose, inside, chars, linked, links, digest, position)
        for kid, (times, apart) in kids.items():
            known = out[kid]
            known[12], known[13] = known[12] or times > 1, known[13] or apart
        if frames:
            top = frames[-1]
            top[6], top[7], top[8], top[9] = top[6] + chars, top[7] + linked, top[8] + links, (top[9] * _STEP + digest + 1) & _MASK

    before = False
    for event in walk(page):
        if event[0] == TEXT:
            text = " ".join(html.unescape(event[1]).split())
            if text:
                top, n, digest = frames[-1], len(text), xxhash.xxh64_intdigest(text) & _MASK
                top[6], top[9], top[10], top[12] = top[6] + n, (top[9] * _STEP + digest) & _MASK, top[10] + n, (top[12] * _STEP + digest) & _MASK
                if event[2]:
                    top[7], top[11] = top[7] + n, top[11] + n
                    top[8] += not before
            before = event[2]
        elif event[0] == OPEN:
            _, item, name, parent, key, hint = event
            root = name in _ROOTS
            marked |= root
            roots += root
            top, before = frames[-1], False
            if item == parent:  # deeper than DEPTH
                frames.append([item, parent, key, root, False, roots > 0, 0, 0, 0, 0, 0, 0, 0, {}, 0, 0])
                continue
            kids = top[13]
            seen = kids.get(item)
            kids[item] = (1, False) if seen is None else (seen[0] + 1, seen[1] or top[14] != item)
            top[14] = item
            frames.append([item, parent, key, root, hint == "loose", roots > 0, 0, 0, 0, 0, 0, 0, 0, {}, 0, len(kids)])
        elif event[0] == CLOSE:
            roots -= event[1] in _ROOTS
            before = False
            leave()
        else:
            before = False
    leave()
    return marked, out


def align(wrapper: dict[int, list], items: dict[int, list]) -> None:
    """Align another stream's items, or another wrapper, into ``wrapper``, place by place."""
    for item, new in items.items():
        known = wrapper.get(item)
        if known is None:
            wrapper[item] = new
            continue
        for i in (2, 3, 4, 12, 13):
            known[i] = known[i] or new[i]
        for i in (5, 6, 7, 8, 9, 14):
            known[i] += new[i]
        known[10], known[11] = min(known[10], new[10]), max(known[11], new[11])


def wrappers(pages: DataFrame) -> DataFrame:
    """The items of each host's wrappers, from all ``pages`` (``host``, ``html``): ``ITEM`` and what they amount to.

    ``repeated`` and ``apart`` (takes turns with siblings), ``slot`` (texts differ) and ``optional`` describe the
    expression; ``out`` marks what is no text of the page.
    """

    def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[tuple, dict[int, list]] = {}
        for batch in batches:
            for host, page in zip(batch.column(0).to_pylist(), batch.column(1)):
                marked, items = stream_items(page.as_py() or "")
                align(known.setdefault((host, marked), {}), items)
            if sum(map(len, known.values())) > HELD:
                yield from rows(known)
                known = {}
        yield from rows(known)

    types = pa.schema([("host", pa.string()), ("marked", pa.bool_()), ("item", pa.int64()), ("parent", pa.int64()), ("key", pa.string()), *[(c, pa.bool_()) for c in ("root", "loose", "inside")], *[(c, pa.int64()) for c in ("pages", "times", "chars", "linked", "links", "lo", "hi")], ("repeated", pa.bool_()), ("apart", pa.bool_()), ("at", pa.float64())])

    def rows(known: dict) -> Iterator[pa.RecordBatch]:
        flat = [(host, marked, item, *x) for (host, marked), items in known.items() for item, x in items.items()]
        for at in range(0, len(flat), 10_000):
            part = zip(*flat[at : at + 10_000])
            yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(part, types)], schema=types)

    sums = [F.sum(c).alias(c) for c in ("pages", "times", "chars", "linked", "links", "at")]
    flags = [F.max(c).alias(c) for c in ("root", "loose", "inside", "repeated", "apart")]
    items = pages.select("host", "html").mapInArrow(own, ITEM)
    items = staged(items.groupBy("host", "marked", "item").agg(F.any_value("parent").alias("parent"), F.any_value("key").alias("key"), *sums, *flags, F.min("lo").alias("lo"), F.max("hi").alias("hi")), "items")
    slot = F.col("lo") != F.col("hi")
    whole = items.groupBy("host", "marked").agg(
        F.max(F.when(F.col("item") == 0, F.col("pages"))).alias("all_pages"),
        F.max((F.col("key") == "#") & slot & (F.col("inside") | ~F.col("marked"))).alias("slots"),
        F.max(F.col("root") & slot).alias("slot_root"),
        F.max(F.when(F.col("item") == 0, F.col("linked") < MENU * F.col("chars"))).alias("texts"))
    above = items.select("host", "marked", F.col("item").alias("parent"), F.col("pages").alias("above"))
    items = items.join(staged(whole, "templates").hint("merge"), ["host", "marked"]).join(above.hint("merge"), ["host", "marked", "parent"])
    constant = ~slot & (F.col("pages") >= EVIDENCE) & F.col("slots")
    links = (F.col("linked") >= LINKED * F.col("chars")) & (F.col("chars") > 0)
    menu = links & (F.col("linked") >= MENU * F.col("chars")) & (F.col("links") >= LINKS * F.col("times")) & F.col("texts")
    out = (
        F.when(F.col("item") == 0, F.lit(False))
        .when(F.col("loose"), links | constant)
        .when(F.col("root"), ~slot & (F.col("pages") >= EVIDENCE) & F.col("slot_root"))
        .when(F.col("marked"), F.lit(False))
        .otherwise(constant | menu))
    return items.select("host", "marked", "item", "parent", "key", "pages", "all_pages", "root", "repeated", "apart", slot.alias("slot"), (F.col("pages") < F.col("above")).alias("optional"), (F.col("at") / F.col("pages")).alias("at"), out.alias("out"))


def expression(items: list) -> str:
    """A template's wrapper (rows of ``wrappers`` of one host and ``marked``) as a regular expression without unions.

    ``#`` is a slot, ``=`` a constant text; ``?`` and ``+`` are as usual.
    """
    below: dict[int, list] = {}
    for x in sorted(items, key=lambda x: (x["at"], x["key"])):
        if x["item"]:
            below.setdefault(x["parent"], []).append(x)

    def said(item: int) -> str:
        kids, parts = below.get(item, []), []
        turns = [i for i, x in enumerate(kids) if x["apart"]]
        for i, x in enumerate(kids):
            body = ("#" if x["slot"] else "=") if x["key"] == "#" else f"<{x['key']}>{said(x['item'])}</>"
            grouped = turns and turns[0] <= i <= turns[-1]
            count = "?" if grouped else ("*" if x["optional"] else "+") if x["repeated"] else "?" if x["optional"] else ""
            if turns and i == turns[0]:
                parts.append("(")
            parts.append((f"({body})" if count and x["key"] != "#" else body) + count)
            if turns and i == turns[-1]:
                parts.append(")+")
        return "".join(parts)

    return said(0)


# --- extraction


def main_text(page: str | None, out: frozenset[int] = frozenset()) -> str:
    """Blocks of the page that the wrapper leaves, one to a line; only those of articles if there are any.

    A page whose only articles are ones that the wrapper leaves out keeps them.
    """
    rooted, text = _read(page or "", out)
    if out and not rooted:
        every = _read(page or "", frozenset())
        text = every[1] if every[0] else text
    return text


def _read(page: str, out: frozenset[int]) -> tuple[bool, str]:
    blocks: list[str] = []
    words: list[str] = []
    items: list[int] = [0]
    roots = held = 0
    rooted = False

    def flush() -> None:
        if words:
            text = " ".join("".join(words).split())
            if text:
                blocks.append(text)
            words.clear()

    for event in walk(page, out):
        kind = event[0]
        if kind == TEXT:
            if (roots or not rooted) and (rooted or not out or place(items[-1], "#") not in out):
                words.append(html.unescape(event[1]))
        elif kind == BREAK:
            if event[1]:
                words.append(event[1])
            else:
                flush()
        else:
            name = event[1] if kind == CLOSE else event[2]
            if name in _BLOCKS:
                flush()
            elif name in _CELLS:
                words.append(" ")
            if kind == OPEN:
                items.append(event[1])
                if name in _ROOTS:
                    if not rooted:
                        rooted, held = True, len(blocks)
                        del blocks[:held]
                    roots += 1
            else:
                items.pop()
                roots -= name in _ROOTS
    flush()
    return rooted, "\n".join(blocks)


def extract(pages: DataFrame) -> DataFrame:
    """``page_id``, ``url``, ``text`` for every page."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["page_id", "url", "text"]
        for batch in batches:
            texts, size, start = [], 0, 0
            for i, (page, out) in enumerate(zip(batch.column(2), batch.column(3).to_pylist())):
                texts.append(main_text(page.as_py(), frozenset(out or ())))
                size += len(texts[-1])
                if size > SLICE_BYTES or i + 1 == batch.num_rows:
                    part = batch.slice(start, i + 1 - start)
                    yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string())], names)
                    texts, size, start = [], 0, i + 1

    # A host with more than a partition's share of the pages is dealt over several keys. What wrappers leave out is
    # written, so that the join's strategy goes by true sizes: a few kilobytes are broadcast, more is shuffled.
    host = F.lower(F.coalesce(F.regexp_extract("url", r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1), F.lit("")))
    pages = pages.select("page_id", "url", "html", host.alias("host"))
    share = max(1, -(-pages.count() // partitions(pages.sparkSession)))
    hosts = wrappers(pages).groupBy("host").agg(F.collect_list(F.when(F.col("out"), F.col("item"))).alias("out"), F.sum(F.when(F.col("item") == 0, F.col("pages"))).alias("pages"))
    hosts = staged(hosts.where((F.size("out") > 0) | (F.col("pages") > share)).select("host", "out", F.ceil(F.col("pages") / share).cast("int").alias("parts")), "hosts")
    large = hosts.where("parts > 1").select("host", "parts")  # no more hosts than partitions, so safe to broadcast
    part = F.pmod(F.xxhash64("page_id", "url"), F.coalesce("parts", F.lit(1))).cast("int")
    dealt = pages.join(F.broadcast(large), "host", "left").withColumn("part", part).drop("parts")
    known = staged(hosts.where(F.size("out") > 0).select("host", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), "out"), "wrappers")
    joined = dealt.join(known, ["host", "part"], "left")
    return joined.select("page_id", "url", "html", "out").mapInArrow(run, "page_id long, url string, text string")


def op10_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = extract(table(spark, sf_dir, "pages"))
    return found.select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"))
