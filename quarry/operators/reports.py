"""Deals out of reports: daily ones told in sentences, and round-ups with labelled lines under numbered headings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.functions import rules as R
from quarry.operators.extraction import parse_investors
from quarry.operators.pages import _paged, read_bodies
from quarry.plans.registry import query
from quarry.sources.markup import GAP, page_sections
from quarry.sources.staging import written
from quarry.sources.tables import Tables

# Labels of a round-up's lines, each with its other spellings, and the longest description.
LABELS = {
    "round": ("round",), "description": ("description",), "investors": ("investors in the round", "investor in the round"), "industry": ("industry",), "founders": ("founders", "founder"),
    "year": ("founding year", "founded"), "total": ("total equity funding raised",)}
DESCRIPTION = 500
NO_COMPANY = ("the", "this", "our", "we")
#: Where a capitalized name of all its words begins; what follows is looked at first, as few places have it.
TOLD = r"(?=\b[A-Z][A-Za-z0-9]+(?: [A-Z][A-Za-z0-9]+)*, an? )(?<!\b[A-Z][A-Za-z0-9]{0,40} )"
UNITS = {"B": 1e9, "M": 1e6, "K": 1e3}
MONEY = r"\$?([\d,.]+)\s*([MBK]|million|billion)?"


def _amount(number: Column, unit: Column, other: str | None = None) -> Column:
    """Value of "20.5" and "M"; without a unit that of ``other``, if given."""
    unit = F.upper(F.substring(unit, 1, 1))
    unit = unit if other is None else F.coalesce(F.nullif(unit, F.lit("")), F.lit(other))
    scale = F.try_element_at(F.create_map(*[F.lit(x) for pair in UNITS.items() for x in pair]), unit)  # names ``unit`` once
    return F.rtrim(F.replace(number, F.lit(",")), F.lit(".")).try_cast("double") * scale


def _blank(c: Column) -> Column:
    return F.nullif(F.trim(c), F.lit(""))


def read_daily_reports(pages: DataFrame) -> DataFrame:
    """Deals that daily reports tell as "X, a ..., has raised $N in R funding", and what follows on each.

    A report's text is cut where a capitalized name, of all its words, and ", a" or ", an" begin; parts without "has
    raised" are no deals. Where the sentence is not whole, the name is what stands before "has raised".
    ``date_announced`` is the day in the page's title, else in its url, else the first of the url's month. Gives
    ``page_id``, ``date_announced``, ``company_name``, ``description``, ``amount_usd``, ``stage``, ``lead``,
    ``investors``, ``founders``, ``founded``, ``total_raised``, ``source_url``; what is not said is null.
    """
    c = F.col
    bodies = read_bodies(pages, between="\n")
    day = F.regexp_extract_all(F.concat_ws(" ", "title"), F.lit(r"(\d{1,2}/\d{1,2}/\d{4})"), F.lit(1))
    in_url = F.regexp_extract("url", r"report-(\d{1,2}-\d{1,2}-\d{4})", 1)
    dated = F.coalesce(
        F.to_date(F.try_to_timestamp(F.get(day, F.lit(0)), F.lit("M/d/yyyy"))), F.to_date(F.try_to_timestamp(F.nullif(in_url, F.lit("")), F.lit("M-d-yyyy"))),
        F.to_date(F.try_to_timestamp(F.nullif(F.regexp_extract("url", r"/(\d{4}/\d{2})/", 1), F.lit("")), F.lit("yyyy/MM"))))
    parts = bodies.select("page_id", c("url").alias("source_url"), dated.alias("date_announced"), F.posexplode(F.split("body", TOLD)).alias("place", "part"))
    parts = parts.withColumn("part", F.replace("part", F.lit("\n"), F.lit(" "))).where(F.lower("part").contains("has raised"))
    parts = written(parts, "parts")
    raised = rf"has raised {MONEY} in (\w[\w -]*?) funding"
    full, short = rf"(?i)^([^,]+), an? ([^.]+?), {raised}", rf"([A-Z][A-Za-z0-9&' -]*?),? (?i:{raised})"
    # one match gives all five values of a whole sentence
    parts = parts.withColumn("x", F.split(F.regexp_replace("part", rf"{full}(?s:.*)$", GAP.join(f"${i}" for i in range(1, 6))), GAP))
    get = lambda i: F.when(F.size("x") == 5, F.get("x", F.lit(i - 1))).otherwise(F.lit("") if i == 2 else F.regexp_extract("part", short, min(i, 1) if i < 2 else i - 1))
    say = lambda pattern, i=1: _blank(F.regexp_extract("part", f"(?i){pattern}", i))
    rows = parts.select(
        "page_id", "place", "date_announced", "source_url", F.trim(get(1)).alias("company_name"), _blank(F.left(get(2), F.lit(DESCRIPTION))).alias("description"), _amount(get(3), get(4), "M").alias("amount_usd"), get(5).alias("round"),
        say(r"\bled by ([^.]+)").alias("lead"), say(r"\bfrom investors (?:that )?include ([^.]+)").alias("said"), say(r"\bfounded by (.+?) in \d{4}").alias("founders"), say(r"\bfounded by .+? in (\d{4})").try_cast("int").alias("founded"),
        _amount(F.regexp_extract("part", r"(?i)raised a total of \$?([\d,.]+)\s*([MBK])", 1), F.regexp_extract("part", r"(?i)raised a total of \$?([\d,.]+)\s*([MBK])", 2)).alias("total_raised"))
    rows = written(rows.where((F.char_length("company_name") >= 2) & ~F.lower("company_name").isin(*NO_COMPANY)), "told")
    rows = rows.where(R.valid_company_name(c("company_name")))
    names, _ = parse_investors(F.coalesce("said", "lead", F.lit("")))
    rows = rows.withColumn("names", names).withColumn("investors", F.when(c("lead").isNotNull() & ~F.array_contains("names", c("lead")), F.array_prepend("names", c("lead"))).otherwise(c("names")))
    return rows.select("page_id", "date_announced", R.clean_company_name(c("company_name")).alias("company_name"), "description", "amount_usd", R.normalize_stage(c("round")).alias("stage"), "lead", "investors", "founders", "founded", "total_raised", "source_url")


def read_roundups(pages: DataFrame) -> DataFrame:
    """Deals of round-ups: headings "12. Name $20M" with labelled lines up to the next heading or rule.

    Lines are read in order into the label that stands last before them, so labels may come in any order, be missing, or
    run over several lines. ``date_announced`` is the first time stamp of the page, else the last day of the url's month.
    """
    c = F.col
    spelled = "|".join(sorted((x for names in LABELS.values() for x in names), key=len, reverse=True))
    heading = r"^(\d+)\.\s*(.+?)(?:\s+\$?([\d,.]+)\s*([MBK]))?\s*$"
    rows = page_sections(pages, ("h2", "h3"), ("hr",)).where(c("head").rlike(heading))
    # texts from one that begins with a label up to the next such one; what stands before the first is of no label
    told = F.split(F.concat(F.lit(GAP), "text"), rf"{GAP}(?=(?i:{spelled}):)")
    told = F.transform(F.slice(told, F.lit(2), F.size(told)), lambda x: F.struct(F.lower(F.substring_index(x, ":", 1)).alias("label"), F.replace(F.ltrim(F.substr(x, F.instr(x, ":") + 1)), F.lit(GAP), F.lit(" ")).alias("said")))
    rows = rows.select("page_id", c("url").alias("source_url"), "stamp", "head", F.replace("text", F.lit(GAP), F.lit(" ")).alias("block"), told.alias("told"))
    of = lambda names: F.array_join(F.transform(F.filter("told", lambda x: x["label"].isin(*names)), lambda x: x["said"]), " ")
    rows = written(rows.select("page_id", "source_url", "stamp", "head", "block", *[_blank(of(names)).alias(label) for label, names in LABELS.items()]), "sections")
    in_url = F.nullif(F.regexp_extract("source_url", r"/(\d{4}/\d{2})/", 1), F.lit(""))
    day = F.coalesce(F.left("stamp", F.lit(10)).try_cast("date"), F.last_day(F.to_date(F.try_to_timestamp(in_url, F.lit("yyyy/MM")))))
    get = lambda i: F.regexp_extract("head", heading, i)
    first = lambda i: F.regexp_extract(F.coalesce("block", F.lit("")), r"(?i)\$?([\d,.]*\d)\s*(M|B|K|million)\b", i)
    names, lead = parse_investors(F.coalesce(c("investors"), F.lit("")))
    kind = _blank(F.regexp_replace(F.coalesce(c("round"), F.lit("")), r"\s*[–-]\s*\$[\d,.]+[MBK]?", ""))
    total = r"(?i)^\$?([\d,.]+)\s*([MBK])"
    return rows.select(
        "page_id", day.alias("date_announced"), F.trim(get(2)).alias("company_name"), F.left(c("description"), F.lit(DESCRIPTION)).alias("description"), F.coalesce(_amount(get(3), get(4)), _amount(first(1), first(2))).alias("amount_usd"),
        F.coalesce(kind, F.lit("Unknown")).alias("round_type"), R.normalize_stage(F.coalesce(kind, F.lit(""))).alias("stage"), lead.alias("lead"), names.alias("investors"), c("founders").alias("founders"),
        F.regexp_extract(F.coalesce(c("year"), F.lit("")), r"^(\d{4})", 1).try_cast("int").alias("founded"), _amount(F.regexp_extract(F.coalesce(c("total"), F.lit("")), total, 1), F.regexp_extract(F.coalesce(c("total"), F.lit("")), total, 2)).alias("total_raised"),
        R.classify_sector(F.concat_ws(" ", F.coalesce(c("description"), F.lit("")), F.coalesce(c("industry"), F.lit("")))).alias("sector"), "source_url")


# --- reports rendered from deals

_TELLERS = ("Acme Ventures", "Orion Capital", "Delta Labs", "North Fund")


def _turn(by: int) -> Column:
    return F.element_at(F.array(*map(F.lit, _TELLERS)), (F.floor(F.col("id") / by) % len(_TELLERS) + 1).cast("int"))


def _said(*parts) -> Column:
    return F.concat(*[F.lit(x) if isinstance(x, str) else x for x in parts])


def _rows(t: Tables) -> DataFrame:
    name = F.concat(F.lit("Firm C"), F.regexp_extract("company_name", r"0*(\d+)$", 1))
    return t.deals.where("date_announced is not null").withColumn("said", name).withColumn("millions", F.floor(F.coalesce("amount_usd", F.lit(3e6)) / 1e6).cast("string"))


def daily_pages(t: Tables) -> DataFrame:
    c, id_ = F.col, F.col("id")
    text = _said(
        c("said"), ", a shop for ", F.regexp_replace("company_name", r"\D", ""), " things, has raised $", c("millions"), "M in ", c("stage"), " funding. ", F.when(id_ % 2 == 0, _said("The round was led by ", _turn(2), ". ")).otherwise(""),
        F.when(id_ % 3 != 0, _said("Money came from investors that include ", _turn(1), ", ", _turn(3), " and Jane Doe. ")).otherwise(""), F.when(id_ % 5 != 0, _said("Founded by Ann Lee and Bo Ek in ", (F.lit(2000) + id_ % 20).cast("string"), ". ")).otherwise(""),
        F.when(id_ % 7 != 0, _said("It has now raised a total of $", (id_ % 90 + 1).cast("string"), ".5M in all. ")).otherwise(""))
    day = F.date_format("date_announced", "M/d/yyyy")
    pages = _paged(_rows(t), F.datediff("date_announced", F.lit("1990-01-01").cast("date")).cast("long"), "id", _said("<p>", text, "</p>"), _said("<header>The daily report</header><h1>Report ", day, "</h1>"), F.lit("https://r.example.com/daily"), 1000)
    return pages.withColumn("html", F.replace("html", F.lit("<title>t</title>"), _said("<title>Daily report ", F.date_format(F.date_add(F.lit("1990-01-01").cast("date"), F.floor(c("page_id") / 100000).cast("int")), "M/d/yyyy"), "</title>")))


_D = f"""
with d as (select *, 'Firm C' || regexp_extract(company_name, '0*(\\d+)$', 1) as said, floor(coalesce(amount_usd, 3e6) / 1e6) * 1e6 as told,
  ([{', '.join(f"'{x}'" for x in _TELLERS)}]) as n from deals where date_announced is not null),
e as (select *, n[id // 2 % 4 + 1] as l, [n[id % 4 + 1], n[id // 3 % 4 + 1], 'Jane Doe'] as x from d)"""


@query("daily_report_deals", _D + f"""
select date_announced, said as company_name, 'shop for ' || regexp_replace(company_name, '\\D', '', 'g') || ' things' as description, told as amount_usd, stage, case when id % 2 = 0 then l end as lead,
  array_to_string(case when id % 3 = 0 then case when id % 2 = 0 then [l] else [] end when id % 2 = 0 and not list_contains(x, l) then list_concat([l], x) else x end, ', ') as investors,
  case when id % 5 <> 0 then 'Ann Lee and Bo Ek' end as founders, case when id % 5 <> 0 then cast(2000 + id % 20 as integer) end as founded, case when id % 7 <> 0 then (id % 90 + 1.5) * 1e6 end::double as total_raised from e""")
def daily_report_deals(t: Tables) -> DataFrame:
    """Deals read back from daily reports, one page a day."""
    return read_daily_reports(daily_pages(t)).drop("page_id", "source_url").withColumn("investors", F.array_join("investors", ", "))


def roundup_pages(t: Tables) -> DataFrame:
    """Monthly round-ups of twenty deals a page: labels in three orders, some missing, long lines wrapped, amounts in three places."""
    c, id_ = F.col, F.col("id")
    k = id_ % 3
    number = (id_ % 30 + 1).cast("string")
    money = _said("$", c("millions"), "M")
    line = lambda label, *said: _said("<p>", label, ": ", *said, "</p>")
    kind = line("Round", c("stage"), F.when(k == 1, _said(" – ", money)).otherwise(""))
    about = _said("<p>Description: ", c("said"), " makes robots<br>and ", F.regexp_replace("company_name", r"\D", ""), " drones</p><p>for all</p>")
    backers = line("Investors in the round", "led by ", _turn(2), " with participation from ", _turn(1), " and Jane Doe")
    trade, people = line("Industry", "Robotics"), F.when(id_ % 5 != 0, line("Founders", "Ann Lee, Bo Ek")).otherwise("")
    year, total = line(F.when(id_ % 2 == 0, "Founded").otherwise("Founding year"), (F.lit(2000) + id_ % 20).cast("string")), F.when(id_ % 7 != 0, line("Total equity funding raised", "$", (id_ % 90 + 1).cast("string"), ".5M")).otherwise("")
    body = F.when(k == 0, _said(kind, about, backers, trade, people, year, total)).when(k == 1, _said(total, year, people, trade, backers, about, kind)).otherwise(_said(people, about, kind, total, trade, year, backers))
    rows = _rows(t).withColumn("month", F.trunc("date_announced", "month"))
    html = _said("<h2>", number, ". ", c("said"), F.when(k == 0, _said(" ", money)).otherwise(""), "</h2>", F.when(k == 2, _said("<p>They took ", money, " home</p>")).otherwise(""), body)
    url = _said("https://r.example.com/", F.date_format("month", "yyyy/MM"), "/round-up")
    return _paged(rows, F.datediff("month", F.lit("1990-01-01").cast("date")).cast("long"), "id", html, F.lit("<h2>The largest rounds</h2><p>Round: none</p><hr><p>Round: ad</p>"), url, 20)


@query("roundup_deals", _D + f"""
select last_day(date_announced) as date_announced, said as company_name, said || ' makes robots and ' || regexp_replace(company_name, '\\D', '', 'g') || ' drones for all' as description,
  case when id % 3 = 1 and id % 7 <> 0 then (id % 90 + 1.5) * 1e6 else told end as amount_usd, stage as round_type, stage, l as lead, array_to_string([l, x[1], 'Jane Doe'], ', ') as investors, case when id % 5 <> 0 then 'Ann Lee, Bo Ek' end as founders,
  cast(2000 + id % 20 as integer) as founded, case when id % 7 <> 0 then (id % 90 + 1.5) * 1e6 end::double as total_raised, 'Robotics / Deep Tech' as sector from e""")
def roundup_deals(t: Tables) -> DataFrame:
    """Deals read back from monthly round-ups; without an amount in its heading a deal has the first of its lines."""
    return read_roundups(roundup_pages(t)).drop("page_id", "source_url").withColumn("investors", F.array_join("investors", ", "))
