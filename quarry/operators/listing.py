"""Filtered lists, pages, feeds and exports."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.functions.measures import count, names, names_sql, total, total_sql
from quarry.plans.registry import query
from quarry.sources.tables import AS_OF, Tables

SORTS = ("date_announced", "amount_usd", "company_name", "stage", "confidence_score")
FEED_ROWS = 1000


def has(c: str | Column, text: str) -> Column:
    """Contains, ignoring ASCII case; ``text`` is taken literally."""
    return (F.col(c) if isinstance(c, str) else c).ilike("%" + text.replace("\\", "\\\\").replace("%", "\\%").replace("_", "\\_") + "%")


def all_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions, F.lit(True))


def deals_filter(t: Tables, stage: str | None = None, category: str | None = None, city: str | None = None, firm: str | None = None, q: str | None = None) -> DataFrame:
    """Deals that meet every given condition; a firm condition is a semi join through the bridge."""
    rows = t.deals
    if category is not None:
        rows = rows.join(t.categories.where(F.col("name") == category).select(F.col("id").alias("category_id")), "category_id", "left_semi")
    if firm is not None:
        firms = t.firms.where(has("name", firm)).select(F.col("id").alias("firm_id"))
        rows = rows.join(t.deal_firms.join(firms, "firm_id", "left_semi").select(F.col("deal_id").alias("id")), "id", "left_semi")
    conditions = [F.col("stage") == stage] if stage is not None else []
    conditions += [F.col("city") == city] if city is not None else []
    conditions += [has("company_name", q) | F.coalesce(has("raw_text", q), F.lit(False))] if q is not None else []
    return rows.where(all_of(conditions))


@query("deals_filter", """
select id, company_name, stage, city from deals where stage = 'Seed' and city = 'Boston' and (company_name ilike '%9%' or raw_text ilike '%9%' or raw_text ilike '%delaware%')
  and category_id in (select id from categories where name = 'NATION_1') and id in (select deal_id from deal_firms l join firms f on f.id = l.firm_id where f.name ilike '%supplier#00000001%')""")
def _deals_filter(t: Tables) -> DataFrame:
    found = deals_filter(t, stage="Seed", category="NATION_1", city="Boston", firm="supplier#00000001", q="9").unionByName(
        deals_filter(t, stage="Seed", category="NATION_1", city="Boston", firm="supplier#00000001", q="delaware"))
    return found.select("id", "company_name", "stage", "city").distinct()


@query("firms_search", "select id, name from firms where name ilike '%00001%'")
def firms_search(t: Tables, q: str = "00001") -> DataFrame:
    return t.firms.where(has("name", q)).select("id", "name")


@query("investors_filter", "select id, name, firm_id, title from investors where contains(lower(title), 'promo') and firm_id is not null")
def investors_filter(t: Tables, role: str = "promo") -> DataFrame:
    return t.investors.where(F.lower("title").contains(role) & F.col("firm_id").isNotNull()).select("id", "name", "firm_id", "title")


@query("portfolio_filter", """
select p.id, p.company_name, f.name as firm, p.sector from portfolio p join firms f on f.id = p.firm_id
where p.company_name ilike '%unlisted 12%' or f.name ilike '%unlisted 12%' or p.sector ilike '%unlisted 12%'""")
def portfolio_filter(t: Tables, q: str = "unlisted 12") -> DataFrame:
    rows = t.portfolio.join(t.firms.select(F.col("id").alias("firm_id"), F.col("name").alias("firm")), "firm_id")
    return rows.where(has("company_name", q) | has("firm", q) | has("sector", q)).select("id", "company_name", "firm", "sector")


def feed_filter(t: Tables, days: int = 9999, source: str | None = None, min_amount: float | None = None, stage: str | None = None, city: str | None = None) -> DataFrame:
    day = F.col("date_announced")
    conditions = [(day >= F.date_sub(F.lit(AS_OF), days)) | day.isNull()]
    conditions += [F.col(c) == v for c, v in (("source_type", source), ("stage", stage), ("city", city)) if v is not None]
    conditions += [F.col("amount_usd") >= min_amount] if min_amount is not None else []
    return t.deals.where(all_of(conditions))


@query("feed_filter", f"""
select id, date_announced, amount_usd from deals where (date_announced >= date '{AS_OF}' - 400 or date_announced is null)
  and source_type = 'news_article' and amount_usd >= 5e7""")
def _feed_filter(t: Tables) -> DataFrame:
    return feed_filter(t, 400, "news_article", 5e7).select("id", "date_announced", "amount_usd")


@query("de_incorporated", "select id, company_name from deals where source_type = 'de_filing' or raw_text ilike '%delaware%' or raw_text ilike '%de corporation%'")
def de_incorporated(t: Tables) -> DataFrame:
    return t.deals.where((F.col("source_type") == "de_filing") | has("raw_text", "delaware") | has("raw_text", "de corporation")).select("id", "company_name").distinct()


@query("missing_gap", "select id, company_website is null as no_website, coalesce(company_description, '') = '' as no_description from deals where company_website is null or coalesce(company_description, '') = ''")
def missing_gap(t: Tables) -> DataFrame:
    site, text = F.col("company_website").isNull(), F.coalesce("company_description", F.lit("")) == ""
    return t.deals.where(site | text).select("id", site.alias("no_website"), text.alias("no_description"))


@query("low_confidence", "select source_type, count(*) as n from deals where confidence_score < 0.5 group by 1")
def low_confidence(t: Tables, below: float = 0.5) -> DataFrame:
    return t.deals.where(F.col("confidence_score") < below).groupBy("source_type").agg(count().alias("n"))


@query("quarantine_candidates", """
select id, '"' || company_name || '" funding ' || stage || coalesce(' $' || cast(floor(amount_usd / 1e6) as bigint) || 'M', '') as search from deals
where source_type in ('other', 'de_filing') and confidence_score < 0.7 and source_url is null and id not in (select deal_id from deal_metadata where key = 'yc_oss_enriched')""")
def quarantine_candidates(t: Tables) -> DataFrame:
    done = t.deal_metadata.where("key = 'yc_oss_enriched'").select(F.col("deal_id").alias("id"))
    rows = t.deals.where("source_type in ('other', 'de_filing') and confidence_score < 0.7 and source_url is null").join(done, "id", "left_anti")
    size = F.concat(F.lit(" $"), F.floor(F.col("amount_usd") / 1e6).cast("string"), F.lit("M"))
    return rows.select("id", F.concat(F.lit('"'), "company_name", F.lit('" funding '), "stage", F.coalesce(size, F.lit(""))).alias("search"))


@query("active_firms", """
with e as (select user_id % (select count(*) from supplier) as firm_id, event_type, ts from events where event_type in ('error', 'signup')),
  g as (select firm_id, max(ts) as good from e where event_type = 'signup' group by 1)
select f.id, f.name, coalesce(n, 0) as failures from firms f left join (select e.firm_id, count(*) as n from e left join g on g.firm_id = e.firm_id
  where event_type = 'error' and (good is null or ts > good) group by 1) x on x.firm_id = f.id where website is not null and coalesce(n, 0) < 3""")
def active_firms(t: Tables, most: int = 3) -> DataFrame:
    """Firms with a site and fewer than ``most`` failures since their last good visit."""
    n = t.firms.agg(F.count("*").alias("firms"))
    visits = t.raw("events").where("event_type in ('error', 'signup')").crossJoin(F.broadcast(n)).select((F.col("user_id") % F.col("firms")).alias("id"), "event_type", "ts")
    good = visits.where("event_type = 'signup'").groupBy("id").agg(F.max("ts").alias("good"))
    errors = visits.where("event_type = 'error'").join(good, "id", "left").where("good is null or ts > good").groupBy("id").agg(count().alias("n"))
    out = t.firms.where("website is not null").join(errors, "id", "left").select("id", "name", F.coalesce("n", F.lit(0)).alias("failures"))
    return out.where(F.col("failures") < most)


# --- pages and top-k


def page_of(rows: DataFrame, page: int, per_page: int, most: int = 100) -> DataFrame:
    """One page of sorted rows; numbers are clamped to sensible ones."""
    size = min(max(per_page, 1), most)
    return rows.offset((max(page, 1) - 1) * size).limit(size)


def deals_page(t: Tables, page: int = 1, per_page: int = 25, sort: str = "date_announced", desc: bool = True, **conditions) -> DataFrame:
    """A page of deals with firm and investor names; nulls come last in both directions, the id breaks ties."""
    sort = sort if sort in SORTS else "date_announced"
    order = F.col(sort).desc_nulls_last() if desc else F.col(sort).asc_nulls_last()
    rows = page_of(deals_filter(t, **conditions).orderBy(order, "id"), page, per_page)
    rows = rows.join(F.broadcast(t.categories.select(F.col("id").alias("category_id"), F.col("name").alias("category"))), "category_id", "left")
    ids = F.broadcast(rows.select(F.col("id").alias("deal_id")))  # one page
    firms = t.deal_firms.join(ids, "deal_id", "left_semi").join(t.firms.select(F.col("id").alias("firm_id"), "name"), "firm_id")
    people = t.deal_investors.join(ids, "deal_id", "left_semi").join(t.investors.select(F.col("id").alias("investor_id"), "name"), "investor_id")
    firms = firms.groupBy(F.col("deal_id").alias("id")).agg(names("name").alias("firms"))
    people = people.groupBy(F.col("deal_id").alias("id")).agg(names("name").alias("investors"))
    out = rows.join(firms, "id", "left").join(people, "id", "left")
    return out.select("id", "company_name", "stage", "amount_usd", "date_announced", "category", "city", "firms", "investors")


@query("deals_page", f"""
select p.id, p.company_name, p.stage, p.amount_usd, p.date_announced, c.name as category, p.city, f.firms, i.investors
from (select * from deals order by date_announced desc nulls last, id limit 25) p left join categories c on c.id = p.category_id
left join (select deal_id, {names_sql("name")} as firms from deal_firms l join firms f on f.id = l.firm_id group by 1) f on f.deal_id = p.id
left join (select deal_id, {names_sql("name")} as investors from deal_investors l join investors i on i.id = l.investor_id group by 1) i on i.deal_id = p.id""")
def _deals_page(t: Tables) -> DataFrame:
    return deals_page(t)


@query("deals_page_by_amount", "select id, company_name, amount_usd from deals where stage = 'Seed' order by amount_usd nulls last, id limit 10 offset 10")
def deals_page_by_amount(t: Tables) -> DataFrame:
    return deals_page(t, 2, 10, "amount_usd", False, stage="Seed").select("id", "company_name", "amount_usd")


@query("recent_deals", "select id, company_name, date_announced from deals order by date_announced desc nulls last, id limit 10")
def recent_deals(t: Tables) -> DataFrame:
    return t.deals.orderBy(F.desc_nulls_last("date_announced"), "id").limit(10).select("id", "company_name", "date_announced")


def told(c: Column) -> tuple[Column, Column]:
    """(founders, total raised) of a text's labelled lines; null where there is no such line."""
    founders, total = F.regexp_extract(c, r"Founders: (.+)", 1), F.regexp_extract(c, r"Total raised: \$([\d,.]+)", 1)
    return F.nullif(founders, F.lit("")), F.replace(total, F.lit(",")).try_cast("double")


def feed(t: Tables, rows: int = FEED_ROWS, **conditions) -> DataFrame:
    """Newest deals with category, firms, leads, verified firms, backers with title and firm, founders and total raised."""
    top = feed_filter(t, **conditions).orderBy(F.desc_nulls_last("date_announced"), F.desc("created_at"), "id").limit(rows)
    ids = F.broadcast(top.select(F.col("id").alias("deal_id")))
    links = t.deal_firms.join(ids, "deal_id", "left_semi").join(t.firms.select(F.col("id").alias("firm_id"), "name"), "firm_id")
    lead, sure = F.when(F.col("role") == "lead", F.col("name")), F.when(F.col("verified") == 1, F.col("name"))
    links = links.groupBy(F.col("deal_id").alias("id")).agg(names("name").alias("firms"), names(lead).alias("leads"), names(sure).alias("verified"))
    people = t.deal_investors.join(ids, "deal_id", "left_semi").join(t.investors.select(F.col("id").alias("investor_id"), "name", "title", "firm_id"), "investor_id")
    people = people.join(t.firms.select(F.col("id").alias("firm_id"), F.col("name").alias("firm")), "firm_id", "left")
    one = F.concat("name", F.lit(", "), F.coalesce("title", F.lit("")), F.lit(", "), F.coalesce("firm", F.lit("")))
    people = people.groupBy(F.col("deal_id").alias("id")).agg(names(one).alias("investors"))
    categories = t.categories.select(F.col("id").alias("category_id"), F.col("name").alias("category"))
    founders, total = told(F.col("raw_text"))
    out = top.join(links, "id", "left").join(people, "id", "left").join(categories, "category_id", "left")
    return out.select("id", "company_name", "stage", "amount_usd", "date_announced", "source_type", "category", "firms", "leads", "verified", "investors", founders.alias("founders"), total.alias("total_raised"))


_FEED = f"(select * from deals where date_announced >= date '{AS_OF}' - 9999 or date_announced is null order by date_announced desc nulls last, created_at desc, id limit {FEED_ROWS})"


def with_lines(deals: DataFrame) -> DataFrame:
    """Deals whose texts have labelled lines below: founders on two in three, the total on three in four."""
    k = F.col("id")
    lines = F.concat(F.when(k % 3 != 0, F.concat(F.lit("\nFounders: Ann Lee, Bo Ek "), k.cast("string"))).otherwise(""), F.when(k % 4 != 0, F.concat(F.lit("\nTotal raised: $"), (k % 900 + 100).cast("string"), F.lit(",000.5"))).otherwise(""))
    return deals.withColumn("raw_text", F.concat("raw_text", lines))


@query("feed", f"""
select p.id, p.company_name, p.stage, p.amount_usd, p.date_announced, p.source_type, c.name as category, l.firms, l.leads, l.verified, i.investors,
  case when raw_text is not null and p.id % 3 <> 0 then 'Ann Lee, Bo Ek ' || p.id end as founders, case when raw_text is not null and p.id % 4 <> 0 then (p.id % 900 + 100) * 1000.0 + 0.5 end::double as total_raised
from {_FEED} p left join categories c on c.id = p.category_id left join (select deal_id, {names_sql("name")} as firms, coalesce(string_agg(distinct name, '|' order by name) filter (role = 'lead'), '') as leads,
  coalesce(string_agg(distinct name, '|' order by name) filter (verified = 1), '') as verified from deal_firms l join firms f on f.id = l.firm_id group by 1) l on l.deal_id = p.id
left join (select deal_id, {names_sql("x")} as investors from (select deal_id, v.name || ', ' || coalesce(v.title, '') || ', ' || coalesce(f.name, '') as x from deal_investors d join investors v on v.id = d.investor_id left join firms f on f.id = v.firm_id) group by 1) i on i.deal_id = p.id""")
def _feed(t: Tables) -> DataFrame:
    lined = Tables(t.spark, t.path)
    lined.deals = with_lines(t.deals)
    return feed(lined)


@query("feed_summary", f"""
select kind, label, count(*) as deals, {total_sql("amount_usd")} as capital from (
  select 'all' as kind, 'all' as label, amount_usd from {_FEED} union all select 'source', source_type, amount_usd from {_FEED}
  union all select 'stage', stage, amount_usd from {_FEED} union all select 'week', strftime(date_announced, '%Y-W%U'), amount_usd from {_FEED} where date_announced is not null) x group by 1, 2""")
def feed_summary(t: Tables) -> DataFrame:
    """Summary of the limited page, not of all deals."""
    top = feed_filter(t).orderBy(F.desc_nulls_last("date_announced"), F.desc("created_at"), "id").limit(FEED_ROWS)
    week = F.floor((F.dayofyear("date_announced") - 1 + 7 - (F.dayofweek("date_announced") - 1)) / 7)
    week = F.concat(F.year("date_announced").cast("string"), F.lit("-W"), F.lpad(week.cast("string"), 2, "0"))
    kinds = F.array(*[F.struct(F.lit(k).alias("kind"), v.alias("label")) for k, v in (("all", F.lit("all")), ("source", F.col("source_type")), ("stage", F.col("stage")), ("week", week))])
    rows = top.select("amount_usd", F.explode(kinds).alias("x")).where("x.label is not null")
    return rows.groupBy("x.kind", "x.label").agg(count().alias("deals"), total("amount_usd").alias("capital"))


@query("top_k_per_key", "select id, source_type from (select *, row_number() over (partition by source_type order by date_announced desc nulls last, id) as r from deals) x where r <= 30")
def top_k_per_key(t: Tables, k: int = 30) -> DataFrame:
    w = Window.partitionBy("source_type").orderBy(F.desc_nulls_last("date_announced"), "id")
    return t.deals.withColumn("r", F.row_number().over(w)).where(F.col("r") <= k).select("id", "source_type")


@query("saved_deals_list", "select s.user_id, s.folder, s.created_at, d.id, d.company_name, d.stage from saved_deals s join deals d on d.id = s.deal_id where s.user_id = 7")
def saved_deals_list(t: Tables, user: int = 7) -> DataFrame:
    rows = t.saved_deals.where(F.col("user_id") == user).join(t.deals.select(F.col("id").alias("deal_id"), "company_name", "stage"), "deal_id")
    return rows.orderBy(F.desc("created_at"), "deal_id").select("user_id", "folder", "created_at", F.col("deal_id").alias("id"), "company_name", "stage")


@query("recent_runs", "select id, source, status, started_at from scrape_logs order by started_at desc, id limit 50")
def recent_runs(t: Tables) -> DataFrame:
    return t.scrape_logs.orderBy(F.desc("started_at"), "id").limit(50).select("id", "source", "status", "started_at")


@query("top_patterns", "select reason, company_name, count(*) as hits, max(created_at) as last_seen from rejections group by 1, 2 order by hits desc, reason, company_name limit 20")
def top_patterns(t: Tables) -> DataFrame:
    rows = t.rejections.groupBy("reason", "company_name").agg(count().alias("hits"), F.max("created_at").alias("last_seen"))
    return rows.orderBy(F.desc("hits"), "reason", "company_name").limit(20)


@query("gate_metrics_recent", "select cast(created_at as date) as run_date, source_type, count(*) as rejected from rejections group by 1, 2 order by run_date desc, source_type limit 50")
def gate_metrics_recent(t: Tables) -> DataFrame:
    rows = t.rejections.groupBy(F.to_date("created_at").alias("run_date"), "source_type").agg(count().alias("rejected"))
    return rows.orderBy(F.desc("run_date"), "source_type").limit(50)


# --- exports


def export_rows(t: Tables, rows: DataFrame | None = None) -> DataFrame:
    """One row for each deal with joined firm and investor names, ready for ``write.csv``."""
    rows = t.deals if rows is None else rows
    firms = t.deal_firms.join(t.firms.select(F.col("id").alias("firm_id"), "name"), "firm_id").groupBy(F.col("deal_id").alias("id")).agg(names("name").alias("firms"))
    people = t.deal_investors.join(t.investors.select(F.col("id").alias("investor_id"), "name"), "investor_id")
    people = people.groupBy(F.col("deal_id").alias("id")).agg(names("name").alias("investors"))
    out = rows.join(firms, "id", "left").join(people, "id", "left")
    return out.select("id", "company_name", "stage", "amount_usd", "date_announced", "source_type", "city", "firms", "investors")


_EXPORT = f"""
select d.id, d.company_name, d.stage, d.amount_usd, d.date_announced, d.source_type, d.city, f.firms, i.investors from deals d
left join (select deal_id, {names_sql("name")} as firms from deal_firms l join firms f on f.id = l.firm_id group by 1) f on f.deal_id = d.id
left join (select deal_id, {names_sql("name")} as investors from deal_investors l join investors i on i.id = l.investor_id group by 1) i on i.deal_id = d.id"""


@query("export_deals_csv", _EXPORT)
def export_deals_csv(t: Tables) -> DataFrame:
    return export_rows(t)


@query("export_deals_csv_filtered", _EXPORT + " where d.stage = 'Series A' and d.city = 'New York'")
def export_deals_csv_filtered(t: Tables) -> DataFrame:
    return export_rows(t, deals_filter(t, stage="Series A", city="New York"))


@query("export_deals_json", """
select l.deal_id, d.company_name, f.name as firm, l.role from deal_firms l join firms f on f.id = l.firm_id join deals d on d.id = l.deal_id""")
def export_deals_json(t: Tables) -> DataFrame:
    """Nested documents, read back as rows: ``documents(t)`` is what ``write.json`` gets."""
    return documents(t).select(F.col("id").alias("deal_id"), "company_name", F.explode("firms").alias("x")).select("deal_id", "company_name", F.col("x.name").alias("firm"), "x.role")


@query("export_deals_json_investors", """
select l.deal_id, i.name as investor, i.title from deal_investors l join investors i on i.id = l.investor_id join deals d on d.id = l.deal_id""")
def export_deals_json_investors(t: Tables) -> DataFrame:
    """The people of the nested documents, read back as rows."""
    return documents(t).select(F.col("id").alias("deal_id"), F.explode("investors").alias("x")).select("deal_id", F.col("x.name").alias("investor"), "x.title")


def documents(t: Tables) -> DataFrame:
    """Deals with ``firms`` (name, role) and ``investors`` (name, title), each in order."""
    firms = t.deal_firms.join(t.firms.select(F.col("id").alias("firm_id"), "name"), "firm_id")
    firms = firms.groupBy(F.col("deal_id").alias("id")).agg(F.array_sort(F.collect_list(F.struct("name", "role"))).alias("firms"))
    people = t.deal_investors.join(t.investors.select(F.col("id").alias("investor_id"), "name", "title"), "investor_id")
    people = people.groupBy(F.col("deal_id").alias("id")).agg(F.array_sort(F.collect_list(F.struct("name", "title"))).alias("investors"))
    return t.deals.join(firms, "id", "left").join(people, "id", "left")


def write_csv(rows: DataFrame, path: str) -> None:
    rows.write.mode("errorifexists").option("header", True).csv(path)


def write_json(rows: DataFrame, path: str) -> None:
    rows.write.mode("errorifexists").json(path)


@query("notifications_inbox", """
select user_id, event_id as id, ts from events where event_type = 'click' and user_id = 11 order by ts desc, event_id limit 50""")
def notifications_inbox(t: Tables, user: int = 11) -> DataFrame:
    rows = t.raw("events").where((F.col("event_type") == "click") & (F.col("user_id") == user))
    return rows.orderBy(F.desc("ts"), "event_id").limit(50).select("user_id", F.col("event_id").alias("id"), "ts")
