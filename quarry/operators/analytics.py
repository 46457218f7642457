"""Breakdowns of deals by stage, sector, time, source and city; firm, partner and investor tables; data health.

Each operator answers for all firms or users at once. Bridges are aggregated before they meet wide tables.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.functions.measures import count, mean, mean_sql, names, names_sql, total, total_sql
from quarry.plans.registry import query
from quarry.sources.tables import AS_OF, EVENTS_AS_OF, Tables, norm_name

_SUM, _AVG = total_sql("amount_usd"), mean_sql("amount_usd")


@query("stats_overview", f"""
select count(*) as deals, {_SUM} as capital, {_AVG} as average, count(*) filter (source_type = 'de_filing') as de_filings,
  max(coalesce(date_announced, cast(created_at as date))) as latest, (select count(*) from firms) as firms, (select count(*) from investors) as investors
from deals""")
def stats_overview(t: Tables) -> DataFrame:
    deals = t.deals.agg(
        count().alias("deals"), total("amount_usd").alias("capital"), mean("amount_usd").alias("average"),
        F.count_if(F.col("source_type") == "de_filing").alias("de_filings"),
        F.max(F.coalesce("date_announced", F.to_date("created_at"))).alias("latest"))
    firms, people = t.firms.agg(count().alias("firms")), t.investors.agg(count().alias("investors"))
    return deals.crossJoin(F.broadcast(firms)).crossJoin(F.broadcast(people))  # three one-row frames


def _group(t: Tables, *keys: str) -> DataFrame:
    return t.deals.groupBy(*keys).agg(count().alias("deals"), total("amount_usd").alias("capital"), mean("amount_usd").alias("average"))


@query("by_stage", f"select stage, count(*) as deals, {_SUM} as capital, {_AVG} as average from deals group by stage")
def by_stage(t: Tables) -> DataFrame:
    return _group(t, "stage")


@query("by_category", f"select c.name as category, count(*) as deals, {_SUM} as capital from deals d join categories c on d.category_id = c.id group by 1")
def by_category(t: Tables) -> DataFrame:
    joined = t.deals.join(t.categories.select(F.col("id").alias("category_id"), F.col("name").alias("category")), "category_id")
    return joined.groupBy("category").agg(count().alias("deals"), total("amount_usd").alias("capital"))


@query("top_categories", f"""
select c.name as category, count(*) as deals, {_SUM} as capital from deals d join categories c on d.category_id = c.id
group by 1 order by deals desc, category limit 10""")
def top_categories(t: Tables) -> DataFrame:
    return by_category(t).orderBy(F.desc("deals"), "category").limit(10)


@query("by_month", f"""
select strftime(date_announced, '%Y-%m') as month, count(*) as deals, {_SUM} as capital from deals where date_announced is not null group by 1""")
def by_month(t: Tables) -> DataFrame:
    rows = t.deals.where("date_announced is not null").withColumn("month", F.date_format("date_announced", "yyyy-MM"))
    return rows.groupBy("month").agg(count().alias("deals"), total("amount_usd").alias("capital"))


@query("by_source", f"select source_type, count(*) as deals, {_SUM} as capital, {mean_sql('confidence_score')} as confidence from deals group by 1")
def by_source(t: Tables) -> DataFrame:
    return t.deals.groupBy("source_type").agg(count().alias("deals"), total("amount_usd").alias("capital"), mean("confidence_score").alias("confidence"))


@query("by_city", f"select city, count(*) as deals, {_SUM} as capital from deals where city is not null group by 1")
def by_city(t: Tables) -> DataFrame:
    return t.deals.where("city is not null").groupBy("city").agg(count().alias("deals"), total("amount_usd").alias("capital"))


@query("by_city_all", "select coalesce(city, 'Unknown') as city, count(*) as deals from deals group by 1")
def by_city_all(t: Tables) -> DataFrame:
    return t.deals.groupBy(F.coalesce("city", F.lit("Unknown")).alias("city")).agg(count().alias("deals"))


@query("sector_trends", f"""
select strftime(date_announced, '%Y-%m') as month, c.name as sector, count(*) as deals, {_SUM} as capital, {_AVG} as average
from deals d left join categories c on d.category_id = c.id where date_announced is not null group by 1, 2""")
def sector_trends(t: Tables) -> DataFrame:
    rows = t.deals.where("date_announced is not null").withColumn("month", F.date_format("date_announced", "yyyy-MM"))
    rows = rows.join(t.categories.select(F.col("id").alias("category_id"), F.col("name").alias("sector")), "category_id", "left")
    return rows.groupBy("month", "sector").agg(count().alias("deals"), total("amount_usd").alias("capital"), mean("amount_usd").alias("average"))


@query("velocity", f"""
select p.days, count(*) filter (age <= days) as deals, coalesce({total_sql("amount_usd").replace(")::double", ") filter (age <= days)::double")}, 0) as capital,
  count(*) filter (age > days and age <= 2 * days) as deals_before,
  round_even(100.0 * (count(*) filter (age <= days) - count(*) filter (age > days and age <= 2 * days))::double / greatest(count(*) filter (age > days and age <= 2 * days), 1), 0) as trend
from (select date '{AS_OF}' - date_announced as age, amount_usd from deals where date_announced is not null) d
cross join (select unnest([7, 30, 90]) as days) p group by 1""")
def velocity(t: Tables) -> DataFrame:
    """Deals and capital of the last 7, 30 and 90 days against the same span before; one pass, three rows a deal."""
    age = F.datediff(F.lit(AS_OF), "date_announced")
    rows = t.deals.where("date_announced is not null").where(age <= 180).select(age.alias("age"), "amount_usd", F.explode(F.array(F.lit(7), F.lit(30), F.lit(90))).alias("days"))
    now, before = F.col("age") <= F.col("days"), (F.col("age") > F.col("days")) & (F.col("age") <= 2 * F.col("days"))
    out = rows.groupBy("days").agg(
        F.count_if(now).alias("deals"), F.coalesce(total(F.when(now, F.col("amount_usd"))), F.lit(0.0)).alias("capital"), F.count_if(before).alias("deals_before"))
    return out.withColumn("trend", F.bround(F.lit(100.0) * (F.col("deals") - F.col("deals_before")) / F.greatest("deals_before", F.lit(1)), 0))


_ROUNDS = """string_agg(coalesce(cast(date_announced as varchar), '?') || ' ' || stage || ' ' || id, '|' order by date_announced nulls first, id)"""


@query("followons", f"select company_name_normalized, min(company_name) as company_name, count(*) as rounds, {_ROUNDS} as history from deals group by 1 having count(*) > 1")
def followons(t: Tables) -> DataFrame:
    rounds = F.array_sort(F.collect_list(F.struct("date_announced", "id", "stage")), _nulls_first)
    line = lambda x: F.concat_ws(" ", F.coalesce(x["date_announced"].cast("string"), F.lit("?")), x["stage"], x["id"].cast("string"))
    out = t.deals.groupBy("company_name_normalized").agg(F.min("company_name").alias("company_name"), count().alias("rounds"), rounds.alias("r"))
    return out.where("rounds > 1").select("company_name_normalized", "company_name", "rounds", F.array_join(F.transform("r", line), "|").alias("history"))


def _nulls_first(a, b):
    day = lambda x: F.coalesce(x["date_announced"], F.lit("0001-01-01").cast("date"))
    return F.when((day(a) < day(b)) | ((day(a) == day(b)) & (a["id"] < b["id"])), -1).when((day(a) == day(b)) & (a["id"] == b["id"]), 0).otherwise(1)


@query("completeness", """
select f as field, round(100.0::double * n / total, 2) as filled from (
  select count(*) as total, count(amount_usd) as amount_usd, count(date_announced) as date_announced, count(category_id) as category_id,
    count(*) filter (company_website is not null and company_website <> '') as company_website,
    count(*) filter (company_description is not null and company_description <> '') as company_description,
    (select count(distinct deal_id) from deal_firms) as firm_links from deals)
unpivot (n for f in (amount_usd, date_announced, category_id, company_website, company_description, firm_links))""")
def completeness(t: Tables) -> DataFrame:
    fields = ("amount_usd", "date_announced", "category_id", "company_website", "company_description")
    filled = [F.count_if(F.col(f).isNotNull() & (F.col(f).cast("string") != "")).alias(f) for f in fields]
    one = t.deals.agg(count().alias("total"), *filled).crossJoin(F.broadcast(t.deal_firms.agg(F.countDistinct("deal_id").alias("firm_links"))))
    return one.unpivot("total", [*fields, "firm_links"], "field", "n").select("field", F.round(F.lit(100.0) * F.col("n") / F.col("total"), 2).alias("filled"))


@query("deal_firm_pairs", "select a.deal_id, a.firm_id as firm_a, b.firm_id as firm_b from deal_firms a join deal_firms b on a.deal_id = b.deal_id and a.firm_id < b.firm_id")
def deal_firm_pairs(t: Tables) -> DataFrame:
    """Pairs of firms in one deal: what the co-investor table counts. Deals have few firms, so an equi join on the deal."""
    a = t.deal_firms.select("deal_id", F.col("firm_id").alias("firm_a"))
    b = t.deal_firms.select("deal_id", F.col("firm_id").alias("firm_b"))
    return a.join(b, "deal_id").where("firm_a < firm_b")


@query("coinvestors", f"""
select firm_a, firm_b, count(distinct deal_id) as shared_deals, {_SUM} as shared_capital from (
  select a.deal_id, a.firm_id as firm_a, b.firm_id as firm_b from deal_firms a join deal_firms b on a.deal_id = b.deal_id and a.firm_id < b.firm_id) p
join deals d on p.deal_id = d.id group by 1, 2 having count(distinct deal_id) >= 2 order by shared_deals desc, firm_a, firm_b limit 50""")
def coinvestors(t: Tables) -> DataFrame:
    pairs = deal_firm_pairs(t).join(t.deals.select(F.col("id").alias("deal_id"), "amount_usd"), "deal_id")
    out = t.spread(pairs, "firm_a", "firm_b").groupBy("firm_a", "firm_b").agg(count().alias("shared_deals"), total("amount_usd").alias("shared_capital"))
    return out.where("shared_deals >= 2").orderBy(F.desc("shared_deals"), "firm_a", "firm_b").limit(50)


@query("firm_leaderboard", f"""
select f.id, f.name, coalesce(x.deals, 0) as deals, x.capital, coalesce(x.leads, 0) as leads, coalesce(i.team, 0) as team, coalesce(p.companies, 0) as companies
from firms f left join (select firm_id, count(*) as deals, {_SUM} as capital, count(*) filter (role = 'lead') as leads
  from deal_firms l join deals d on l.deal_id = d.id group by 1) x on x.firm_id = f.id
left join (select firm_id, count(*) as team from investors group by 1) i on i.firm_id = f.id
left join (select firm_id, count(*) as companies from portfolio group by 1) p on p.firm_id = f.id""")
def firm_leaderboard(t: Tables) -> DataFrame:
    links = t.deal_firms.join(t.deals.select(F.col("id").alias("deal_id"), "amount_usd"), "deal_id")
    links = links.groupBy("firm_id").agg(count().alias("deals"), total("amount_usd").alias("capital"), F.count_if(F.col("role") == "lead").alias("leads"))
    team = t.investors.where("firm_id is not null").groupBy("firm_id").agg(count().alias("team"))
    held = t.portfolio.groupBy("firm_id").agg(count().alias("companies"))
    out = t.firms.withColumnRenamed("id", "firm_id")
    for part in (links, team, held):
        out = out.join(part, "firm_id", "left")
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return out.select(F.col("firm_id").alias("id"), "name", zero("deals"), "capital", zero("leads"), zero("team"), zero("companies"))


@query("investor_leaderboard", """
select i.id, i.name, i.title, f.name as firm, coalesce(n.deals, 0) as deals from investors i left join firms f on i.firm_id = f.id
left join (select investor_id, count(distinct deal_id) as deals from deal_investors group by 1) n on n.investor_id = i.id""")
def investor_leaderboard(t: Tables) -> DataFrame:
    deals = t.deal_investors.groupBy(F.col("investor_id").alias("id")).agg(count().alias("deals"))
    firms = t.firms.select(F.col("id").alias("firm_id"), F.col("name").alias("firm"))
    out = t.investors.join(firms, "firm_id", "left").join(deals, "id", "left")
    return out.select("id", "name", "title", "firm", F.coalesce("deals", F.lit(0)).alias("deals"))


@query("firm_partners", f"""
select i.firm_id, i.id as investor_id, count(*) as deals, {_SUM} as capital, string_agg(distinct coalesce(c.name, '?'), '|' order by coalesce(c.name, '?')) as categories
from investors i join deal_investors l on l.investor_id = i.id join deals d on d.id = l.deal_id left join categories c on c.id = d.category_id
where i.firm_id is not null group by 1, 2""")
def firm_partners(t: Tables) -> DataFrame:
    people = t.investors.where("firm_id is not null").select(F.col("id").alias("investor_id"), "firm_id")
    deals = t.deals.select(F.col("id").alias("deal_id"), "amount_usd", "category_id")
    deals = deals.join(t.categories.select(F.col("id").alias("category_id"), F.col("name").alias("category")), "category_id", "left")
    rows = t.deal_investors.join(people, "investor_id").join(deals, "deal_id")
    return rows.groupBy("firm_id", "investor_id").agg(count().alias("deals"), total("amount_usd").alias("capital"), names(F.coalesce("category", F.lit("?"))).alias("categories"))


def _firm_deals(t: Tables) -> DataFrame:
    return t.deal_firms.join(t.deals.withColumnRenamed("id", "deal_id"), "deal_id")


@query("firm_profile_kpis", f"""
select firm_id, count(*) as deals, {_SUM} as capital, {_AVG} as average, max(date_announced) as latest,
  count(*) filter (date_announced >= date '{AS_OF}' - 90) as last_90, count(*) filter (date_announced >= date '{AS_OF}' - 365) as last_365
from deal_firms l join deals d on l.deal_id = d.id group by 1""")
def firm_profile_kpis(t: Tables) -> DataFrame:
    return _firm_deals(t).groupBy("firm_id").agg(
        count().alias("deals"), total("amount_usd").alias("capital"), mean("amount_usd").alias("average"), F.max("date_announced").alias("latest"),
        F.count_if(F.col("date_announced") >= F.date_sub(F.lit(AS_OF), 90)).alias("last_90"), F.count_if(F.col("date_announced") >= F.date_sub(F.lit(AS_OF), 365)).alias("last_365"))


@query("firm_profile_sectors", f"select firm_id, c.name as sector, count(*) as deals, {_SUM} as capital from deal_firms l join deals d on l.deal_id = d.id join categories c on c.id = d.category_id group by 1, 2")
def firm_profile_sectors(t: Tables) -> DataFrame:
    rows = _firm_deals(t).join(t.categories.select(F.col("id").alias("category_id"), F.col("name").alias("sector")), "category_id")
    return rows.groupBy("firm_id", "sector").agg(count().alias("deals"), total("amount_usd").alias("capital"))


@query("firm_profile_stages", "select firm_id, stage, count(*) as deals from deal_firms l join deals d on l.deal_id = d.id group by 1, 2")
def firm_profile_stages(t: Tables) -> DataFrame:
    return _firm_deals(t).groupBy("firm_id", "stage").agg(count().alias("deals"))


@query("firm_team_sectors", """
select i.firm_id, c.name as sector, count(distinct i.id) as partners from investors i join deal_investors l on l.investor_id = i.id
join deals d on d.id = l.deal_id join categories c on c.id = d.category_id where i.firm_id is not null group by 1, 2""")
def firm_team_sectors(t: Tables) -> DataFrame:
    people = t.investors.where("firm_id is not null").select(F.col("id").alias("investor_id"), "firm_id")
    deals = t.deals.select(F.col("id").alias("deal_id"), "category_id").join(t.categories.select(F.col("id").alias("category_id"), F.col("name").alias("sector")), "category_id")
    rows = t.deal_investors.join(people, "investor_id").join(deals, "deal_id").select("firm_id", "sector", "investor_id").distinct()
    return rows.groupBy("firm_id", "sector").agg(count().alias("partners"))


@query("partners_by_category", f"""
select c.name as category, l.investor_id, count(*) as deals, {_SUM} as capital from deal_investors l join deals d on d.id = l.deal_id
left join categories c on c.id = d.category_id group by 1, 2""")
def partners_by_category(t: Tables) -> DataFrame:
    deals = t.deals.select(F.col("id").alias("deal_id"), "amount_usd", "category_id")
    deals = deals.join(t.categories.select(F.col("id").alias("category_id"), F.col("name").alias("category")), "category_id", "left")
    rows = t.spread(t.deal_investors.join(deals, "deal_id").select("category", "investor_id", "amount_usd"), "category", "investor_id")
    return rows.groupBy("category", "investor_id").agg(count().alias("deals"), total("amount_usd").alias("capital"))


@query("portfolio_by_firm", "select f.name as firm, count(*) as companies from portfolio p join firms f on f.id = p.firm_id group by 1")
def portfolio_by_firm(t: Tables) -> DataFrame:
    held = t.portfolio.groupBy("firm_id").agg(count().alias("companies"))
    return held.join(t.firms.select(F.col("id").alias("firm_id"), F.col("name").alias("firm")), "firm_id").groupBy("firm").agg(F.sum("companies").alias("companies"))


@query("timeline", f"select date_announced as day, count(*) as deals, {_SUM} as capital, count(distinct source_type) as sources from deals where date_announced is not null group by 1")
def timeline(t: Tables) -> DataFrame:
    """By day; sources are first made distinct per day so that the final count is of few rows."""
    part = t.deals.where("date_announced is not null").groupBy(F.col("date_announced").alias("day"), "source_type").agg(count().alias("n"), total("amount_usd").alias("c"))
    return part.groupBy("day").agg(F.sum("n").alias("deals"), total("c").alias("capital"), count().alias("sources"))


@query("top_investors", f"""
select i.id, i.name, count(*) as deals, {_SUM} as capital, {names_sql("company_name")} as companies from investors i
join deal_investors l on l.investor_id = i.id join deals d on d.id = l.deal_id where date_announced >= date '{AS_OF}' - 365
group by 1, 2 order by deals desc, i.id limit 30""")
def top_investors(t: Tables) -> DataFrame:
    recent = t.deals.where(F.col("date_announced") >= F.date_sub(F.lit(AS_OF), 365)).select(F.col("id").alias("deal_id"), "amount_usd", "company_name")
    rows = t.deal_investors.join(recent, "deal_id").groupBy(F.col("investor_id").alias("id")).agg(
        count().alias("deals"), total("amount_usd").alias("capital"), names("company_name").alias("companies"))
    return rows.join(t.investors.select("id", "name"), "id").orderBy(F.desc("deals"), "id").limit(30)


@query("verification_stats", """
select count(*) as links, sum(verified)::bigint as verified, round(100.0::double * sum(verified)::double / count(*), 1) as share,
  count(distinct deal_id) as deals, count(distinct firm_id) as firms from deal_firms""")
def verification_stats(t: Tables) -> DataFrame:
    return t.deal_firms.agg(
        count().alias("links"), F.sum("verified").alias("verified"), F.round(F.lit(100.0) * F.sum("verified") / count(), 1).alias("share"),
        F.countDistinct("deal_id").alias("deals"), F.countDistinct("firm_id").alias("firms"))


@query("verified_by_firm", """
select f.id, f.name, sum(verified)::bigint as verified, count(*) as links, coalesce(any_value(p.companies), 0) as companies from deal_firms l
join firms f on f.id = l.firm_id left join (select firm_id, count(*) as companies from portfolio group by 1) p on p.firm_id = f.id group by 1, 2""")
def verified_by_firm(t: Tables) -> DataFrame:
    links = t.deal_firms.groupBy(F.col("firm_id").alias("id")).agg(F.sum("verified").alias("verified"), count().alias("links"))
    held = t.portfolio.groupBy(F.col("firm_id").alias("id")).agg(count().alias("companies"))
    return links.join(t.firms, "id").join(held, "id", "left").select("id", "name", "verified", "links", F.coalesce("companies", F.lit(0)).alias("companies"))


@query("verified_by_deal", f"""
select d.id, d.company_name, {names_sql("f.name")} as firms from deal_firms l join firms f on f.id = l.firm_id join deals d on d.id = l.deal_id
where verified = 1 group by 1, 2""")
def verified_by_deal(t: Tables) -> DataFrame:
    links = t.deal_firms.where("verified = 1").join(t.firms.select(F.col("id").alias("firm_id"), "name"), "firm_id")
    links = links.groupBy(F.col("deal_id").alias("id")).agg(names("name").alias("firms"))
    return links.join(t.deals.select("id", "company_name"), "id")


@query("rejection_summary", f"""
select reason, data_type, count(*) as n from rejections where created_at >= timestamp '{EVENTS_AS_OF}' - interval 30 day group by 1, 2""")
def rejection_summary(t: Tables) -> DataFrame:
    since = F.lit(f"{EVENTS_AS_OF}").cast("timestamp_ntz") - F.expr("interval 30 day")
    return t.rejections.where(F.col("created_at") >= since).groupBy("reason", "data_type").agg(count().alias("n"))


@query("firm_focus", f"""
select firm_id, {names_sql("c.name")} as sectors, string_agg(distinct d.stage, '|' order by d.stage) filter (d.stage <> 'Unknown') as stages from deal_firms l
join deals d on d.id = l.deal_id left join categories c on c.id = d.category_id group by 1""")
def firm_focus(t: Tables) -> DataFrame:
    """Sectors and stages a firm invests in; a firm with none has null."""
    rows = _firm_deals(t).join(t.categories.select(F.col("id").alias("category_id"), F.col("name").alias("sector")), "category_id", "left")
    none = lambda c: F.when(c != "", c)
    return rows.groupBy("firm_id").agg(none(names("sector")).alias("sectors"), none(names(F.when(F.col("stage") != "Unknown", F.col("stage")))).alias("stages"))


@query("pipeline_health", f"""
select source, count(*) as runs, count(*) filter (status = 'success') as good, max(finished_at) filter (status = 'success') as last_good,
  count(*) filter (started_at >= timestamp '{EVENTS_AS_OF}' - interval 7 day) as last_7,
  count(*) filter (started_at < timestamp '{EVENTS_AS_OF}' - interval 7 day and started_at >= timestamp '{EVENTS_AS_OF}' - interval 14 day) as prior_7
from scrape_logs group by 1""")
def pipeline_health(t: Tables) -> DataFrame:
    now = F.lit(f"{EVENTS_AS_OF}").cast("timestamp_ntz")
    week, two = now - F.expr("interval 7 day"), now - F.expr("interval 14 day")
    good = F.col("status") == "success"
    return t.scrape_logs.groupBy("source").agg(
        count().alias("runs"), F.count_if(good).alias("good"), F.max(F.when(good, F.col("finished_at"))).alias("last_good"),
        F.count_if(F.col("started_at") >= week).alias("last_7"), F.count_if((F.col("started_at") < week) & (F.col("started_at") >= two)).alias("prior_7"))


@query("pipeline_deals", f"""
select source_type, count(*) as deals, count(*) filter (created_at >= timestamp '{AS_OF}' - interval 7 day) as last_7,
  count(*) filter (created_at < timestamp '{AS_OF}' - interval 7 day and created_at >= timestamp '{AS_OF}' - interval 14 day) as prior_7 from deals group by 1""")
def pipeline_deals(t: Tables) -> DataFrame:
    """What each source has brought: all deals, those of the last seven days and of the seven before."""
    now = F.lit(f"{AS_OF}").cast("timestamp_ntz")
    week, two, at = now - F.expr("interval 7 day"), now - F.expr("interval 14 day"), F.col("created_at")
    return t.deals.groupBy("source_type").agg(count().alias("deals"), F.count_if(at >= week).alias("last_7"), F.count_if((at < week) & (at >= two)).alias("prior_7"))


@query("gap_summary", """
select count(*) as deals, count(*) filter (company_website is null) as no_website, count(*) filter (coalesce(company_description, '') = '') as no_description,
  count(*) filter (not exists (select 1 from deal_investors l where l.deal_id = deals.id)) as no_investors from deals""")
def gap_summary(t: Tables) -> DataFrame:
    linked = t.deal_investors.select(F.col("deal_id").alias("id"), F.lit(1).alias("linked")).distinct()
    return t.deals.select("id", "company_website", "company_description").join(linked, "id", "left").agg(
        count().alias("deals"), F.count_if(F.col("company_website").isNull()).alias("no_website"),
        F.count_if(F.coalesce("company_description", F.lit("")) == "").alias("no_description"), F.count_if(F.col("linked").isNull()).alias("no_investors"))


@query("investor_quality_stats", """
select count(*) as investors, count(firm_id) as with_firm, count(title) as with_title,
  count(*) filter (exists (select 1 from deal_investors l where l.investor_id = investors.id)) as with_deals,
  count(*) filter (length(name) > 12) as long_names, (count(firm_id) * 100) // count(*) as firm_share from investors""")
def investor_quality_stats(t: Tables) -> DataFrame:
    linked = t.deal_investors.select(F.col("investor_id").alias("id"), F.lit(1).alias("linked")).distinct()
    return t.investors.join(linked, "id", "left").agg(
        count().alias("investors"), count("firm_id").alias("with_firm"), count("title").alias("with_title"), count("linked").alias("with_deals"),
        F.count_if(F.length("name") > 12).alias("long_names"), F.expr("(count(firm_id) * 100) div count(*)").alias("firm_share"))


@query("saved_folders", "select user_id, folder, count(*) as n from saved_deals group by 1, 2")
def saved_folders(t: Tables) -> DataFrame:
    return t.saved_deals.groupBy("user_id", "folder").agg(count().alias("n"))


@query("run_summary", f"""
select 'stage' as kind, stage as label, count(*) as deals, {_SUM} as capital from deals group by stage
union all select 'source', source_type, count(*), {_SUM} from deals group by source_type
union all select 'city', coalesce(city, 'Unknown'), count(*), {_SUM} from deals group by coalesce(city, 'Unknown')
union all select 'category', coalesce(c.name, 'Unknown'), count(*), {_SUM} from deals d left join categories c on c.id = d.category_id group by 2
union all select 'total', 'all', count(*), {_SUM} from deals""")
def run_summary(t: Tables) -> DataFrame:
    """Grouping sets over one scan instead of one scan for each breakdown."""
    rows = t.deals.join(t.categories.select(F.col("id").alias("category_id"), F.col("name").alias("category")), "category_id", "left")
    rows = rows.select("stage", "source_type", F.coalesce("city", F.lit("Unknown")).alias("city"), F.coalesce("category", F.lit("Unknown")).alias("category"), "amount_usd")
    sets = rows.groupingSets([["stage"], ["source_type"], ["city"], ["category"], []], "stage", "source_type", "city", "category")
    out = sets.agg(F.grouping_id().alias("set"), count().alias("deals"), total("amount_usd").alias("capital"))
    # A bit of the set is zero where its column is grouped by.
    kinds = ((0b0111, "stage", "stage"), (0b1011, "source", "source_type"), (0b1101, "city", "city"), (0b1110, "category", "category"))
    kind, label = F.lit("total"), F.lit("all")
    for bits, name, column in kinds:
        kind, label = F.when(F.col("set") == bits, name).otherwise(kind), F.when(F.col("set") == bits, F.col(column)).otherwise(label)
    return out.select(kind.alias("kind"), label.alias("label"), "deals", "capital")


@query("metadata_map", "select deal_id, string_agg(key || '=' || value, '|' order by key) as entries from deal_metadata group by 1")
def metadata_map(t: Tables) -> DataFrame:
    entry = lambda x: F.concat(x["key"], F.lit("="), x["value"])
    maps = t.deal_metadata.groupBy("deal_id").agg(F.map_from_entries(F.collect_list(F.struct("key", "value"))).alias("m"))
    return maps.select("deal_id", F.array_join(F.transform(F.array_sort(F.map_entries("m")), entry), "|").alias("entries"))


# Sources that names of firms end in, words that are no firm's name, beginnings and parts of such texts.
NAME_SOURCES = (" - TechCrunch", " - Crunchbase", " - VentureBeat")
POSTS = ("ceo", "cto", "cfo", "coo", "partner", "director", "managing director")
NO_FIRM_STARTS = ("and ", "co-founder", "founder")
NO_FIRM_PARTS = (";", "managing director", " - techcrunch", " - crunchbase", "co-founder of", "founder of", "ceo of")
_NO_FIRM = f"^({'|'.join(POSTS)})$|^({'|'.join(NO_FIRM_STARTS)})|{'|'.join(NO_FIRM_PARTS)}"


def discovered(deal_firms: DataFrame, known: DataFrame) -> DataFrame:
    """``name``, ``deals``, ``stages`` of firms (``name``, ``deal_id``, ``stage``) that ``known`` (``name``) lacks.

    Sources and signs around a name go, then an "and " before it; texts that are no firm's name, as they came or tidied,
    are dropped, as are known names in any case.
    """
    clean = F.regexp_replace("name", f"({'|'.join(NAME_SOURCES)})$", "")
    clean = F.trim(F.btrim(F.btrim(F.trim(clean), F.lit(",")), F.lit(";")))
    clean = F.trim(F.regexp_replace(clean, "(?i)^and ", ""))
    rows = deal_firms.groupBy("name").agg(F.countDistinct("deal_id").alias("deals"), names("stage").alias("stages")).withColumn("clean", clean)
    junk = lambda c: (F.char_length(c) < 4) | F.lower(c).rlike(_NO_FIRM)
    rows = rows.where(~junk("name") & ~junk("clean")).withColumn("low", F.lower("clean"))
    return rows.join(known.select(F.lower("name").alias("low")).distinct().hint("merge"), "low", "left_anti").select(F.col("clean").alias("name"), "deals", "stages")


@query("firm_discovery", f"""
with said as (
  select id, case id % 9 when 1 then name || ' - TechCrunch' when 2 then 'and ' || name when 3 then name || ',; ' when 4 then 'CEO of ' || name when 5 then name || ' - VentureBeat' when 6 then 'Partner' when 7 then upper(name) else name end as name from firms),
tidy as (
  select id, name, trim(regexp_replace(trim(trim(trim(trim(regexp_replace(name, '({"|".join(NAME_SOURCES)})$', '')), ','), ';')), '(?i)^and ', '')) as clean from said),
kept as (select * from tidy where length(name) >= 4 and length(clean) >= 4 and not regexp_matches(lower(name), '{_NO_FIRM}') and not regexp_matches(lower(clean), '{_NO_FIRM}'))
select k.clean as name, count(distinct d.id) as deals, string_agg(distinct d.stage, '|' order by d.stage) as stages from kept k join deal_firms l on l.firm_id = k.id join deals d on d.id = l.deal_id
where lower(k.clean) not in (select lower(name) from firms where website is not null and id % 2 = 0) group by k.name, k.clean""")
def firm_discovery(t: Tables) -> DataFrame:
    """Firms seen in deals, as texts name them, that a list of known firms lacks."""
    k, n = F.col("id") % 9, F.col("name")
    said = (
        F.when(k == 1, F.concat(n, F.lit(" - TechCrunch"))).when(k == 2, F.concat(F.lit("and "), n)).when(k == 3, F.concat(n, F.lit(",; "))).when(k == 4, F.concat(F.lit("CEO of "), n))
        .when(k == 5, F.concat(n, F.lit(" - VentureBeat"))).when(k == 6, "Partner").when(k == 7, F.upper(n)).otherwise(n))
    firms = t.firms.select(F.col("id").alias("firm_id"), said.alias("name"))
    rows = _firm_deals(t).join(firms, "firm_id").select("name", F.col("deal_id"), "stage")
    return discovered(rows, t.firms.where("website is not null and id % 2 = 0"))


@query("gate_metrics", f"""
select source_type, cast(created_at as date) as run_date, count(*) as submitted, count(*) filter (confidence_score >= 0.5) as accepted,
  count(*) filter (confidence_score < 0.5) as rejected, {mean_sql("confidence_score")} as confidence from deals group by 1, 2""")
def gate_metrics(t: Tables) -> DataFrame:
    good = F.col("confidence_score") >= 0.5
    return t.deals.groupBy("source_type", F.to_date("created_at").alias("run_date")).agg(
        count().alias("submitted"), F.count_if(good).alias("accepted"), F.count_if(~good).alias("rejected"), mean("confidence_score").alias("confidence"))


@query("rejection_reasons", "select source_type, string_agg(reason || '=' || n, '|' order by reason) as reasons from (select source_type, reason, count(*) as n from rejections group by 1, 2) x group by 1")
def rejection_reasons(t: Tables) -> DataFrame:
    """Each source's map of reasons to rejections, as ``reason=n`` in order."""
    counts = t.rejections.groupBy("source_type", "reason").agg(count().alias("n"))
    maps = counts.groupBy("source_type").agg(F.map_from_entries(F.collect_list(F.struct("reason", "n"))).alias("m"))
    entry = lambda x: F.concat(x["key"], F.lit("="), x["value"].cast("string"))
    return maps.select("source_type", F.array_join(F.transform(F.array_sort(F.map_entries("m")), entry), "|").alias("reasons"))


# --- window logic


@query("keep_lowest_id", "select min(id) as id, firm_id, company_name_normalized from portfolio group by 2, 3")
def keep_lowest_id(t: Tables) -> DataFrame:
    w = Window.partitionBy("firm_id", "company_name_normalized").orderBy("id")
    return t.portfolio.withColumn("r", F.row_number().over(w)).where("r = 1").select("id", "firm_id", "company_name_normalized")


_KEEPER = """row_number() over (partition by company_name_normalized order by confidence_score desc, amount_usd desc nulls last,
  (company_website is not null) desc, (coalesce(company_description, '') <> '') desc, id)"""


@query("keeper_rank", f"select id, company_name_normalized, {_KEEPER} as rank from deals")
def keeper_rank(t: Tables) -> DataFrame:
    return t.deals.select("id", "company_name_normalized", F.row_number().over(keeper_order()).cast("long").alias("rank"))


def keeper_order():
    return Window.partitionBy("company_name_normalized").orderBy(
        F.desc("confidence_score"), F.desc_nulls_last("amount_usd"), F.desc(F.col("company_website").isNotNull()),
        F.desc(F.coalesce("company_description", F.lit("")) != ""), "id")


@query("gap_fill_from_losers", f"""
select company_name_normalized, arg_min(id, r) as keeper, arg_min(amount_usd, r) filter (amount_usd is not null) as amount_usd,
  arg_min(company_website, r) filter (company_website is not null) as website,
  arg_min(company_description, r) filter (coalesce(company_description, '') <> '') as description
from (select *, {_KEEPER} as r from deals) x group by 1""")
def gap_fill_from_losers(t: Tables) -> DataFrame:
    w = keeper_order().rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    first = lambda c: F.first(c, ignorenulls=True).over(w)
    rows = t.deals.select(
        "company_name_normalized", F.row_number().over(keeper_order()).alias("r"), F.col("id").alias("keeper"), first("amount_usd").alias("amount_usd"),
        first("company_website").alias("website"), first(F.nullif("company_description", F.lit(""))).alias("description"))
    return rows.where("r = 1").drop("r")


@query("funding_history", """
select id, company_name_normalized, row_number() over w as round, lag(stage) over w as previous_stage,
  datediff('day', lag(date_announced) over w, date_announced) as days_since from (select *, count(*) over (partition by company_name_normalized) as n from deals) d
where n > 1 window w as (partition by company_name_normalized order by date_announced nulls first, id)""")
def funding_history(t: Tables) -> DataFrame:
    w = Window.partitionBy("company_name_normalized").orderBy(F.asc_nulls_first("date_announced"), "id")
    rows = t.deals.withColumn("n", F.count("*").over(Window.partitionBy("company_name_normalized"))).where("n > 1")
    return rows.select(
        "id", "company_name_normalized", F.row_number().over(w).cast("long").alias("round"), F.lag("stage").over(w).alias("previous_stage"),
        F.datediff("date_announced", F.lag("date_announced").over(w)).cast("long").alias("days_since"))


@query("most_linked_keeper", """
select name, firm_id, id as keeper from (select i.*, row_number() over (partition by name, firm_id order by coalesce(n, 0) desc, id) as r from investors i
  left join (select investor_id, count(*) as n from deal_investors group by 1) l on l.investor_id = i.id) x where r = 1""")
def most_linked_keeper(t: Tables) -> DataFrame:
    links = t.deal_investors.groupBy(F.col("investor_id").alias("id")).agg(count().alias("n"))
    w = Window.partitionBy("name", "firm_id").orderBy(F.desc(F.coalesce("n", F.lit(0))), "id")
    rows = t.investors.join(links, "id", "left").withColumn("r", F.row_number().over(w))
    return rows.where("r = 1").select("name", "firm_id", F.col("id").alias("keeper"))


@query("period_over_period", f"""
select month, deals, lag(deals) over (order by month) as before, round(100.0::double * (deals - lag(deals) over (order by month)) / greatest(lag(deals) over (order by month), 1), 2) as change
from (select strftime(date_announced, '%Y-%m') as month, count(*) as deals from deals where date_announced is not null group by 1) m""")
def period_over_period(t: Tables) -> DataFrame:
    """Month against month. The window has no partition, but runs over one row a month."""
    w = Window.orderBy("month")
    before = F.lag("deals").over(w)
    months = by_month(t).select("month", "deals")
    return months.select("month", "deals", before.alias("before"), F.round(F.lit(100.0) * (F.col("deals") - before) / F.greatest(before, F.lit(1)), 2).alias("change"))


def first_of(rows: DataFrame, key: str, arrival: list[Column]) -> DataFrame:
    """The first row of each ``key`` in order of ``arrival``; rows with an empty key all stay."""
    empty = F.coalesce(F.col(key), F.lit("")) == ""
    first = rows.where(~empty).withColumn("__r", F.row_number().over(Window.partitionBy(key).orderBy(*arrival))).where("__r = 1").drop("__r")
    return first.unionByName(rows.where(empty))


@query("first_seen", """
with n as (select *, regexp_replace(lower(split_part(title, ' raises ', 1)), '[^a-z0-9]', '', 'g') as k from articles),
  u as (select * from (select *, row_number() over (partition by url order by date_announced nulls last, id) as r from n) x where r = 1)
select id, url from (select *, row_number() over (partition by k order by date_announced nulls last, id) as q from u) y where q = 1""")
def first_seen(t: Tables) -> DataFrame:
    """Articles by url and then by the company that they name, in order of arrival."""
    from quarry.operators.extraction import company_from_title

    arrival = [F.asc_nulls_last("date_announced"), F.asc("id")]
    rows = first_of(t.articles.select("id", "url", "title", "date_announced"), "url", arrival)
    return first_of(rows.withColumn("k", norm_name(company_from_title(F.col("title")))), "k", arrival).select("id", "url")
