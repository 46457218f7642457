"""Audits, merges and clean-ups over whole tables. Each gives the new rows or the change set; writing is a step apart."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.functions import rules as R
from quarry.functions.measures import count
from quarry.operators.gates import _BANDS, _LEVEL, _VALID, named, valid_portfolio_name, valid_sql
from quarry.operators.linking import fuzzy_name_join
from quarry.operators.upkeep import cascade_delete, repoint
from quarry.plans.registry import query
from quarry.sources.staging import written
from quarry.sources.tables import Tables, norm_name


#: Days of a date band: dates of one round lie in a band or in neighbouring ones. Bands of deals without a date.
BAND, NO_BAND = R.DAYS_APART + 1, -(10**6)
#: Deals of a company that are clustered as one array at most.
FOLDED = 2000


def _fits(similar: Column, close: Column, stages: Column) -> Column:
    return (R.yes(similar) & ~R.no(close)) | (R.yes(close) & similar.isNull()) | (similar.isNull() & ~R.no(close) & stages)


def _meetings(rows: DataFrame, leads: DataFrame) -> DataFrame:
    """(``id``, ``lead_id``) of rows with the leads of smaller id that they fit; leads are few in each date band.

    A dated row meets the leads of its own and the neighbouring bands and those without a date, one without a date all.
    """
    c = F.col
    right = leads.select(c("id").alias("lead_id"), c("name"), F.coalesce("band", F.lit(NO_BAND)).alias("probe"), c("stage").alias("s2"), c("amount_usd").alias("a2"), c("date_announced").alias("d2"))
    fits = (c("lead_id") < c("id")) & _fits(R.amounts_similar(c("amount_usd"), c("a2")), R.dates_close(c("date_announced"), c("d2")), R.same_stage(c("stage"), c("s2")))
    dated = rows.where("band is not null").withColumn("probe", F.explode(F.array(c("band") - 1, c("band"), c("band") + 1, F.lit(NO_BAND))))
    near = dated.join(right.hint("merge"), ["name", "probe"]).where(fits).select("id", "lead_id")
    return near.unionByName(rows.where("band is null").join(right.drop("probe").hint("merge"), "name").where(fits).select("id", "lead_id"))


def round_clusters(deals: DataFrame, folded: int = FOLDED) -> DataFrame:
    """``id``, ``company_name_normalized`` and ``lead_id``, the first deal of the cluster that a deal falls into.

    Deals of a company are taken by id; each joins the first cluster whose first member it fits, else opens one.
    Companies of up to ``folded`` deals are folded as arrays; larger ones, if there are any, go by rounds of joins.
    """
    rows = written(deals.where("company_name_normalized <> ''").select("id", F.col("company_name_normalized").alias("name"), "stage", "amount_usd", "date_announced"), "rounds")
    large = written(rows.groupBy("name").agg(count().alias("n")).where(F.col("n") > folded).select("name"), "large")
    if large.isEmpty():
        return _by_fold(rows)
    few, many = (written(rows.join(large.hint("merge"), "name", how), "rounds") for how in ("left_anti", "left_semi"))
    return _by_fold(few).unionByName(_by_rounds(many))


def _by_fold(rows: DataFrame) -> DataFrame:
    """Clusters of companies with few deals: a fold over each one's deals gives the openers, the first that fits is the lead."""

    def fit(x: Column, y: Column) -> Column:
        return _fits(R.amounts_similar(x["amount_usd"], y["amount_usd"]), R.dates_close(x["date_announced"], y["date_announced"]), R.same_stage(x["stage"], y["stage"]))

    deal = F.struct("id", "stage", "amount_usd", "date_announced")
    of = rows.groupBy("name").agg(F.sort_array(F.collect_list(deal)).alias("deals"))
    opened = F.aggregate("deals", F.slice("deals", 1, 0), lambda leads, x: F.when(F.exists(leads, lambda y: F.coalesce(fit(x, y), F.lit(False))), leads).otherwise(F.array_append(leads, x)))
    led = lambda x: F.filter("leads", lambda y: (y["id"] == x["id"]) | (y["id"] < x["id"]) & fit(x, y))
    # written, so that openers are found once a company and not once a deal
    of = written(of.withColumn("leads", opened), "folds")
    out = of.select("name", F.explode(F.transform("deals", lambda x: F.struct(x["id"].alias("id"), F.get(led(x), F.lit(0))["id"].alias("lead_id")))).alias("x"))
    return out.select("x.id", F.col("name").alias("company_name_normalized"), "x.lead_id")


def _by_rounds(deals: DataFrame) -> DataFrame:
    """Clusters of companies of any size.

    A deal opens a cluster if it fits no earlier opener. Rounds find these: of each band of dates and amounts the open
    deal of least id is a candidate; those that no earlier open deal fits open clusters, and the deals that fit them are
    open no more. A round joins each deal with few candidates, so a company of any number of deals is many small joins.
    """
    c = F.col
    rows = deals.withColumns({
        "band": F.floor(F.datediff("date_announced", F.lit("1970-01-01").cast("date")) / BAND),
        "size": F.when(c("amount_usd") != 0, F.floor(F.log2(F.greatest("amount_usd", F.lit(1.0)))))})
    rows = written(rows, "rounds")
    still, openers = rows, None
    while True:
        first = F.min_by(F.struct(*rows.columns), "id").alias("x")
        candidates = written(still.groupBy("name", "band", "size").agg(first).select("x.*"), "candidates")
        # a candidate waits while an earlier open deal fits it: fitting goes both ways, so the candidates are the leads
        waits = _meetings(candidates, still)
        opened = written(candidates.join(waits.select("id").distinct().hint("merge"), "id", "left_anti"), "openers")
        openers = opened if openers is None else openers.unionByName(opened)
        covered = _meetings(still, opened).select("id").unionByName(opened.select("id")).distinct()
        still = written(still.join(covered.hint("merge"), "id", "left_anti"), "open")
        if still.isEmpty():
            break
    member = _meetings(rows, openers).groupBy("id").agg(F.min("lead_id").alias("lead_id"))
    first = openers.select("id", c("id").alias("own"))
    out = rows.join(first.hint("merge"), "id", "left").join(member.hint("merge"), "id", "left")
    return out.select("id", c("name").alias("company_name_normalized"), F.coalesce("own", "lead_id").alias("lead_id"))


def merge_duplicates(deals: DataFrame, deal_firms: DataFrame, deal_investors: DataFrame, deal_metadata: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """The four tables with one deal for each cluster: gaps filled, links moved to it, metadata of the others removed."""
    found = deals.join(round_clusters(deals).select("id", "lead_id").hint("merge"), "id", "left").withColumn("lead_id", F.coalesce("lead_id", "id"))
    order = [F.desc("confidence_score"), F.desc_nulls_last("amount_usd"), F.desc(F.col("company_website").isNotNull()), F.desc(F.coalesce("company_description", F.lit("")) != ""), F.asc("id")]
    w = Window.partitionBy("lead_id").orderBy(*order)
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    first = lambda c: F.first(c, ignorenulls=True).over(whole)
    ranked = found.select(
        *[c for c in deals.columns if c not in ("amount_usd", "company_website", "company_description")], F.row_number().over(w).alias("n"), F.first("id").over(whole).alias("keeper"),
        first("amount_usd").alias("amount_usd"), first("company_website").alias("company_website"), first(F.nullif("company_description", F.lit(""))).alias("company_description"))
    ranked = written(ranked, "ranked")
    mapping = ranked.where("n > 1").select(F.col("id").alias("old"), F.col("keeper").alias("new"))
    firms = repoint(deal_firms, mapping, "deal_id", ["deal_id", "firm_id"], F.col("role"))
    people = repoint(deal_investors, mapping, "deal_id", ["deal_id", "investor_id"], F.col("investor_id"))
    facts = deal_metadata.join(mapping.select(F.col("old").alias("deal_id")), "deal_id", "left_anti")
    return ranked.where("n = 1").drop("n", "keeper"), firms, people, facts


_FOLD = """
with recursive d as (
  select id, company_name_normalized as name, stage as s, amount_usd as a, date_announced as t, row_number() over (partition by company_name_normalized order by id) as k from deals where company_name_normalized <> ''),
f as (
  select name, k, id, id as lead, [{'id': id, 's': s, 'a': a, 't': t}] as leads from d where k = 1
  union all
  select name, k, id, coalesce(hit[1].id, id), case when len(hit) > 0 then leads else list_append(leads, {'id': id, 's': s, 'a': a, 't': t}) end
  from (select f.leads, d.*, list_filter(list_filter(f.leads, lambda x: x.s is not null), lambda x:
      d.a is not null and x.a is not null and greatest(d.a, x.a) / greatest(least(d.a, x.a), 1) <= 2 and coalesce(abs(datediff('day', d.t, x.t)) <= 180, true)
      or coalesce(abs(datediff('day', d.t, x.t)) <= 180, false) and (d.a is null or x.a is null)
      or (d.a is null or x.a is null) and coalesce(abs(datediff('day', d.t, x.t)) <= 180, true) and (d.s = x.s or d.s = 'Unknown' or x.s = 'Unknown')) as hit
    from f join d on d.name = f.name and d.k = f.k + 1)),
r as (
  select d.*, f.lead, row_number() over (partition by f.lead order by confidence_score desc, amount_usd desc nulls last, company_website is not null desc, coalesce(company_description, '') <> '' desc, d.id) as n
  from deals d join f on f.id = d.id),
kept as (select id as loser, first_value(id) over (partition by lead order by n) as keeper from r)"""


@query("round_clusters", _FOLD + " select id, name as company_name_normalized, lead as lead_id from f")
def _round_clusters(t: Tables) -> DataFrame:
    return round_clusters(t.deals)


def _merged(t: Tables) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    deals = t.deals.select("id", "company_name_normalized", "stage", "amount_usd", "date_announced", "confidence_score", "company_website", "company_description")
    return merge_duplicates(deals, t.deal_firms, t.deal_investors, t.deal_metadata)


@query("merge_duplicate_deals", _FOLD + """
select arg_min(id, n) as id, any_value(company_name_normalized) as company_name_normalized, arg_min(amount_usd, n) filter (amount_usd is not null) as amount_usd,
  arg_min(company_website, n) filter (company_website is not null) as company_website, arg_min(company_description, n) filter (company_description <> '') as company_description from r group by lead""")
def merge_duplicate_deals(t: Tables) -> DataFrame:
    return _merged(t)[0].select("id", "company_name_normalized", "amount_usd", "company_website", "company_description")


@query("merge_deal_investors", _FOLD + " select distinct keeper as deal_id, investor_id from deal_investors join kept on loser = deal_id")
def merge_deal_investors(t: Tables) -> DataFrame:
    return _merged(t)[2]


@query("merge_deal_metadata", _FOLD + " select deal_id, key, value from deal_metadata where deal_id in (select keeper from kept)")
def merge_deal_metadata(t: Tables) -> DataFrame:
    return _merged(t)[3]


@query("merge_keeps_firms", "select count(distinct firm_id) as firms from deal_firms")
def merge_keeps_firms(t: Tables) -> DataFrame:
    """Merging moves links and loses no firm."""
    return _merged(t)[1].agg(F.countDistinct("firm_id").alias("firms"))


_AUDIT = f"""
select 'low_confidence' as issue, id, source_type as detail from deals where confidence_score < 0.5
union all select 'missing_critical', id, stage from deals where amount_usd is null and stage = 'Unknown'
union all select 'stage_amount_mismatch', id, {_BANDS} from deals where amount_usd is not null and stage <> 'Unknown' and abs({_LEVEL.format('stage')} - {_LEVEL.format(f'({_BANDS})')}) >= 2
union all select 'duplicate_company', min(id), company_name_normalized from deals group by company_name_normalized
  having count(*) > 1 and count(distinct stage) = 1 and count(distinct coalesce(cast(date_announced as varchar), '?')) = 1
union all select 'bad_name', id, name from ({_VALID}) where not valid"""


@query("audit_deals", _AUDIT)
def audit_deals(t: Tables) -> DataFrame:
    """Deals, under names of many kinds, that have something against them, a row for each issue."""
    d = named(t.deals)
    expected = R.stage_from_amount(F.col("amount_usd"))
    level = lambda c: F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in R.STAGE_LEVEL.items() for x in kv]), c), F.lit(-1))
    low = d.where("confidence_score < 0.5").select(F.lit("low_confidence").alias("issue"), "id", F.col("source_type").alias("detail"))
    missing = d.where("amount_usd is null and stage = 'Unknown'").select(F.lit("missing_critical").alias("issue"), "id", F.col("stage").alias("detail"))
    off = d.where("amount_usd is not null and stage <> 'Unknown'").withColumn("e", expected).where(F.abs(level(F.col("stage")) - level(F.col("e"))) >= 2)
    off = off.select(F.lit("stage_amount_mismatch").alias("issue"), "id", F.col("e").alias("detail"))
    bad = d.where(~R.valid_company_name(F.col("company_name"))).select(F.lit("bad_name").alias("issue"), "id", F.col("company_name").alias("detail"))
    same = d.groupBy(F.col("company_name_normalized").alias("detail")).agg(
        F.min("id").alias("id"), count().alias("n"), F.countDistinct("stage").alias("s"), F.countDistinct(F.coalesce(F.col("date_announced").cast("string"), F.lit("?"))).alias("days"))
    same = same.where("n > 1 and s = 1 and days = 1").select(F.lit("duplicate_company").alias("issue"), "id", "detail")
    return low.unionByName(missing).unionByName(off).unionByName(bad).unionByName(same)


@query("audit_health", f"select (select count(*) from deals) as deals, count(*) as issues, round(1 - count(*)::double / greatest((select count(*) from deals), 1), 2) as health from ({_AUDIT})")
def audit_health(t: Tables) -> DataFrame:
    n = t.deals.agg(count().alias("deals"))
    out = audit_deals(t).agg(count().alias("issues")).crossJoin(F.broadcast(n))
    return out.select("deals", "issues", F.round(1 - F.col("issues") / F.greatest("deals", F.lit(1)), 2).alias("health"))


@query("audit_portfolio", "select 'duplicate' as issue, min(id) as id from portfolio group by firm_id, company_name_normalized having count(*) > 1 union all select 'orphan', id from portfolio where firm_id not in (select id from firms) union all select 'too_long', id from portfolio where length(company_name) > 60")
def audit_portfolio(t: Tables) -> DataFrame:
    p = t.portfolio
    junk = p.where(~valid_portfolio_name(F.col("company_name"))).select(F.lit("junk").alias("issue"), "id")
    twice = p.groupBy("firm_id", "company_name_normalized").agg(F.min("id").alias("id"), count().alias("n")).where("n > 1").select(F.lit("duplicate").alias("issue"), "id")
    lost = p.join(t.firms.select(F.col("id").alias("firm_id")), "firm_id", "left_anti").select(F.lit("orphan").alias("issue"), "id")
    long = p.where("char_length(company_name) > 60").select(F.lit("too_long").alias("issue"), "id")
    return junk.unionByName(twice).unionByName(lost).unionByName(long)


@query("audit_firms", "select 'no_website' as issue, id from firms where website is null union all select 'orphan', id from firms where id not in (select firm_id from deal_firms)")
def audit_firms(t: Tables) -> DataFrame:
    site = t.firms.where("website is null").select(F.lit("no_website").alias("issue"), "id")
    lost = t.firms.join(t.deal_firms.select(F.col("firm_id").alias("id")), "id", "left_anti").select(F.lit("orphan").alias("issue"), "id")
    twice = t.firms.groupBy(F.translate(F.lower("name"), " .,", "").alias("k")).agg(F.min("id").alias("id"), count().alias("n")).where("n > 1").select(F.lit("duplicate").alias("issue"), "id")
    junk = t.firms.where(~R.valid_firm_name(F.col("name"))).select(F.lit("junk").alias("issue"), "id")
    return site.unionByName(lost).unionByName(twice).unionByName(junk)


# Shapes of people's names, beginnings and endings of texts that are no one's name, and whole such texts.
PERSON_SHAPES = (
    r"^[A-ZÀ-Ü][a-zà-ü'-]+\s+(?:[A-ZÀ-Ü][a-zà-ü'-]*\.?\s+){0,2}[A-ZÀ-Ü][A-Za-zà-ü'-]+(?:\s+(?:Jr|Sr|III?|IV)\.?)?$", r"^[A-Z][A-Z]+\s+[A-Z][A-Z]+$", r"^[A-Z][A-Z]\s+[A-Z][a-z]")
NO_PEOPLE = (
    "^(<UNKNOWN>|unknown|undisclosed|unnamed|various|multiple|several|angel)", r"^\d+\s+investor", r"^n/a\b", r"^-\s", r"\b(CEO|CTO|CFO|COO|VP|Director|Manager)\s*$",
    "^(Multibillion|Multi-billion|Undisclosed|Various|Several)", r"^U\.?S\.?\s+Government")
PAGE_TEXTS = (
    "What We", "Our Values", "Our Focus", "How We", "Our Startups", "Our Blog", "We Invest", "We Are", "Our Network", "Founder Catalyst", "Startup Weekend", "Meet Our", "Our Model",
    "Program Tracks", "No Results", "Privacy", "Our Advisors", "Our Culture", "View Bio", "connect$", "Info$", "Industries$", "Kauffman Fellows")
TITLES_ALONE = ("partners", "slow ventures", "managing partner", "vice president", "partner", "general partner", "principal", "associate")
_NO_ONE = f"(?i){'|'.join(NO_PEOPLE)}|^({'|'.join(PAGE_TEXTS)})"
_SHAPES = "|".join(f"(?:{x})" for x in PERSON_SHAPES)


def tidy_people(investors: DataFrame, firms: DataFrame, deal_investors: DataFrame, leads: DataFrame) -> dict[str, DataFrame]:
    """``investors``, ``deal_investors``, ``firm_links`` and ``leads`` after names and titles are put in order.

    Texts of pages and placeholders go; a name that is a known firm's in any case gives the firm its deals; other names
    that read like a firm's, or not like a person's, go. Leads (``deal_id``, ``lead_investor_id``) that went are null.
    """
    from quarry.operators.names import clean_record

    x = clean_record(F.col("name"), F.col("title"))
    rows = written(investors.withColumn("x", x).select(*[c for c in investors.columns if c not in ("name", "title")], "x.name", "x.title"), "people")
    known = firms.groupBy(F.lower("name").alias("low")).agg(F.min("id").alias("known"))
    rows = rows.withColumn("low", F.lower("name")).join(known.hint("merge"), "low", "left").drop("low")
    name = F.col("name")
    junk = (name == "") | name.rlike(_NO_ONE) | F.lower(F.trim(name)).isin(*TITLES_ALONE)
    kind = F.when(junk, "junk").when(F.col("known").isNotNull(), "firm").when(R.investor_looks_like_firm(name) | ~name.rlike(_SHAPES), "other").otherwise("person")
    rows = written(rows.withColumn("kind", kind), "people")
    people, named = rows.where("kind = 'person'").drop("kind", "known"), rows.where("kind = 'firm'").select(F.col("id").alias("investor_id"), F.col("known").alias("firm_id"))
    ids = people.select(F.col("id").alias("investor_id"))
    kept = leads.join(ids.select(F.col("investor_id").alias("lead_investor_id"), F.lit(True).alias("kept")).hint("merge"), "lead_investor_id", "left")
    return {
        "investors": people, "deal_investors": deal_investors.join(ids.hint("merge"), "investor_id", "left_semi"), "firm_links": deal_investors.join(named.hint("merge"), "investor_id").select("deal_id", "firm_id").distinct(),
        "leads": kept.select("deal_id", F.when(F.col("kept"), F.col("lead_investor_id")).alias("lead_investor_id"))}


def _said_people(t: Tables) -> DataFrame:
    k, n = F.col("id") % 8, F.initcap("name")
    said = (
        F.when(k == 0, F.concat(n, F.lit(", PhD"))).when(k == 1, F.concat(F.lit("SUPPLIER#00000000"), (F.col("id") % 10).cast("string"))).when(k == 2, F.concat(n, F.lit(" Capital"))).when(k == 3, "undisclosed")
        .when(k == 4, F.replace(n, F.lit(" "), F.lit("   "))).when(k == 5, F.concat(n, F.lit("Managing Director"))).when(k == 6, "View Bio").otherwise(F.col("name")))
    return t.investors.withColumn("name", said).withColumn("title", F.when(k == 5, "").otherwise(F.col("title")))


_PEOPLE = f"""
with n as (select id, firm_id, name as own, case when id % 8 = 5 then 'Managing Director' else title end as title, array_to_string(list_transform(string_split(name, ' '), lambda w: upper(w[1]) || w[2:]), ' ') as n from investors),
s as (select *, case id % 8 when 1 then 'SUPPLIER#00000000' || (id % 10) when 2 then n || ' Capital' when 3 then 'undisclosed' when 6 then 'View Bio' when 7 then own else n end as name from n),
k as (
  select s.*, f.known, case when name = '' or regexp_matches(name, '{_NO_ONE.replace(chr(39), chr(39) * 2)}') then 'junk' when f.known is not null then 'firm'
    when id % 8 in (2, 7) or regexp_matches(lower(name), '{"|".join(R.INVESTOR_FIRM_WORDS)}') or not contains(name, ' ') or not regexp_matches(name, '{_SHAPES.replace(chr(39), chr(39) * 2)}') then 'other' else 'person' end as kind
  from s left join (select lower(name) as low, min(id) as known from firms group by 1) f on f.low = lower(s.name))
"""


def _people(t: Tables) -> dict[str, DataFrame]:
    leads = t.deal_investors.groupBy("deal_id").agg(F.min("investor_id").alias("lead_investor_id"))
    return tidy_people(_said_people(t), t.firms, t.deal_investors, leads)


@query("clean_investors", _PEOPLE + "select id, name, title, firm_id from k where kind = 'person'")
def clean_investors(t: Tables) -> DataFrame:
    """People under names with credentials, blanks and titles in them, among firms, labels and placeholders."""
    return _people(t)["investors"].select("id", "name", "title", "firm_id")


@query("clean_investors_links", _PEOPLE + "select deal_id, investor_id from deal_investors where investor_id in (select id from k where kind = 'person')")
def clean_investors_links(t: Tables) -> DataFrame:
    return _people(t)["deal_investors"].select("deal_id", "investor_id")


@query("clean_investors_leads", _PEOPLE + "select deal_id, case when kind = 'person' then id end as lead_investor_id from (select deal_id, min(investor_id) as id from deal_investors group by 1) l join k using (id)")
def clean_investors_leads(t: Tables) -> DataFrame:
    """Leads of deals, null where the lead turned out to be no person."""
    return _people(t)["leads"]


@query("clean_investors_firms", _PEOPLE + "select distinct deal_id, known as firm_id from deal_investors join k on k.id = investor_id where kind = 'firm'")
def clean_investors_firms(t: Tables) -> DataFrame:
    """Links of deals to the firms that stood among people."""
    return _people(t)["firm_links"]


_RELINK = """
select i.id, min(f.id) as firm_id from investors i join firms f on contains(lower(replace('Supplier#' || lpad(cast(i.id % 120 as varchar), 9, '0') || ' lp', '#', '')), lower(replace(f.name, '#', '')))
where i.firm_id is null group by 1"""


def relinked(t: Tables) -> DataFrame:
    """People without a firm (``id``) whose employer's written name matches one (``firm_id``); the first by id wins."""
    said = norm_name(F.concat(F.lit("Supplier#"), F.lpad((F.col("id") % 120).cast("string"), 9, "0"), F.lit(" lp")))
    left = t.investors.where("firm_id is null").select(F.col("id").alias("l"), said.alias("left_name"))
    right = t.firms.select(F.col("id").alias("r"), norm_name("name").alias("right_name"))
    return fuzzy_name_join(left, right, 0.7, 5).groupBy(F.col("l").alias("id")).agg(F.min("r").alias("firm_id"))


_KEEPERS = f"""(select r.id, r.firm_id, coalesce(min(e.id), min(r.id) over (partition by i.name, r.firm_id)) as keeper from ({_RELINK}) r join investors i on i.id = r.id
  left join investors e on e.name = i.name and e.firm_id = r.firm_id group by r.id, r.firm_id, i.name)"""


@query("relink_orphans_to_firms", f"select id, firm_id, keeper from {_KEEPERS} x")
def relink_orphans_to_firms(t: Tables) -> DataFrame:
    """The firm of each person who has none, and the person to keep: one of that name at the firm, else the first such orphan."""
    rows = relinked(t).join(t.investors.select("id", "name"), "id")
    there = t.investors.where("firm_id is not null").groupBy("name", "firm_id").agg(F.min("id").alias("there"))
    first = rows.groupBy("name", "firm_id").agg(F.min("id").alias("first"))
    return rows.join(first, ["name", "firm_id"]).join(there, ["name", "firm_id"], "left").select("id", "firm_id", F.coalesce("there", "first").alias("keeper"))


@query("relinked_links", f"select distinct l.deal_id, coalesce(k.keeper, l.investor_id) as investor_id from deal_investors l left join {_KEEPERS} k on k.id = l.investor_id")
def relinked_links(t: Tables) -> DataFrame:
    """Links of deals to people after the merge of those who turn out to be one person."""
    mapping = relink_orphans_to_firms(t).where("id <> keeper").select(F.col("id").alias("old"), F.col("keeper").alias("new"))
    return repoint(t.deal_investors, mapping, "investor_id", ["deal_id", "investor_id"], F.lit(0))


@query("firm_named_investors", """
select l.deal_id, min(f.id) as firm_id from deal_investors l join investors i on i.id = l.investor_id
join firms f on lower(f.name) = case i.id % 4 when 0 then 'supplier#' || lpad(cast(i.id % 120 as varchar), 9, '0') else i.name end group by l.deal_id, f.name""")
def firm_named_investors(t: Tables) -> DataFrame:
    """Links of deals to firms in place of links to people whose name is a firm's."""
    said = F.when(F.col("id") % 4 == 0, F.concat(F.lit("SUPPLIER#"), F.lpad((F.col("id") % 120).cast("string"), 9, "0"))).otherwise(F.col("name"))
    firms = t.firms.groupBy(F.lower("name").alias("low")).agg(F.min("id").alias("firm_id"))
    people = t.investors.select(F.col("id").alias("investor_id"), F.lower(said).alias("low")).join(firms, "low")
    return t.deal_investors.join(people, "investor_id").select("deal_id", "firm_id").distinct()


@query("merge_investors", """
select i.id, k.keeper from investors i join (select name, firm_id, arg_min(id, (-coalesce(n, 0), id)) as keeper from investors x
  left join (select investor_id, count(*) as n from deal_investors group by 1) l on l.investor_id = x.id group by 1, 2) k
on k.name = i.name and k.firm_id is not distinct from i.firm_id""")
def merge_investors(t: Tables) -> DataFrame:
    """Each person's keeper: of those with one name and firm, the one with most deals."""
    links = t.deal_investors.groupBy(F.col("investor_id").alias("id")).agg(count().alias("n"))
    w = Window.partitionBy("name", "firm_id").orderBy(F.desc(F.coalesce("n", F.lit(0))), "id")
    return t.investors.join(links, "id", "left").select("id", F.first("id").over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("keeper"))


@query("merged_links", """
with k as (select i.id, k.keeper from investors i join (select name, firm_id, arg_min(id, (-coalesce(n, 0), id)) as keeper from investors x
  left join (select investor_id, count(*) as n from deal_investors group by 1) l on l.investor_id = x.id group by 1, 2) k on k.name = i.name and k.firm_id is not distinct from i.firm_id)
select distinct deal_id, keeper as investor_id from deal_investors l join k on k.id = l.investor_id""")
def merged_links(t: Tables) -> DataFrame:
    mapping = merge_investors(t).select(F.col("id").alias("investor_id"), "keeper")
    return t.deal_investors.join(mapping, "investor_id").select("deal_id", F.col("keeper").alias("investor_id")).distinct()


# Words of funds' names, by which filings are told that are no company's.
FUND_WORDS = (
    "Fund", "Feeder", "Offshore", "Holdings", "Capital Partners", r"Capital,?\s*L\.?P", "Equity Fund", "Investment Fund", "Coinvestment", "Aggregator", "Master Portfolio", "Asset Backed", "BDC",
    r"Ventures?\s+[IVXLC]+\b", r"DST\b", "REIT", r"Trust\b", r"Investors?\b", r"Partners,?\s*L\.?P", "Deep Value", "Bioventures", "Private Equity", "Public Markets", "Selector")
FUND_NAME = rf"(?i)\b({'|'.join(FUND_WORDS)})\b"
CIK, LEGAL = r"(?i)\s*\(CIK\s*\d+\)\s*$", r"(?i),?\s*(Inc\.?|LLC|L\.?P\.?|Corp\.?|Ltd\.?)$"


def tidy_deals(deals: DataFrame) -> DataFrame:
    """Deals without their filer's tag and, with it, the legal ending; bad names go, and funds' names among filings."""
    tagged = F.trim(F.regexp_replace(F.trim(F.regexp_replace("company_name", CIK, "")), LEGAL, ""))
    rows = written(deals.withColumn("company_name", F.when(F.col("company_name").contains("CIK"), tagged).otherwise(F.col("company_name"))), "tidy")
    name, filed = F.col("company_name"), F.col("source_type").isin("sec_filing", "de_filing")
    return rows.where((name != "") & ~(F.coalesce(filed, F.lit(False)) & name.rlike(FUND_NAME)) & R.valid_company_name(name) & ~R.bad_name(name))


#: What names of rendered deals end in, by turns.
_ENDS = (" Growth Fund", " Feeder", " Robotics", " Ventures IV", " REIT", " Trusted", " Capital L.P", " Investors", " Selector", " Partnership")


def _tagged(t: Tables) -> DataFrame:
    k, own = F.col("id") % 7, F.col("company_name")
    name = (
        F.when(k == 0, F.concat(own, F.element_at(F.array(*map(F.lit, _ENDS)), (F.floor(F.col("id") / 7) % len(_ENDS) + 1).cast("int")))).when(k == 1, F.concat(own, F.lit(" (CIK 0001234567)"))).when(k == 2, F.concat(own, F.lit(", Inc. (cik 12) ")))
        .when(k == 3, F.concat(F.lit("Why "), own)).when(k == 4, F.concat(own, F.lit(" LLC (CIK 7)"))).when(k == 5, F.concat(F.lit("This "), own)).otherwise(own))
    return t.deals.withColumn("company_name", name)


_CLEAN = f"""
with s as (
  select id, source_type, case id % 7 when 0 then company_name || ([{', '.join(f"'{x}'" for x in _ENDS)}])[id // 7 % {len(_ENDS)} + 1] when 1 then company_name || ' (CIK 0001234567)' when 2 then company_name || ', Inc. (cik 12) '
    when 3 then 'Why ' || company_name when 4 then company_name || ' LLC (CIK 7)' when 5 then 'This ' || company_name else company_name end as name from deals),
t as (select id, source_type, case when contains(name, 'CIK') then trim(regexp_replace(trim(regexp_replace(name, '{CIK}', '')), '{LEGAL}', '')) else name end as name from s),
v as ({valid_sql("select id, name from t")}),
kept as (select t.id, t.name from t join v using (id) where v.valid and t.name <> '' and not starts_with(t.name, 'This ') and not (source_type in ('sec_filing', 'de_filing') and regexp_matches(t.name, '{FUND_NAME}')))
"""


@query("clean_deals", _CLEAN + "select id, name from kept")
def clean_deals(t: Tables) -> DataFrame:
    """Deals under names with tags, endings, headlines and funds' words, cleaned."""
    return tidy_deals(_tagged(t)).select("id", F.col("company_name").alias("name"))


@query("clean_deals_links", _CLEAN + "select deal_id, firm_id, role from deal_firms where deal_id in (select id from kept)")
def clean_deals_links(t: Tables) -> DataFrame:
    """Links to firms without those of the deals that the clean-up removes."""
    gone = t.deals.select("id").join(clean_deals(t), "id", "left_anti")
    return cascade_delete(t.deal_firms, gone, "deal_id").select("deal_id", "firm_id", "role")


@query("clean_portfolio", "select min(id) as id, firm_id, company_name_normalized as norm from portfolio where id % 13 <> 0 group by 2, 3")
def clean_portfolio(t: Tables) -> DataFrame:
    """Junk rows out, tags off, and of rows that then share firm and name the first."""
    k = F.col("id") % 13
    said = F.when(k == 0, "Read More").when(k == 1, F.concat("company_name", F.lit(" (Acquired)"))).when(k == 2, F.concat("company_name", F.lit("ExitsFalse"))).otherwise(F.col("company_name"))
    name = F.trim(F.regexp_replace(F.regexp_replace(said, r"\((Acquired|Exited)\)", ""), r"(?i)Exits?(true|false)$", ""))
    rows = t.portfolio.withColumn("company_name", name).where(valid_portfolio_name(F.col("company_name")))
    return rows.groupBy("firm_id", norm_name("company_name").alias("norm")).agg(F.min("id").alias("id"))


def tidy_firms(firms: DataFrame, deal_firms: DataFrame, portfolio: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(firms, deal_firms, portfolio) without placeholders, operating companies, two names in one, and orphans.

    Firms whose names are equal without case, blanks, dots and commas become the one of least id; links and portfolios
    move to it, links that then collide are one. A firm that neither a deal nor a portfolio names is dropped.
    """
    rows = written(firms.where(R.valid_firm_name(F.col("name"))).withColumn("k", F.translate(F.lower("name"), " .,", "")), "firms")
    keepers = rows.groupBy("k").agg(F.min("id").alias("keeper"))
    mapping = written(rows.join(keepers.hint("merge"), "k").select(F.col("id").alias("firm_id"), "keeper"), "keepers")
    links = deal_firms.join(mapping.hint("merge"), "firm_id").groupBy("deal_id", F.col("keeper").alias("firm_id")).agg(F.min_by("role", F.struct("firm_id", "role")).alias("role"))
    held = portfolio.join(mapping.hint("merge"), "firm_id").withColumn("firm_id", F.col("keeper")).drop("keeper")
    links, held = written(links, "links"), written(held, "portfolio")
    used = links.select("firm_id").unionByName(held.select("firm_id")).distinct().withColumnRenamed("firm_id", "id")
    return rows.join(keepers.select(F.col("keeper").alias("id")).hint("merge"), "id", "left_semi").join(used.hint("merge"), "id", "left_semi").drop("k"), links, held


#: Texts in firms' names that are none, by turns.
_NO_FIRMS = ("12 investors", "1 Investor", "Multiple investors (19 total)", "<UNKNOWN>", "undisclosed backers", "Growth Equity", "Angel investors", "Various", "several angels", "N/A", "na", "Google", "Stripe")
_NO_FIRM = r"^\d+ investors?$|^multiple investors|^<unknown>|^unknown$|^undisclosed|^growth equity$|^private equity$|^angel investor|^various\b|^several\b|^n/?a$"


def _said_firms(t: Tables) -> DataFrame:
    k = F.col("id")
    none = F.element_at(F.array(*map(F.lit, _NO_FIRMS)), (F.floor(k / 9) % len(_NO_FIRMS) + 1).cast("int"))
    said = (
        F.when(k % 9 == 0, none).when(k % 9 == 1, F.concat(F.lit("Alpha Fund and Beta "), k.cast("string"))).when(k % 9 == 2, F.concat(F.lit("Ann and Bob "), F.floor(k / 18).cast("string")))
        .otherwise(F.concat(F.lit("Firm. "), F.floor(k / 2).cast("string"), F.when(k % 2 == 0, " , LP").otherwise(" lp"))))
    return t.firms.withColumn("name", said)


_FIRMS = f"""
with s as (
  select id, case id % 9 when 0 then ([{', '.join(f"'{x}'" for x in _NO_FIRMS)}])[id // 9 % {len(_NO_FIRMS)} + 1] when 1 then 'Alpha Fund and Beta ' || id when 2 then 'Ann and Bob ' || (id // 18)
    else 'Firm. ' || (id // 2) || case when id % 2 = 0 then ' , LP' else ' lp' end end as name from firms),
fine as (
  select *, replace(replace(replace(lower(name), ' ', ''), '.', ''), ',', '') as k from s where not regexp_matches(lower(name), '{_NO_FIRM}') and lower(name) not in ({', '.join(f"'{x}'" for x in R.NO_BACKERS)})
    and not (len(string_split(name, ' and ')) = 2 and len(list_filter(string_split(name, ' and '), lambda x: length(trim(x)) > 3)) = 2)),
m as (select id, min(id) over (partition by k) as keeper from fine),
links as (select deal_id, keeper as firm_id, arg_min(role, (firm_id, role)) as role from deal_firms l join m on m.id = l.firm_id group by 1, 2),
held as (select p.id, keeper as firm_id, company_name from portfolio p join m on m.id = p.firm_id)
"""


@query("clean_firms", _FIRMS + "select id, name from s where id in (select keeper from m) and (id in (select firm_id from links) or id in (select firm_id from held))")
def clean_firms(t: Tables) -> DataFrame:
    """Firms under names of many kinds, cleaned."""
    return tidy_firms(_said_firms(t), t.deal_firms, t.portfolio)[0].select("id", "name")


@query("clean_firms_links", _FIRMS + "select deal_id, firm_id, role from links")
def clean_firms_links(t: Tables) -> DataFrame:
    """Links to the firms that stay; those of merged firms are moved to the keeper, those of junk go."""
    return tidy_firms(_said_firms(t), t.deal_firms, t.portfolio)[1]


@query("clean_firms_portfolio", _FIRMS + "select id, firm_id, company_name from held")
def clean_firms_portfolio(t: Tables) -> DataFrame:
    """Portfolios of the firms that stay."""
    return tidy_firms(_said_firms(t), t.deal_firms, t.portfolio)[2].select("id", "firm_id", "company_name")


_SEGMENTS = ("AI", "Health", "Fintech", "Climate", "Media", "Real Estate", "NATION", "HR")
_SUBJECTS = ("/Enterprise", "/AI", "/Insurance", " / Cleantech", " & Entertainment", "|Odd", "", "/HR")
_LISTED = ", ".join(f"({i}, '{x}')" for i, x in enumerate(R.CANONICAL))
_MAPPED = ", ".join(f"('{a}', '{b}')" for a, b in R.COMPOSITES.items())


@query("normalize_categories", f"""
with said as (select id, list_value{_SEGMENTS}[1 + id % 8] || list_value{_SUBJECTS}[1 + (id // 8) % 8] as name from deals),
  held as (select name, arg_min(x.canon, x.i) as canon from (select distinct name from said) s join (values {_LISTED}) x(i, canon) on contains(lower(x.canon), lower(trim(split_part(s.name, '/', 1)))) group by 1)
select s.id, case when not regexp_matches(s.name, '[/|]') or s.name in (select y.canon from (values {_LISTED}) y(i, canon)) then s.name else coalesce(m.main, h.canon, 'Other') end as category
from said s left join (values {_MAPPED}) m(name, main) on m.name = s.name left join held h on h.name = s.name""")
def normalize_categories(t: Tables) -> DataFrame:
    """Deals under written categories, single and composite, with the category that each stands for."""
    pick = lambda words, n: F.get(F.array(*map(F.lit, words)), n.cast("int"))
    said = F.concat(pick(_SEGMENTS, F.col("id") % 8), pick(_SUBJECTS, F.floor(F.col("id") / 8) % 8))
    return t.deals.select("id", R.canonical_category(said).alias("category"))


@query("remove_orphans", "select id from investors where id in (select investor_id from deal_investors where deal_id % 5 = 0)")
def remove_orphans(t: Tables) -> DataFrame:
    gone = t.investors.select("id").join(t.deal_investors.where("deal_id % 5 = 0").select(F.col("investor_id").alias("id")), "id", "left_anti")
    return t.investors.select("id").join(gone, "id", "left_anti")


@query("backfill_firm_links", f"""
select distinct l.deal_id, coalesce(i.firm_id, r.firm_id) as firm_id from deal_investors l join investors i on i.id = l.investor_id left join ({_RELINK}) r on r.id = i.id
where coalesce(i.firm_id, r.firm_id) is not null and l.deal_id not in (select deal_id from deal_firms where verified = 1)""")
def backfill_firm_links(t: Tables) -> DataFrame:
    """Deals without a verified firm get the firms of their people, and for people without one the firm that matches."""
    people = t.investors.where("firm_id is not null").select("id", "firm_id").unionByName(relinked(t)).withColumnRenamed("id", "investor_id")
    rows = t.deal_investors.join(t.deal_firms.where("verified = 1").select("deal_id"), "deal_id", "left_anti")
    return rows.join(people, "investor_id").select("deal_id", "firm_id").distinct()


@query("backfill_investors", """
select d.id as deal_id, n as name from (select id, unnest(['Ann ' || (id % 9), 'Bob ' || (id % 7)]) as n from deals where id % 4 = 0) d where n not in (select 'Ann ' || x from (select unnest(range(3)) as x))""")
def backfill_investors(t: Tables) -> DataFrame:
    """People named in a deal's JSON metadata, less those already known; bad JSON names nobody."""
    k = F.col("id")
    said = F.when(k % 4 == 0, F.concat(F.lit('["Ann '), (k % 9).cast("string"), F.lit('","Bob '), (k % 7).cast("string"), F.lit('"]'))).otherwise("{broken")
    rows = t.deals.select(F.col("id").alias("deal_id"), F.explode(F.from_json(said, "array<string>")).alias("name"))
    known = t.categories.where("id < 3").select(F.concat(F.lit("Ann "), F.col("id").cast("string")).alias("name"))
    return rows.join(known.hint("merge"), "name", "left_anti").select("deal_id", "name")


@query("verify_links", """
select coalesce(l.deal_id, m.deal_id) as deal_id, coalesce(l.firm_id, m.firm_id) as firm_id, coalesce(l.role, 'participant') as role,
  case when m.deal_id is not null then 1 else l.verified end::bigint as verified
from deal_firms l full join (select distinct d.id as deal_id, p.firm_id from portfolio p join deals d on p.company_name_normalized = d.company_name_normalized) m
  on m.deal_id = l.deal_id and m.firm_id = l.firm_id""")
def verify_links(t: Tables) -> DataFrame:
    """Links that a firm's portfolio confirms are verified; confirmed links that are missing are added."""
    deals = t.deals.select(F.col("id").alias("deal_id"), "company_name_normalized")
    sure = t.portfolio.select("firm_id", "company_name_normalized").join(deals, "company_name_normalized").select("deal_id", "firm_id").distinct().withColumn("sure", F.lit(1))
    out = t.deal_firms.join(sure, ["deal_id", "firm_id"], "full_outer")
    return out.select("deal_id", "firm_id", F.coalesce("role", F.lit("participant")).alias("role"), F.when(F.col("sure") == 1, 1).otherwise(F.col("verified")).cast("long").alias("verified"))


@query("verified_confidence", """
select id, round(case when confidence_score < 0.85 then least(confidence_score + 0.15, 0.90) else confidence_score end, 2) as confidence from deals
where company_name_normalized in (select company_name_normalized from portfolio)""")
def verified_confidence(t: Tables) -> DataFrame:
    score = F.col("confidence_score")
    rows = t.deals.join(t.portfolio.select("company_name_normalized").distinct(), "company_name_normalized", "left_semi")
    return rows.select("id", F.round(F.when(score < 0.85, F.least(score + 0.15, F.lit(0.90))).otherwise(score), 2).alias("confidence"))


_SAID_PORTFOLIO = """(select id, firm_id, company_name_normalized || case id % 3 when 1 then 'x' else '' end as norm, case firm_id % 2 when 0 then 'https://p' || id end as website
  from portfolio where cast(id as varchar) not in (select value from deal_metadata where key = 'portfolio_company_id'))"""
_FIRST_DEALS = f"""(select p.id, p.firm_id, p.website, f.deal_id from {_SAID_PORTFOLIO} p join (select n.norm, min(d.deal_id) as deal_id from (select distinct norm from {_SAID_PORTFOLIO} x) n
  join (select company_name_normalized as name, min(id) as deal_id from deals group by 1) d on (contains(n.norm, d.name) or contains(d.name, n.norm))
    and least(length(n.norm), length(d.name))::double / greatest(length(n.norm), length(d.name)) >= 0.85 group by 1) f on f.norm = p.norm)"""


def first_deals(t: Tables) -> DataFrame:
    """Portfolio rows not yet linked (``id``, ``firm_id``, ``website``) with the first deal whose name is theirs, equal or nearly.

    Every third name is written with a letter more, so that the approximate match has work to do. Names meet once, however
    many rows have them.
    """
    done = t.deal_metadata.where("key = 'portfolio_company_id'").select(F.col("value").try_cast("long").alias("id"))
    norm = F.concat("company_name_normalized", F.when(F.col("id") % 3 == 1, "x").otherwise(""))
    site = F.when(F.col("firm_id") % 2 == 0, F.concat(F.lit("https://p"), F.col("id").cast("string")))
    rows = t.portfolio.join(done, "id", "left_anti").select("id", "firm_id", norm.alias("norm"), site.alias("website"))
    deals = t.deals.where("company_name_normalized <> ''").groupBy(F.col("company_name_normalized").alias("right_name")).agg(F.min("id").alias("r"))
    names = rows.where("norm <> ''").select(F.col("norm").alias("left_name")).distinct().withColumn("l", F.col("left_name"))
    found = fuzzy_name_join(names, deals, 0.85).groupBy(F.col("l").alias("norm")).agg(F.min("r").alias("deal_id"))
    return rows.join(found.hint("merge"), "norm").select("id", "firm_id", "website", "deal_id")


@query("portfolio_to_deal_fuzzy", f"select id, deal_id from {_FIRST_DEALS} x")
def portfolio_to_deal_fuzzy(t: Tables) -> DataFrame:
    return first_deals(t).select("id", "deal_id")


@query("portfolio_deal_links", f"select distinct deal_id, firm_id, 'participant' as role from {_FIRST_DEALS} x where not exists (select 1 from deal_firms l where l.deal_id = x.deal_id and l.firm_id = x.firm_id)")
def portfolio_deal_links(t: Tables) -> DataFrame:
    """Links of firms to the deals of their portfolio that are not there yet."""
    rows = first_deals(t).select("deal_id", "firm_id").distinct()
    return rows.join(t.deal_firms.select("deal_id", "firm_id"), ["deal_id", "firm_id"], "left_anti").withColumn("role", F.lit("participant"))


@query("portfolio_website_fill", f"select d.id, arg_min(x.website, x.id) as website from deals d join {_FIRST_DEALS} x on x.deal_id = d.id where d.company_website is null and x.website is not null group by 1")
def portfolio_website_fill(t: Tables) -> DataFrame:
    """Sites for deals that have none, from the first portfolio row that gives one."""
    sites = first_deals(t).where("website is not null").groupBy(F.col("deal_id").alias("id")).agg(F.min_by("website", "id").alias("website"))
    return t.deals.where("company_website is null").select("id").join(sites, "id")
