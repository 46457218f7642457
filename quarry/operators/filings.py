"""Filings as deals: full-text hits joined with their forms, resolved to a place, filtered, priced and named."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.functions import rules as R
from quarry.operators import gates as G
from quarry.plans.registry import query
from quarry.sources.staging import written
from quarry.sources.tables import Tables, norm_name

# Industries of filers that are no startups, the word of entities that are kept, persons of a filing, and
# the forms of a filing's address.
NO_INDUSTRY = ("real estate", "pooled investment fund", "banking and financial services", "investing", "insurance")
CORPORATION = "corporation"
PERSONS = 15
FOLDER, LISTING = "https://www.sec.gov/Archives/edgar/data/", "https://www.sec.gov/cgi-bin/browse-edgar?action=getcompany&CIK="
LISTING_END = "&type=D&dateb=&owner=include&count=10"


def _tidy(name: str) -> Column:
    return F.trim(F.regexp_replace(name, r"(?i)\s*\(CIK\s*\d+\)\s*$", ""))


def _city(text: Column) -> Column:
    return R.first_of(text, R.CITY_WORDS, None)


def filing_deals(hits: DataFrame, forms: DataFrame, firms: DataFrame) -> DataFrame:
    """Deals of ``hits`` (``company_name``, ``cik``, ``accession``, ``filed``, ``biz_locations``) and their ``forms``.

    ``forms``: ``accession``, ``entity_name``, ``entity_type``, ``industry``, ``address``, ``amount_sold``,
    ``total_offering``, ``indefinite``, ``investors``, ``persons`` (``array<string>``); of several of a filing the first
    by address. Of hits with one name the first counts. A filing's place is that of its form's address; one with a form
    of no known place is dropped, one without a form has the place of the first of its hit's locations that has one, or
    is dropped. Names, entities, industries and amounts that are no startup's are dropped, as are forms without any
    data and names of known firms. Gives ``accession``, ``company_name``, ``city``, ``amount_usd``, ``stage``,
    ``sector``, ``description``, ``filed``, ``source_url`` and ``persons``, fifteen at most.
    """
    c = F.col
    rows = hits.withColumn("company_name", _tidy("company_name")).where(~F.coalesce(c("company_name").rlike(G.FILING_JUNK), F.lit(True)) & (c("company_name") != ""))
    rows = rows.withColumn("norm", norm_name("company_name"))
    first = F.row_number().over(Window.partitionBy("norm").orderBy(F.asc_nulls_last("filed"), "accession"))
    rows = rows.withColumn("n", first).where("n = 1").drop("n", "norm")
    form = forms.groupBy("accession").agg(F.min_by(F.struct(*[x for x in forms.columns if x != "accession"]), F.coalesce("address", F.lit(""))).alias("form"))
    rows = written(rows.join(form.hint("merge"), "accession", "left"), "filings")
    # the first location with a place: one row for each location, then the least place in the list
    located = rows.where("form is null").select("accession", F.posexplode("biz_locations").alias("place", "location")).withColumn("city", _city(c("location"))).where("city is not null")
    located = written(located.groupBy("accession").agg(F.min_by("city", "place").alias("located")), "located")
    rows = rows.join(located.hint("merge"), "accession", "left").withColumn("city", F.when(c("form").isNotNull(), _city(c("form.address"))).otherwise(c("located"))).where("city is not null")
    amount = F.coalesce(F.nullif("form.amount_sold", F.lit(0.0)), F.nullif("form.total_offering", F.lit(0.0)))
    name = F.coalesce(F.nullif(_tidy("form.entity_name"), F.lit("")), c("company_name"))
    industry = F.trim(F.coalesce("form.industry", F.lit("")))
    rows = written(rows.select(
        "accession", "cik", name.alias("company_name"), "city", amount.alias("amount_usd"), industry.alias("industry"), F.trim(F.coalesce("form.entity_type", F.lit(""))).alias("entity"), "filed",
        (c("form").isNotNull() & amount.isNull() & ~F.coalesce("form.indefinite", F.lit(False)) & (industry == "") & c("form.investors").isNull() & (F.trim(F.coalesce("form.address", F.lit(""))) == "")).alias("bare"),
        F.slice(F.coalesce("form.persons", F.array().cast("array<string>")), 1, PERSONS).alias("persons"), c("form").isNotNull().alias("has_form")), "filings")
    rows = rows.where(~c("company_name").rlike(G.FILING_JUNK) & ((c("entity") == "") | F.lower("entity").contains(CORPORATION)) & ~F.lower("industry").isin(*NO_INDUSTRY) & ~c("bare"))
    rows = rows.where(R.valid_amount(c("amount_usd"), R.stage_from_amount(c("amount_usd"))))
    known = firms.select(norm_name("name").alias("norm")).where("norm <> ''").distinct()
    # a filing without a form is let through on its name
    rows = rows.withColumn("norm", F.when(c("has_form"), norm_name("company_name"))).join(known.hint("merge"), "norm", "left_anti")
    folder = F.concat(F.lit(FOLDER), "cik", F.lit("/"), F.replace("accession", F.lit("-"), F.lit("")), F.lit("/"))
    url = F.coalesce(folder, F.concat(F.lit(LISTING), F.coalesce("cik", F.lit("")), F.lit(LISTING_END)))
    return rows.select(
        "accession", "company_name", "city", "amount_usd", R.stage_from_amount(c("amount_usd")).alias("stage"), R.classify_sector(F.concat_ws(" ", "company_name", "industry")).alias("sector"),
        F.when(c("industry") != "", F.concat("industry", F.lit(" company"))).alias("description"), "filed", url.alias("source_url"), "persons")


# Values by turns of rendered filings.
_INDUSTRIES = ("Biotechnology", "Pooled Investment Fund", "Other Technology", "Restaurants", "", "Insurance", "Computers")
_ENTITIES = ("Corporation", "Limited Partnership", "", "Business corporation", "Limited Liability Company")
_ADDRESSES = ("1 Main St, Brooklyn, NY", "5 Elm St, Omaha, NE", "9 Hill Rd, Palo Alto, CA", "2 Sea St, Cambridge, MA", "7 M St, Washington, D.C.")
_TAGS = ("", " (CIK 0000012345)", " Fund II", " (cik 7) ", "", " Trust")


def _turn(listed: tuple[str, ...], by: int) -> Column:
    return F.element_at(F.array(*map(F.lit, listed)), (F.floor(F.col("id") / by) % len(listed) + 1).cast("int"))


def filed_hits(t: Tables) -> DataFrame:
    """Deals as hits of a full-text search, names tagged, with one to three locations."""
    name = F.concat(F.when(F.col("id") % 10 == 7, F.concat(F.lit("Supplier#"), F.lpad((F.col("id") % 90).cast("string"), 9, "0"))).otherwise(F.concat("company_name", F.lit(" no. "), (F.col("id") % 50).cast("string"))), _turn(_TAGS, 1))
    places = F.slice(F.array(_turn(_ADDRESSES, 1), _turn(_ADDRESSES, 2), _turn(_ADDRESSES, 3)), F.lit(1), (F.col("id") % 3 + 1).cast("int"))
    return t.deals.select(
        name.alias("company_name"), F.when(F.col("id") % 9 != 0, F.col("id").cast("string")).alias("cik"), F.concat(F.lit("00-"), F.col("id").cast("string")).alias("accession"), F.col("date_announced").alias("filed"), places.alias("biz_locations"))


def filed_forms(t: Tables) -> DataFrame:
    """Forms of two in three of them."""
    k = F.col("id")
    persons = F.transform(F.sequence(F.lit(1), (k % 20 + 1).cast("int")), lambda i: F.concat(F.lit("Person "), i.cast("string")))
    return t.deals.where("id % 3 <> 0").select(
        F.concat(F.lit("00-"), k.cast("string")).alias("accession"), F.when(k % 4 == 0, F.concat(F.lit("Named "), "company_name", F.lit(" "), (k % 50).cast("string"))).otherwise("").alias("entity_name"), _turn(_ENTITIES, 1).alias("entity_type"),
        _turn(_INDUSTRIES, 2).alias("industry"), _turn(_ADDRESSES, 3).alias("address"), F.when(k % 6 == 1, 0.0).otherwise(F.col("amount_usd")).alias("amount_sold"), F.when(k % 2 == 0, F.lit(3e6)).when(k % 11 == 1, F.lit(2e10)).alias("total_offering"),
        (k % 8 == 0).alias("indefinite"), F.when(k % 5 == 0, F.lit("12")).alias("investors"), persons.alias("persons"))


def _pick(listed: tuple[str, ...], by: int) -> str:
    return f"([{', '.join(chr(39) + x + chr(39) for x in listed)}])[id // {by} % {len(listed)} + 1]"


_CITY = G._first_sql("lower({0})", R.CITY_WORDS, "null")
_TIDY = "trim(regexp_replace({0}, '(?i)\\s*\\(CIK\\s*\\d+\\)\\s*$', ''))"
_FILED = f"""
with h as (
  select id, {_TIDY.format(f"case when id % 10 = 7 then 'Supplier#' || lpad(cast(id % 90 as varchar), 9, '0') else company_name || ' no. ' || (id % 50) end || {_pick(_TAGS, 1)}")} as name,
    case when id % 9 <> 0 then cast(id as varchar) end as cik, '00-' || id as accession, date_announced as filed, ([{_pick(_ADDRESSES, 1)}, {_pick(_ADDRESSES, 2)}, {_pick(_ADDRESSES, 3)}])[1:id % 3 + 1] as places,
    company_name, amount_usd as given from deals),
seen as (
  select * from (select *, row_number() over (partition by regexp_replace(lower(name), '[^a-z0-9]', '', 'g') order by filed nulls last, accession) as n from h where not regexp_matches(name, '{G.FILING_JUNK}')) where n = 1),
f as (
  select *, id % 3 <> 0 as form, case when id % 3 <> 0 then {_pick(_ADDRESSES, 3)} end as address, case when id % 3 <> 0 then {_pick(_INDUSTRIES, 2)} else '' end as industry, case when id % 3 <> 0 then {_pick(_ENTITIES, 1)} else '' end as entity,
    case when id % 3 <> 0 and id % 4 = 0 then 'Named ' || company_name || ' ' || (id % 50) else name end as called,
    case when id % 3 <> 0 then coalesce(case when id % 6 <> 1 then nullif(given, 0) end, case when id % 2 = 0 then 3e6 when id % 11 = 1 then 2e10 end) end as amount_usd from seen),
p as (
  select *, case when form then {_CITY.format('address')} else list_filter(list_transform(places, lambda x: {_CITY.format('x')}), lambda y: y is not null)[1] end as city, lower(called || ' ' || industry) as text from f),
kept as (
  select *, {G._BANDS} as stage from p where city is not null and not regexp_matches(called, '{G.FILING_JUNK}') and (entity = '' or contains(lower(entity), 'corporation'))
    and lower(industry) not in ({', '.join(f"'{x}'" for x in NO_INDUSTRY)}) and (not form or regexp_replace(lower(called), '[^a-z0-9]', '', 'g') not in (select regexp_replace(lower(name), '[^a-z0-9]', '', 'g') from firms))),
priced as (select * from kept where amount_usd is null or amount_usd > 0 and amount_usd <= {R.GLOBAL_CAP} and amount_usd <= {G._CAP}),
sectors as (select id, {G._PICK} as sector from (select id, {G._SCORES} from priced))
"""


@query("filings_to_deals", _FILED + f"""
select accession, called as company_name, city, amount_usd, stage, sector, case when industry <> '' then industry || ' company' end as description, filed,
  case when cik is null then '{LISTING}{LISTING_END}' else '{FOLDER}' || cik || '/' || replace(accession, '-', '') || '/' end as source_url,
  case when form then least(id % 20 + 1, {PERSONS}) else 0 end as persons from priced join sectors using (id)""")
def filings_to_deals(t: Tables) -> DataFrame:
    """Deals of filings with and without forms."""
    return filing_deals(filed_hits(t), filed_forms(t), t.firms).withColumn("persons", F.size("persons").cast("long"))


@query("filing_persons", _FILED + f"select accession, 'Person ' || unnest(generate_series(1, least(id % 20 + 1, {PERSONS}))) as name from priced where form")
def filing_persons(t: Tables) -> DataFrame:
    """People that forms name, fifteen of a filing."""
    return filing_deals(filed_hits(t), filed_forms(t), t.firms).select("accession", F.explode("persons").alias("name"))
