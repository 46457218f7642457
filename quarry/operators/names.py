"""Rules on single names and urls, each as a query over names as they might be written, and what builds on them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.functions import portfolio as P
from quarry.functions import rules as R
from quarry.functions.words import let
from quarry.operators import enrichment as E
from quarry.operators.enrichment import classify_mentions
from quarry.operators.extraction import clean_investor, parse_investors, valid_investor
from quarry.operators.gates import FILING_JUNK
from quarry.operators.upkeep import read_snapshot, write_snapshot
from quarry.plans.registry import query
from quarry.sources.staging import shared_root
from quarry.sources.tables import Tables

# Sites that are no company's own, folders of profiles on any site, and endings of firms' names.
NOT_OWN = (
    "linkedin.com", "crunchbase.com", "pitchbook.com", "techcrunch.com", "bloomberg.com", "reuters.com", "wsj.com", "nytimes.com", "wikipedia.org", "wikidata.org",
    "facebook.com", "twitter.com", "x.com", "instagram.com", "youtube.com", "tiktok.com", "github.com", "glassdoor.com", "indeed.com", "yelp.com", "bbb.org",
    "sec.gov", "dnb.com", "zoominfo.com", "apollo.io", "similarweb.com", "owler.com", "tracxn.com", "angel.co", "wellfound.com", "f6s.com", "dealroom.co")
PROFILES = ("company", "org", "profile", "people", "in", "pub", "user", "biz")
VC_END = r"(?:Capital|Ventures|Partners|Fund|Equity|Holdings|Labs|VC)"


def norm_match(c: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), r"[^a-z0-9\s]", ""))


@query("norm_match", r"select id, trim(regexp_replace(lower(coalesce(company_name, '')), '[^a-z0-9\s]', '', 'g')) as norm from portfolio")
def _norm_match(t: Tables) -> DataFrame:
    return t.portfolio.select("id", norm_match(F.col("company_name")).alias("norm"))


@query("bad_name_pattern", "select id, id % 6 in (0, 1, 2, 3) as bad from deals")
def bad_name_pattern(t: Tables) -> DataFrame:
    k = F.col("id") % 6
    name = F.when(k == 0, F.concat(F.lit("This "), "company_name")).when(k == 1, F.concat("company_name", F.lit(" platform"))).when(k == 2, F.concat("company_name", F.lit(" raised"))).when(k == 3, F.concat(F.lit("Top "), "company_name"))
    return t.deals.select("id", R.bad_name(F.coalesce(name, F.col("company_name"))).alias("bad"))


def _written(t: Tables) -> Column:
    k = F.col("id") % 6
    return (
        F.when(k == 0, F.concat(F.lit("existing investors "), F.initcap("name"), F.lit(";"))).when(k == 1, F.concat(F.lit("as well as new investor "), F.initcap("name")))
        .when(k == 2, F.concat(F.lit("Boston-based "), F.initcap("name"))).when(k == 3, F.concat(F.initcap("name"), F.lit(" also participating in it"))).when(k == 4, F.concat(F.initcap("name"), F.lit(" and"))).otherwise(F.initcap("name")))


_INIT = "(select id, upper(a[1]) || substr(a, 2) || ' ' || upper(b[1]) || substr(b, 2) as n from (select id, split_part(name, ' ', 1) as a, split_part(name, ' ', 2) as b from investors))"


@query("clean_investor_name", f"select id, n as name from {_INIT}")
def clean_investor_name(t: Tables) -> DataFrame:
    return t.investors.select("id", clean_investor(_written(t)).alias("name"))


@query("valid_investor_name", r"select id, id % 4 = 0 and not regexp_matches(name, '\b(new|other)\b') as valid from investors")
def valid_investor_name(t: Tables) -> DataFrame:
    k = F.col("id") % 4
    name = F.when(k == 0, F.initcap("name")).when(k == 1, F.col("name")).when(k == 2, F.concat(F.initcap("name"), F.lit(" (")))
    return t.investors.select("id", valid_investor(F.coalesce(name, F.concat(F.initcap("name"), F.lit(" who led the round")))).alias("valid"))


@query("investor_candidates", f"""
select distinct id, name from ({E.candidates_sql(E.TEXTS_SQL)})""")
def investor_candidates(t: Tables) -> DataFrame:
    """Names after eight phrases in texts of news."""
    return E.investor_candidates(E.backer_texts(t))


_WRITTEN_INVESTORS = f"""(select id, case id % 9 when 0 then n || ' Partners' when 1 then n when 2 then 'ABC ' || n when 3 then '37 ' || n when 4 then lower(n) when 5 then upper(n)
  when 6 then split_part(n, ' ', 1) when 7 then n || ' (NY)' else 'DJ ' || n end as s from {_INIT} x)"""


@query("investor_looks_like_firm", rf"""
select id, regexp_matches(lower(s), '{"|".join(R.INVESTOR_FIRM_WORDS)}') or lower(s) in ({", ".join(f"'{x}'" for x in R.FIRMS_LIKE_PEOPLE)}) or regexp_matches(s, '^[A-Z][^ ]{{2,}}$')
  or regexp_matches(s, '^[0-9a-z]') or contains(s, '(') or (regexp_matches(s, '^[A-Z]{{2,}}( |$)') and not regexp_matches(s, '^([A-Z]{{2,}} [A-Z]{{2,}}$|[A-Z]{{2}} [A-Z][a-z])')) as firm from {_WRITTEN_INVESTORS} y""")
def investor_looks_like_firm(t: Tables) -> DataFrame:
    """The rule over names as firms and people write them: with a firm's word, initials, digits, small or capital letters."""
    name, k = F.initcap("name"), F.col("id") % 9
    said = (
        F.when(k == 0, F.concat(name, F.lit(" Partners"))).when(k == 1, name).when(k == 2, F.concat(F.lit("ABC "), name)).when(k == 3, F.concat(F.lit("37 "), name)).when(k == 4, F.lower(name))
        .when(k == 5, F.upper(name)).when(k == 6, F.split(name, " ")[0]).when(k == 7, F.concat(name, F.lit(" (NY)"))).otherwise(F.concat(F.lit("DJ "), name)))
    return t.investors.select("id", R.investor_looks_like_firm(said).alias("firm"))


@query("valid_portfolio_name", P.judged_sql(P.listed_sql()) + "select id, name, valid from judged")
def valid_portfolio_name(t: Tables) -> DataFrame:
    """The rule over names as pages list them: companies, labels, glued categories, places, sentences."""
    return P.listed(t.portfolio).select("id", "name", P.is_company_name(F.col("name")).alias("valid"))


#: What filing names may hold besides the company, by turns.
_FILED = (" Growth Fund", " L.P.", " REIT", " Holdings Inc.", "/ADR", " Robotics", " Series III", " Trustworthy AI", " PLC", " Real Estate", " Corporation for Blank Check", " Partnership", " Funding")


@query("is_junk_filing_name", f"""
select id, name, regexp_matches(trim(name), '{FILING_JUNK}') as junk from (
  select id, case when id % 7 = 0 then (id % 90) || '-' || id || ' Main St ' else '' end || company_name || ([{", ".join(f"'{x}'" for x in _FILED)}])[id % {len(_FILED)} + 1] as name from deals)""")
def is_junk_filing_name(t: Tables) -> DataFrame:
    id_ = F.col("id")
    street = F.when(id_ % 7 == 0, F.concat((id_ % 90).cast("string"), F.lit("-"), id_.cast("string"), F.lit(" Main St "))).otherwise("")
    name = F.concat(street, "company_name", F.element_at(F.array(*map(F.lit, _FILED)), (id_ % len(_FILED) + 1).cast("int")))
    return t.deals.select("id", name.alias("name")).withColumn("junk", F.trim("name").rlike(FILING_JUNK))


@query("clean_filing_name", "select id, company_name as name from deals where source_type in ('sec_filing', 'de_filing')")
def clean_filing_name(t: Tables) -> DataFrame:
    """Filers without their CIK tag; Delaware filers without the legal ending too."""
    said = F.concat("company_name", F.when(F.col("source_type") == "de_filing", ", Inc.").otherwise(" (CIK 0000123)"))
    bare = F.trim(F.regexp_replace(said, r"(?i)\s*\(CIK\s+\d+\)", ""))
    out = F.when(F.col("source_type") == "de_filing", R.without_legal_ending(bare)).otherwise(bare)
    return t.deals.where("source_type in ('sec_filing', 'de_filing')").select("id", out.alias("name"))


def is_blocked_url(c: Column) -> Column:
    """Profiles and press sites, with their subdomains, and profile folders of any site are no company's own site.

    Urls without a host are blocked as well; null stays open.
    """
    host = F.lower(F.try_parse_url(c, F.lit("HOST")))
    listed = F.exists(F.array(*map(F.lit, NOT_OWN)), lambda d: (host == d) | F.endswith(host, F.concat(F.lit("."), d)))
    folders = F.split(F.lower(F.coalesce(F.try_parse_url(c, F.lit("PATH")), F.lit(""))), "/")
    profile = F.arrays_overlap(F.slice(folders, 1, F.greatest(F.size(folders) - 1, F.lit(0))), F.array(*map(F.lit, PROFILES)))
    return F.when(c.isNull(), F.lit(False)).otherwise(F.coalesce(listed | profile, F.lit(True)))


@query("is_blocked_url", "select id, id % 4 in (0, 1) as blocked from deals where company_website is not null")
def _is_blocked_url(t: Tables) -> DataFrame:
    k = F.col("id") % 4
    url = F.when(k == 0, "https://www.linkedin.com/company/a").when(k == 1, "http://en.wikipedia.org/wiki/A").when(k == 2, "https://notx.com.example.org")
    return t.deals.where("company_website is not null").select("id", is_blocked_url(F.coalesce(url, F.col("company_website"))).alias("blocked"))


# Ranks and grades in titles of people at firms.
RANKS = ("Partner", "Director", "Principal", "Associate", "Analyst", "Founder", "Co-Founder", "VP")
GRADES = ("Managing", "General", "Operating", "Venture", "Senior", "Investment")


def clean_record(name: Column, title: Column) -> Column:
    """A struct of a person's ``name`` and ``title`` with what stuck to either in its place.

    Runs of blanks become one, credentials go, a title glued to the last name moves to an empty title, and the person's
    name goes from the ends of the title. Leftovers of page layout at the end of a title are cut off. Null names are empty.
    """

    def tidy(c: Column) -> Column:
        return F.trim(F.regexp_replace(F.replace(c, F.lit("&amp;"), F.lit("&")), r"\s+", " "))

    def parted(bare: Column) -> Column:
        glued = F.regexp_extract(bare, rf"^.*?[a-z]{{2}}((?:(?:{'|'.join(GRADES)}) )?(?:{'|'.join(RANKS)})\b.*)$", 1)
        own = F.trim(F.substring(bare, F.lit(1), F.char_length(bare) - F.char_length(glued)))
        return F.struct(own.alias("name"), glued.alias("glued"))

    def told(x: Column) -> Column:
        own = x["name"]
        given = F.when(F.coalesce(title, F.lit("")) == "", x["glued"]).otherwise(tidy(title))
        twice = F.aggregate(F.sequence(F.lit(1), F.lit(2)), given, lambda s, _: F.when((own != "") & F.startswith(s, own), F.trim(F.substring(s, F.char_length(own) + 1, F.char_length(s)))).otherwise(s))
        ended = F.when((own != "") & F.endswith(twice, own), F.trim(F.substring(twice, F.lit(1), F.char_length(twice) - F.char_length(own)))).otherwise(twice)
        cut = F.trim(F.split_part(F.regexp_replace(ended, "ExperienceEducation$", ""), F.lit("Bio & More"), F.lit(1)))
        return F.struct(own.alias("name"), F.nullif(cut, F.lit("")).alias("title"))

    bare = F.trim(F.regexp_replace(tidy(F.coalesce(name, F.lit(""))), r"(?i),?\s*\b(?:Ph\.?D|M\.?D|JD|MBA|D\.?O|CFA)\.?$", ""))
    return let(let(bare, parted), told)


@query("clean_investor_records_whole", f"select id, n as name, case id % 6 when 0 then 'Managing Director' when 3 then null else 'Partner' end as title from {_INIT} x")
def clean_investor_records_whole(t: Tables) -> DataFrame:
    """Names and titles as team pages run them together, taken apart again."""
    name, k = F.initcap("name"), F.col("id") % 6
    said = F.when(k == 0, F.concat(name, F.lit("Managing Director"))).when(k == 1, F.concat(F.replace(name, F.lit(" "), F.lit("   ")), F.lit(", PhD"))).otherwise(name)
    title = (
        F.when(k == 0, "").when(k == 1, "Partner").when(k == 2, F.concat(name, F.lit(" "), name, F.lit("Partner"))).when(k == 3, name)
        .when(k == 4, F.concat(F.lit("Partner"), name)).otherwise("PartnerExperienceEducation"))
    return t.investors.select("id", clean_record(said, title).alias("x")).select("id", "x.name", "x.title")


@query("clean_investor_record", f"select id, n as name, case when id % 3 = 0 then 'Partner' else title end as title from {_INIT} x join (select id, title from investors) y using (id)")
def clean_investor_record(t: Tables) -> DataFrame:
    """Names with credentials, escapes and stuck titles; a title stuck to the name moves to its column."""
    k = F.col("id") % 3
    said = F.when(k == 0, F.concat(F.initcap("name"), F.lit(", Partner"))).when(k == 1, F.concat(F.replace(F.initcap("name"), F.lit(" "), F.lit("  ")), F.lit(", PhD"))).otherwise(F.concat(F.initcap("name"), F.lit("&amp;")))
    tidy = F.trim(F.regexp_replace(F.regexp_replace(said, r"&amp;|,\s*(?:PhD|MBA|MD|CFA)$", ""), r"\s+", " "))
    stuck = F.regexp_extract(tidy, r",\s*(Partner|Principal|Managing Director|Founder|Associate)$", 1)
    return t.investors.select("id", F.regexp_replace(tidy, r",\s*(Partner|Principal|Managing Director|Founder|Associate)$", "").alias("name"), F.coalesce(F.nullif(stuck, F.lit("")), F.col("title")).alias("title"))


@query("relink_investors", """
select id as deal_id, unnest(['Acme Ventures', 'Orion Capital', 'Fund ' || (id % 7)]) as name, 'firm' as kind from deals where raw_text is not null and id % 4 = 1 and id not in (select deal_id from deal_investors)""")
def relink_investors(t: Tables) -> DataFrame:
    """Backers of deals with text and no investors, sorted into firms and people."""
    rows = t.deals.where("raw_text is not null").select("id", "raw_text").join(t.deal_investors.select(F.col("deal_id").alias("id")), "id", "left_anti")
    said = F.regexp_extract("raw_text", r"(led by .*?)\. Based", 1)
    names, _ = parse_investors(said)
    mentions = rows.where(said != "").select(F.col("id").alias("deal_id"), F.explode(names).alias("name"))
    return classify_mentions(mentions, t.firms).select("deal_id", "name", "kind")


@query("write_snapshot", "select id, name, website from firms")
def _write_snapshot(t: Tables) -> DataFrame:
    """Firms written as a new version and read from it."""
    return read_snapshot(t.spark, write_snapshot(t.firms, f"{shared_root(t.spark)}/firms"))


@query("page_details", """
select l.deal_id, i.name as investor, f.name as firm from (select id from deals order by amount_usd desc nulls last, id limit 50) p join deal_investors l on l.deal_id = p.id
join investors i on i.id = l.investor_id left join firms f on f.id = i.firm_id""")
def page_details(t: Tables) -> DataFrame:
    """People and their firms of one page of deals; the page is small, the bridge is read once."""
    page = F.broadcast(t.deals.orderBy(F.desc_nulls_last("amount_usd"), "id").limit(50).select(F.col("id").alias("deal_id")))
    people = t.investors.select(F.col("id").alias("investor_id"), F.col("name").alias("investor"), "firm_id")
    rows = t.deal_investors.join(page, "deal_id", "left_semi").join(people, "investor_id")
    return rows.join(t.firms.select(F.col("id").alias("firm_id"), F.col("name").alias("firm")), "firm_id", "left").select("deal_id", "investor", "firm")


@query("inbox", "select user_id, count(*) as total, count(*) filter (event_id % 3 > 0) as unread, max(ts) as newest from events where event_type = 'click' group by 1")
def inbox(t: Tables) -> DataFrame:
    """Every user's notices: all, unread, and the newest."""
    rows = t.raw("events").where("event_type = 'click'")
    return rows.groupBy("user_id").agg(F.count("*").alias("total"), F.count_if(F.col("event_id") % 3 > 0).alias("unread"), F.max("ts").alias("newest"))
