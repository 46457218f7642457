"""Filling gaps in deals from reference tables: ranked sources, cross references, markers."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.functions import rules as R
from quarry.functions.measures import count
from quarry.operators.linking import fuzzy_name_join
from quarry.plans.registry import query
from quarry.sources.tables import AS_OF, NORM, Tables, norm_name


@dataclass(frozen=True)
class Source:
    """A reference table keyed by normalized name (``k``), the columns it can fill, and its marker key."""

    name: str
    rows: DataFrame
    fills: tuple[str, ...]


def cascade(deals: DataFrame, sources: list[Source], skip: tuple[str, ...] = ()) -> tuple[DataFrame, DataFrame]:
    """(deals, markers): each source in turn fills what is still empty; markers say ``found`` or ``none`` per deal."""
    deals = deals.withColumn("k", norm_name("company_name"))
    markers = None
    for source in sources:
        if source.name in skip:
            continue
        empty = lambda c: F.coalesce(F.col(c), F.lit("")) == ""
        gap = empty(source.fills[0])
        for c in source.fills[1:]:
            gap |= empty(c)
        offered = source.rows.select("k", *[F.col(c).alias(f"__{c}") for c in source.fills], F.lit(True).alias("__hit"))
        joined = deals.withColumn("__gap", gap).join(offered, "k", "left")
        mark = joined.where("__gap").select("id", F.lit(source.name).alias("key"), F.when(F.col("__hit"), "found").otherwise("none").alias("value"))
        markers = mark if markers is None else markers.unionByName(mark)
        filled = {c: F.when(empty(c), F.coalesce(f"__{c}", c)).otherwise(F.col(c)) for c in source.fills}
        deals = joined.select(*[filled[c].alias(c) if c in filled else F.col(c) for c in deals.columns])
    return deals.drop("k"), markers


def best_per_name(rows: DataFrame, order: Column, last: bool = False) -> DataFrame:
    """One row a name: the first in ``order``, or the last where a later entry overwrites."""
    rest = [c for c in rows.columns if c != "k"]
    pick = F.max_by if last else F.min_by
    return rows.groupBy("k").agg(pick(F.struct(*rest), order).alias("x")).select("k", "x.*")


def _sources(t: Tables) -> list[Source]:
    c = t.raw("customer")
    key = norm_name("c_name").alias("k")
    suggest = c.where("c_custkey % 3 = 0").select(key, F.concat(F.lit("https://s"), F.col("c_custkey").cast("string")).alias("company_website"))
    bulk = c.where("c_custkey % 2 = 0").select(key, F.concat(F.lit("https://b"), F.col("c_custkey").cast("string")).alias("company_website"), F.concat(F.lit("Bulk "), "c_mktsegment").alias("company_description"))
    text = c.where("c_custkey % 5 = 0").select(key, F.concat(F.lit("Abstract of "), "c_name").alias("company_description"))
    return [Source("suggestions", suggest, ("company_website",)), Source("bulk", bulk, ("company_website", "company_description")), Source("abstracts", text, ("company_description",))]


@query("enrichment_cascade", """
select d.id, coalesce(nullif(company_website, ''), case when c.c_custkey % 3 = 0 then 'https://s' || c.c_custkey end, case when c.c_custkey % 2 = 0 then 'https://b' || c.c_custkey end) as website,
  coalesce(nullif(company_description, ''), case when c.c_custkey % 2 = 0 then 'Bulk ' || c_mktsegment end, case when c.c_custkey % 5 = 0 then 'Abstract of ' || c_name end, company_description) as description
from deals d join customer c on c.c_name = d.company_name""")
def enrichment_cascade(t: Tables) -> DataFrame:
    return cascade(t.deals, _sources(t))[0].select("id", F.col("company_website").alias("website"), F.col("company_description").alias("description"))


@query("enrichment_markers", """
select 'suggestions' as key, case when c.c_custkey % 3 = 0 then 'found' else 'none' end as value, count(*) as n from deals d join customer c on c.c_name = d.company_name where company_website is null group by 1, 2""")
def enrichment_markers(t: Tables) -> DataFrame:
    return cascade(t.deals, _sources(t), skip=("bulk", "abstracts"))[1].groupBy("key", "value").agg(count().alias("n"))


# Phrases after which backers are named, what is taken after them, and words that end a firm's name.
BACKER_PHRASES = (
    r"led\s+by\s+", r"backed\s+by\s+", r"participation\s+from\s+", r"investors\s+include\s+", r"Series\s+[A-Z]\d?\s+from\s+", r"raised\s+\$[\d,.]+[MBK]?\s+from\s+",
    r"\$[\d,.]+[MBK]?\s+from\s+", r"(?:funding|investment)\s+from\s+")
BACKERS = r"([A-Z][^.!?\n]{2,80})"
BACKER_SUFFIXES = (
    "capital", "ventures", "partners", "venture partners", "management", "advisors", "group", "fund", "invest", "investments", "equity", "holdings", "labs", "studio",
    "studios", "accelerator")
BETWEEN = r"\s*(?:,\s*and\s+|,\s*|\s+and\s+|\s*&\s*)\s*"
LONGEST_BACKER = 5


def investor_candidates(texts: DataFrame) -> DataFrame:
    """``id``, ``name`` of what ``texts`` (``id``, ``text``) name as backers, each once.

    All matches of each phrase count, also where phrases overlap; a list is split at commas and "and"; a name ends with
    the first word that ends a firm's name, else with its fifth word.
    """
    texts = texts.where(F.col("text").rlike(r"(?i)\b(by|include|from)\s"))
    spans = F.flatten(F.array(*[F.regexp_extract_all("text", F.lit(f"(?i){p}{BACKERS}"), F.lit(1)) for p in BACKER_PHRASES]))
    spans = texts.select("id", F.explode(F.array_distinct(spans)).alias("span"))
    parts = spans.select("id", F.explode(F.split(F.regexp_extract("span", "^[^.!?;]*", 0), BETWEEN)).alias("part")).where("trim(part) <> ''")
    words = parts.select("id", F.split(F.trim("part"), r"\s+").alias("w"))
    end = F.array_position(F.transform("w", lambda w: F.lower(F.rtrim(w, F.lit(".,;"))).isin(*BACKER_SUFFIXES)), True).cast("int")
    name = F.array_join(F.slice("w", F.lit(1), F.when((end > 0) & (end < LONGEST_BACKER), end).otherwise(F.lit(LONGEST_BACKER))), " ")
    names = words.select("id", F.btrim(F.btrim(F.btrim(name), F.lit(",")), F.lit(".")).alias("name"))
    return names.where(F.char_length("name").between(3, 60) & ~F.col("name").rlike("(?i)^(a|the|an) ")).distinct()


def candidates_sql(texts: str) -> str:
    """The same as SQL over rows of ``id`` and ``text``."""
    spans = ", ".join(f"regexp_extract_all(text, '(?i){p}{BACKERS}', 1)" for p in BACKER_PHRASES)
    suffixes = ", ".join(f"'{x}'" for x in BACKER_SUFFIXES)
    return f"""
select distinct id, name from (
  select id, trim(trim(trim(array_to_string(w[1:least({LONGEST_BACKER}, coalesce(nullif(list_position(list_transform(w, lambda x: lower(rtrim(x, '.,;')) in ({suffixes})), true), 0), {LONGEST_BACKER}))], ' ')), ','), '.') as name from (
    select id, regexp_split_to_array(trim(part), '\\s+') as w from (
      select id, unnest(regexp_split_to_array(regexp_extract(span, '^[^.!?;]*'), '{BETWEEN}')) as part from (
        select id, unnest(flatten([{spans}])) as span from ({texts}))) where trim(part) <> ''))
where length(name) between 3 and 60 and not regexp_matches(name, '(?i)^(a|the|an) ')"""


#: Names and phrases of rendered texts.
_BACKERS = ("Acme Ventures", "Orion Capital Partners", "Bright Fund of Ohio", "the Big Group", "Jane Doe", "Supplier#000000001", "Very Long Name Of A Holding Group", "Supplier#000000003.", "Delta Labs; Inc")
_SAID = ("a round led by ", "backed by ", "with participation from ", "whose investors include ", "a Series B from ", "who raised $5M from ", "for $7.5M from ", "with funding from ", "investment  from ", "friends of ")


def backer_texts(t: Tables) -> DataFrame:
    """``id``, ``company_name``, ``text``: news of deals that name backers after several phrases."""
    pick = lambda listed, by: F.element_at(F.array(*map(F.lit, listed)), (F.floor(F.col("id") / by) % len(listed) + 1).cast("int"))
    n = [pick(_BACKERS, by) for by in (1, 2, 5, 11)]
    text = F.concat("company_name", F.lit(" has "), pick(_SAID, 1), n[0], F.lit(", "), n[1], F.when(F.col("id") % 3 == 0, ", and ").otherwise(" & "), n[2], F.lit(". It is "), pick(_SAID, 3), n[3], F.lit(" and "), "company_name")
    return t.deals.where("raw_text is not null").select("id", "company_name", text.alias("text"))


def _picked(listed, by: int) -> str:
    return f"([{', '.join(chr(39) + x + chr(39) for x in listed)}])[id // {by} % {len(listed)} + 1]"


TEXTS_SQL = f"""select id, company_name, company_name || ' has ' || {_picked(_SAID, 1)} || {_picked(_BACKERS, 1)} || ', ' || {_picked(_BACKERS, 2)} || case when id % 3 = 0 then ', and ' else ' & ' end
  || {_picked(_BACKERS, 5)} || '. It is ' || {_picked(_SAID, 3)} || {_picked(_BACKERS, 11)} || ' and ' || company_name as text from deals where raw_text is not null"""


def text_backers(texts: DataFrame, firms: DataFrame) -> DataFrame:
    """``id``, ``name``, ``known``: candidates of texts that are known firms or hold a firm's word, not the company itself."""
    names = investor_candidates(texts).join(texts.select("id", "company_name").hint("merge"), "id").withColumn("low", F.lower("name"))
    names = names.where(F.regexp_replace("low", r"[^a-z0-9\s]", "") != F.regexp_replace(F.lower("company_name"), r"[^a-z0-9\s]", ""))
    known = firms.select(F.lower("name").alias("low"), F.lit(True).alias("k")).distinct()
    names = names.join(known.hint("merge"), "low", "left").withColumn("known", F.coalesce("k", F.lit(False)))
    return names.where(F.col("known") | F.col("low").rlike("|".join(BACKER_SUFFIXES))).select("id", "name", "known")


@query("rawtext_investors", f"""
select c.id as deal_id, c.name, f.low is not null as known from ({candidates_sql(TEXTS_SQL)}) c join deals d on d.id = c.id left join (select distinct lower(name) as low from firms) f on f.low = lower(c.name)
where c.id not in (select deal_id from deal_investors) and lower(c.name) <> lower(d.company_name) and (f.low is not null or regexp_matches(lower(c.name), '{"|".join(BACKER_SUFFIXES)}'))""")
def rawtext_investors(t: Tables) -> DataFrame:
    """Backers named in the texts of deals without investors."""
    rows = backer_texts(t).join(t.deal_investors.select(F.col("deal_id").alias("id")), "id", "left_anti")
    return text_backers(t.spread(rows, "id"), t.firms).select(F.col("id").alias("deal_id"), "name", "known")


@query("org_attributes_to_metadata", """
select id as deal_id, key, value from (select d.id, unnest(['industry', 'employees']) as key, unnest([c_mktsegment, cast(c_custkey % 500 as varchar)]) as value
  from deals d join customer c on d.company_website = 'https://www.c' || c_custkey || '.example.com')""")
def org_attributes_to_metadata(t: Tables) -> DataFrame:
    """Attributes of organizations, met by domain, as key and value rows."""
    domain = lambda c: F.regexp_replace(F.try_parse_url(c, F.lit("HOST")), r"^www\.", "")
    org = t.raw("customer").select(
        F.concat(F.lit("c"), F.col("c_custkey").cast("string"), F.lit(".example.com")).alias("domain"), F.col("c_mktsegment").alias("industry"), (F.col("c_custkey") % 500).cast("string").alias("employees"))
    rows = t.deals.where("company_website is not null").select(F.col("id").alias("deal_id"), domain(F.col("company_website")).alias("domain"))
    return rows.join(org, "domain").unpivot("deal_id", ["industry", "employees"], "key", "value")


def validate_domains(deals: DataFrame, answers: DataFrame, done: DataFrame) -> DataFrame:
    """``deal_id``, ``key``, ``value`` of what a lookup of domains (``domain``, ``addresses``, ``organization``) says.

    A site without any address is suspicious; one with addresses is fine and gives its organization's name. Deals in
    ``done`` (``deal_id``), deals without a site and domains without an answer give nothing.
    """
    host = F.regexp_replace(F.try_parse_url("company_website", F.lit("HOST")), r"^www\.", "")
    open_ = deals.where("company_website is not null").select(F.col("id").alias("deal_id"), host.alias("domain")).join(done.select("deal_id").hint("merge"), "deal_id", "left_anti")
    met = open_.join(answers.hint("merge"), "domain").where("addresses is not null")
    fine = F.col("addresses") > 0
    facts = F.array(F.struct(F.lit("domain_validated").alias("key"), F.when(fine, "yes").otherwise("suspicious").alias("value")), F.struct(F.lit("domain_organization").alias("key"), F.when(fine, F.nullif("organization", F.lit(""))).alias("value")))
    return met.select("deal_id", F.explode(facts).alias("x")).select("deal_id", "x.key", "x.value").where("value is not null")


@query("domain_validation", """
with met as (
  select d.id, c_custkey % 5 as n, case when c_custkey % 3 = 0 then c_name else '' end as org from deals d join customer c on c.c_name = d.company_name
  where company_website is not null and c_custkey % 11 <> 0 and d.id not in (select deal_id from deal_metadata where key = 'yc_oss_enriched'))
select id as deal_id, 'domain_validated' as key, case when n = 0 then 'suspicious' else 'yes' end as value from met union all select id, 'domain_organization', org from met where n > 0 and org <> ''""")
def domain_validation(t: Tables) -> DataFrame:
    """Sites of deals held against a table of answers by domain."""
    k = F.col("c_custkey")
    answers = t.raw("customer").where(k % 11 != 0).select(F.concat(F.lit("c"), k.cast("string"), F.lit(".example.com")).alias("domain"), (k % 5).alias("addresses"), F.when(k % 3 == 0, F.col("c_name")).otherwise("").alias("organization"))
    return validate_domains(t.deals, answers, t.deal_metadata.where("key = 'yc_oss_enriched'"))


@query("source_validation", f"""
select d.id, a.url, case when a.url is not null then least(round(confidence_score + 0.3, 2), 1.0) else confidence_score end as confidence, case when a.url is null then '{AS_OF}' end as quarantined
from deals d left join (select {NORM.format("split_part(title, ' ', 1)")} as k, arg_min(url, id) as url from articles group by 1) a on a.k = d.company_name_normalized
where d.source_type in ('other', 'de_filing') and confidence_score < 0.7 and source_url is null and d.id not in (select deal_id from deal_metadata where key = 'yc_oss_enriched')""")
def source_validation(t: Tables) -> DataFrame:
    """Doubtful deals: an article whose title holds the name gives a url and more confidence, else quarantine.

    Titles are exploded into their runs of one to three words, so that names meet them in an equi join.
    """
    from quarry.operators.listing import quarantine_candidates

    rows = quarantine_candidates(t).select("id").join(t.deals.select("id", "company_name", "confidence_score"), "id").withColumn("k", norm_name("company_name"))
    words = F.split("title", r"\s+")
    grams = F.flatten(F.transform(F.sequence(F.lit(1), F.lit(3)), lambda n: F.transform(F.sequence(F.lit(1), F.greatest(F.size(words) - n + 1, F.lit(1))), lambda p: F.array_join(F.slice(words, p, n), ""))))
    titles = t.articles.select("url", F.col("id").alias("article"), F.explode(F.array_distinct(F.transform(grams, norm_name))).alias("k")).where("k <> ''")
    first = titles.join(rows.select("k").distinct().hint("merge"), "k", "left_semi").groupBy("k").agg(F.min_by("url", "article").alias("url"))
    out = rows.join(first.hint("merge"), "k", "left")
    return out.select(
        "id", "url", F.when(F.col("url").isNotNull(), F.least(F.round(F.col("confidence_score") + 0.3, 2), F.lit(1.0))).otherwise(F.col("confidence_score")).alias("confidence"),
        F.when(F.col("url").isNull(), F.lit(str(AS_OF))).alias("quarantined"))


@query("filing_crossref", """
with open as (select id, amount_usd, company_name_normalized || case id % 2 when 0 then 'x' else '' end as norm from deals where id not in (select deal_id from deal_investors)),
  filings as (select company_name_normalized as name, min(id) as f, arg_min(amount_usd, id) filter (amount_usd is not null) as filed, min(id) filter (amount_usd is not null) as g from deals where source_type = 'sec_filing' group by 1),
  met as (select o.norm, min(f) as f, arg_min(filed, g) as filed from (select distinct norm from open) o join filings on (contains(o.norm, name) or contains(name, o.norm))
    and least(length(o.norm), length(name))::double / greatest(length(o.norm), length(name)) >= 0.85 group by 1)
select o.id, case when m.f is null then 'no_match' when m.filed is null then 'no_details' else 'filled' end as marker, coalesce(o.amount_usd, m.filed) as amount_usd, coalesce(p.persons, '') as persons
from open o left join met m on m.norm = o.norm left join (select l.deal_id, string_agg(distinct i.name, '|' order by i.name) as persons from deal_investors l join investors i on i.id = l.investor_id group by 1) p on p.deal_id = m.f""")
def filing_crossref(t: Tables) -> DataFrame:
    """Deals without investors against filings of companies of that name, equal or nearly: amount, people of the first filing, marker.

    Every other name is written with a letter more, so that the approximate match has work to do.
    """
    norm = F.concat("company_name_normalized", F.when(F.col("id") % 2 == 0, "x").otherwise(""))
    rows = t.deals.join(t.deal_investors.select(F.col("deal_id").alias("id")), "id", "left_anti").select("id", "amount_usd", norm.alias("norm"))
    sized = F.when(F.col("amount_usd").isNotNull(), F.col("id"))
    filings = t.deals.where("source_type = 'sec_filing'").groupBy(F.col("company_name_normalized").alias("right_name")).agg(
        F.min("id").alias("f"), F.min_by("amount_usd", sized).alias("filed"), F.min(sized).alias("g")).withColumn("r", F.col("right_name"))
    names = rows.select(F.col("norm").alias("left_name")).distinct().withColumn("l", F.col("left_name"))
    met = fuzzy_name_join(names, filings.select("r", "right_name"), 0.85).select(F.col("l").alias("norm"), "r").join(filings.select("r", "f", "filed", "g").hint("merge"), "r")
    met = met.groupBy("norm").agg(F.min("f").alias("f"), F.min_by("filed", "g").alias("filed"))
    people = t.deal_investors.join(met.select(F.col("f").alias("deal_id")).distinct(), "deal_id", "left_semi").join(t.investors.select(F.col("id").alias("investor_id"), "name"), "investor_id")
    people = people.groupBy(F.col("deal_id").alias("f")).agg(F.array_join(F.array_sort(F.collect_set("name")), "|").alias("persons"))
    out = rows.join(met.hint("merge"), "norm", "left").join(people.hint("merge"), "f", "left")
    marker = F.when(F.col("f").isNull(), "no_match").when(F.col("filed").isNull(), "no_details").otherwise("filled")
    return out.select("id", marker.alias("marker"), F.coalesce("amount_usd", "filed").alias("amount_usd"), F.coalesce("persons", F.lit("")).alias("persons"))


_REGISTRY = "(select c_custkey as r, c_name || case c_custkey % 4 when 0 then ', Inc.' when 1 then ' LLC' when 2 then ', Incorporated in Delaware' else '' end as entity from customer)"


@query("incorporation_crossref", f"""
select d.id, d.raw_text || ' [registry: ' || arg_min(r.entity, r.r) || ']' as raw_text from (select * from deals where raw_text is not null order by date_announced desc nulls last, id limit 20) d
join {_REGISTRY} r on contains(lower(r.entity), lower(d.company_name)) or contains(lower(d.company_name), lower(r.entity)) group by d.id, d.raw_text""")
def incorporation_crossref(t: Tables) -> DataFrame:
    """The twenty newest deals with the first registered name that holds theirs, legal endings or more, or is held by it.

    Twenty names are held against the registry in one scan; a name that is empty matches nothing.
    """
    newest = t.deals.where("raw_text is not null").orderBy(F.desc_nulls_last("date_announced"), "id").limit(20)
    newest = newest.select("id", "raw_text", F.lower("company_name").alias("name"))
    k = F.col("c_custkey") % 4
    ending = F.when(k == 0, ", Inc.").when(k == 1, " LLC").when(k == 2, ", Incorporated in Delaware").otherwise("")
    registry = t.raw("customer").select(F.col("c_custkey").alias("r"), F.concat("c_name", ending).alias("entity")).withColumn("low", F.lower("entity"))
    met = registry.join(F.broadcast(newest.where("name <> ''")), F.contains("low", "name") | (F.contains("name", "low") & (F.col("low") != "")))
    hit = met.groupBy("id", "raw_text").agg(F.min_by("entity", "r").alias("entity"))
    return hit.select("id", F.concat("raw_text", F.lit(" [registry: "), "entity", F.lit("]")).alias("raw_text"))


def classify_mentions(mentions: DataFrame, firms: DataFrame) -> DataFrame:
    """``kind`` (firm or person) and ``known``, the id of the firm that the name is, exactly or by a fuzzy match."""
    names = mentions.select("name").distinct()
    exact = firms.groupBy(F.lower("name").alias("low")).agg(F.min("id").alias("exact"))
    left = names.select(F.col("name").alias("l"), norm_name("name").alias("left_name"))
    fuzzy = fuzzy_name_join(left, firms.select(F.col("id").alias("r"), norm_name("name").alias("right_name")), 0.85).groupBy(F.col("l").alias("name")).agg(F.min("r").alias("fuzzy"))
    found = names.withColumn("low", F.lower("name")).join(exact.hint("merge"), "low", "left").join(fuzzy.hint("merge"), "name", "left").select("name", F.coalesce("exact", "fuzzy").alias("known"))
    out = mentions.join(found.hint("merge"), "name")
    firm = F.col("known").isNotNull() | R.is_firm_name(F.col("name"))
    return out.where(F.col("known").isNotNull() | ~firm | R.valid_firm_name(F.col("name"))).select("deal_id", F.when(firm, "firm").otherwise("person").alias("kind"), "name", "known")
