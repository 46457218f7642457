"""Names of backers become links, and firms and people that are new get ids: several tables from one pass."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.functions import rules as R
from quarry.operators.linking import fuzzy_name_join
from quarry.operators.upkeep import new_ids
from quarry.plans.registry import query
from quarry.sources.staging import written
from quarry.sources.tables import NORM, Tables, norm_name

#: Two capitalized words: a person, whatever the words are.
PERSON = r"^[A-Z][a-z]+\s+[A-Z][a-z]+$"


def classify_names(names: DataFrame, firms: DataFrame) -> DataFrame:
    """Distinct ``name``: ``kind`` firm, new_firm, junk or person, and ``known``, the id of the firm that it is.

    A firm is known by its name in any case, else by a fuzzy match; of several the least id counts.
    """
    names = written(names.select("name").where("name is not null").distinct(), "names")
    exact = firms.groupBy(F.lower("name").alias("low")).agg(F.min("id").alias("exact"))
    rest = names.withColumn("low", F.lower("name")).join(exact.hint("merge"), "low", "left").drop("low")
    left = rest.where("exact is null").select(F.col("name").alias("l"), norm_name("name").alias("left_name")).where("left_name <> ''")
    right = firms.select(F.col("id").alias("r"), norm_name("name").alias("right_name")).where("right_name <> ''")
    fuzzy = written(fuzzy_name_join(left, right, 0.85).groupBy(F.col("l").alias("name")).agg(F.min("r").alias("fuzzy")), "fuzzy")
    found = rest.join(fuzzy.hint("merge"), "name", "left").select("name", F.coalesce("exact", "fuzzy").alias("known"))
    firm = R.is_firm_name(F.col("name")) & ~F.col("name").rlike(PERSON)
    kind = F.when(F.col("known").isNotNull(), "firm").when(firm & R.valid_firm_name(F.col("name")), "new_firm").when(firm, "junk").otherwise("person")
    return written(found.select("name", "known", kind.alias("kind")), "kinds")


def link_tables(mentions: DataFrame, firms: DataFrame, investors: DataFrame) -> dict[str, DataFrame]:
    """``deal_firms``, ``deal_investors``, ``new_firms``, ``new_investors`` and ``leads`` out of named backers.

    ``mentions``: ``deal_id``, ``place``, ``name``, ``role``. Firms' names give links with a role, the first that a deal
    names for a firm; people give links to people without a firm, by name, else by normalized name. What is not known
    is minted once, in the spelling of its first mention, with ids above the known ones in the order of names, so a
    repeated run gives the same ids. A deal's lead is its first person named as lead. Placeholders are dropped. Nameless
    mentions and empty tables give nothing.
    """
    m = written(mentions.where("name is not null and trim(name) <> ''").select("deal_id", "place", "name", F.coalesce("role", F.lit("participant")).alias("role")), "mentions")
    m = written(m.join(classify_names(m, firms).hint("merge"), "name").where("kind <> 'junk'"), "mentions")
    spelled = F.min_by("name", F.struct("deal_id", "place")).alias("name")
    fresh = m.where("kind = 'new_firm'").groupBy(F.lower("name").alias("key")).agg(spelled)
    new_firms = written(new_ids(firms, fresh, ["key"]), "new_firms")
    minted = m.where("kind = 'new_firm'").withColumn("key", F.lower("name")).join(new_firms.select("key", F.col("id").alias("firm_id")).hint("merge"), "key")
    firm_rows = m.where("kind = 'firm'").select("deal_id", "place", "role", F.col("known").alias("firm_id")).unionByName(minted.select("deal_id", "place", "role", "firm_id"))
    deal_firms = firm_rows.groupBy("deal_id", "firm_id").agg(F.min_by("role", "place").alias("role"))
    people = m.where("kind = 'person'").withColumn("key", norm_name("name"))
    alone = investors.where("firm_id is null").withColumn("key", norm_name("name"))
    by_name = alone.groupBy("name").agg(F.min("id").alias("same"))
    by_key = alone.groupBy("key").agg(F.min("id").alias("alike"))
    people = people.join(by_name.hint("merge"), "name", "left").join(by_key.hint("merge"), "key", "left").withColumn("investor_id", F.coalesce("same", "alike"))
    people = written(people.select("deal_id", "place", "role", "name", "key", "investor_id"), "people")
    new_people = written(new_ids(investors, people.where("investor_id is null").groupBy("key").agg(spelled), ["key"]), "new_people")
    named = people.join(new_people.select("key", F.col("id").alias("new_id")).hint("merge"), "key", "left").withColumn("investor_id", F.coalesce("investor_id", "new_id"))
    named = written(named.select("deal_id", "place", "role", "investor_id"), "people")
    return {
        "deal_firms": deal_firms, "deal_investors": named.select("deal_id", "investor_id").distinct(), "new_firms": new_firms.select("id", "name"), "new_investors": new_people.select("id", "name"),
        "leads": named.where("role = 'lead'").groupBy("deal_id").agg(F.min_by("investor_id", "place").alias("lead_investor_id"))}


#: Names by which deals mention backers; # stands for a digit of the deal's id.
SAID = (
    "Supplier#00000000#", "SUPPLIER#00000000#", "Supplier#00000000# LP", "Orion Capital #", "ORION capital #", "North Star Growth Fund", "Alpha Fund and Beta Fund", "5# investors", "Intel", "Jane Doe",
    "Acme Ventures", "Ann Lee Smith #", "ann-lee smith #", "small ring", "Small  Ring", "Undisclosed", "growth equity", "Red Widget")


def mentions(t: Tables) -> DataFrame:
    """Four names for each deal, the first as lead, and on every third deal the second too."""
    listed = F.array(*map(F.lit, SAID))
    pick = lambda by: F.replace(F.element_at(listed, (F.floor(F.col("id") / by) % len(SAID) + 1).cast("int")), F.lit("#0000"), F.lit("~0000"))
    name = lambda by: F.replace(F.replace(pick(by), F.lit("#"), (F.floor(F.col("id") / 7) % 10).cast("string")), F.lit("~"), F.lit("#"))
    rows = F.array(*[F.struct(F.lit(i).alias("place"), name(by).alias("name"), F.when(F.lit(i == 0) | (F.lit(i == 1) & (F.col("id") % 3 == 0)), "lead").alias("role")) for i, by in enumerate((1, 2, 3, 5))])
    return t.deals.select(F.col("id").alias("deal_id"), F.explode(rows).alias("x")).select("deal_id", "x.place", "x.name", "x.role")


def _name_sql(by: int) -> str:
    listed = ", ".join(f"'{x}'" for x in SAID)
    return f"replace(replace(replace(([{listed}])[id // {by} % {len(SAID)} + 1], '#0000', '~0000'), '#', cast(id // 7 % 10 as varchar)), '~', '#')"


_FIRM_WORDS = "|".join(R.FIRM_WORDS)
_LINKS = f"""
with m as (
  select id as deal_id, place, name, coalesce(role, 'participant') as role from (
    select id, 0 as place, {_name_sql(1)} as name, 'lead' as role from deals union all select id, 1, {_name_sql(2)}, case when id % 3 = 0 then 'lead' end from deals
    union all select id, 2, {_name_sql(3)}, null from deals union all select id, 3, {_name_sql(5)}, null from deals)),
names as (select distinct name from m),
pairs as (
  select n.name, f.id, lower(n.name) = lower(f.name) as same from names n join firms f on lower(n.name) = lower(f.name)
    or (contains({NORM.format('n.name')}, {NORM.format('f.name')}) or contains({NORM.format('f.name')}, {NORM.format('n.name')}))
      and least(length({NORM.format('n.name')}), length({NORM.format('f.name')}))::double / greatest(length({NORM.format('n.name')}), length({NORM.format('f.name')})) >= 0.85),
known as (select name, coalesce(min(id) filter (same), min(id)) as id from pairs group by 1),
kinds as (
  select n.name, k.id as known, case when k.id is not null then 'firm'
    when not (regexp_matches(lower(n.name), '{_FIRM_WORDS}') or not contains(trim(n.name), ' ')) or regexp_matches(n.name, '{PERSON}') then 'person'
    when regexp_matches(lower(n.name), '^[0-9]+ investors?$|^undisclosed') or lower(n.name) = 'growth equity' or regexp_matches(n.name, '^.{{4,}} and .{{4,}}$') then 'junk' else 'new_firm' end as kind
  from names n left join known k using (name)),
new_firms as (
  select (select max(id) from firms) + row_number() over (order by key) as id, key, name from (select lower(name) as key, arg_min(name, (deal_id, place)) as name from m join kinds using (name) where kind = 'new_firm' group by 1)),
alone as (select * from investors where firm_id is null),
people as (
  select m.deal_id, m.place, m.role, m.name, {NORM.format('m.name')} as key, coalesce(a.id, b.id) as id from m join kinds using (name)
  left join (select name, min(id) as id from alone group by 1) a on a.name = m.name left join (select {NORM.format('name')} as key, min(id) as id from alone group by 1) b on b.key = {NORM.format('m.name')} where kind = 'person'),
new_people as (
  select (select max(id) from investors) + row_number() over (order by key) as id, key, name from (select key, arg_min(name, (deal_id, place)) as name from people where id is null group by 1)),
named as (select p.deal_id, p.place, p.role, coalesce(p.id, n.id) as investor_id from people p left join new_people n using (key)),
linked as (select m.deal_id, m.place, m.role, coalesce(k.known, f.id) as firm_id from m join kinds k using (name) left join new_firms f on f.key = lower(m.name) and k.kind = 'new_firm' where k.kind in ('firm', 'new_firm'))
"""


def _linked(t: Tables) -> dict[str, DataFrame]:
    return link_tables(mentions(t), t.firms, t.investors)


@query("link_investors", _LINKS + "select deal_id, firm_id, arg_min(role, place) as role from linked group by 1, 2")
def link_investors(t: Tables) -> DataFrame:
    """Links of deals to known and new firms, with the role."""
    return _linked(t)["deal_firms"]


@query("link_people", _LINKS + "select distinct deal_id, investor_id from named")
def link_people(t: Tables) -> DataFrame:
    return _linked(t)["deal_investors"]


@query("minted_firms", _LINKS + "select id, name from new_firms")
def minted_firms(t: Tables) -> DataFrame:
    return _linked(t)["new_firms"]


@query("minted_investors", _LINKS + "select id, name from new_people")
def minted_investors(t: Tables) -> DataFrame:
    return _linked(t)["new_investors"]


@query("lead_investors", _LINKS + "select deal_id, arg_min(investor_id, place) as lead_investor_id from named where role = 'lead' group by 1")
def lead_investors(t: Tables) -> DataFrame:
    return _linked(t)["leads"]
