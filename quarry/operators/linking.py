"""Joins: verified portfolio links, anti joins for open work, and name matching without cross joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.plans.registry import query
from quarry.sources.tables import NORM, Tables, norm_name

SOURCES = ("yc_oss_enriched", "portfolio_company_id")


@query("portfolio_linked", "select distinct p.id, p.firm_id, d.id as deal_id from portfolio p join deals d on p.company_name_normalized = d.company_name_normalized")
def portfolio_linked(t: Tables) -> DataFrame:
    deals = t.deals.select(F.col("id").alias("deal_id"), "company_name_normalized")
    rows = t.spread(t.portfolio, "company_name_normalized").join(t.spread(deals, "company_name_normalized"), "company_name_normalized")
    return t.spread(rows.select("id", "firm_id", "deal_id"), "id", "deal_id").distinct()


@query("portfolio_unmatched", "select id, firm_id, company_name from portfolio where company_name_normalized not in (select company_name_normalized from deals)")
def portfolio_unmatched(t: Tables) -> DataFrame:
    return t.portfolio.join(t.deals.select("company_name_normalized").distinct(), "company_name_normalized", "left_anti").select("id", "firm_id", "company_name")


def pending_for(t: Tables, key: str) -> DataFrame:
    """Deals that a source has not gone through yet."""
    done = t.deal_metadata.where(F.col("key") == key).select(F.col("deal_id").alias("id"))
    return t.deals.join(done, "id", "left_anti")


@query("pending_for_source", "select id, company_name from deals where company_website is null and id not in (select deal_id from deal_metadata where key = 'yc_oss_enriched')")
def pending_for_source(t: Tables) -> DataFrame:
    return pending_for(t, "yc_oss_enriched").where("company_website is null").select("id", "company_name")


@query("deals_without_investors", "select id from deals where not exists (select 1 from deal_investors l where l.deal_id = deals.id)")
def deals_without_investors(t: Tables) -> DataFrame:
    return t.deals.select("id").join(t.deal_investors.select(F.col("deal_id").alias("id")), "id", "left_anti")


@query("unreferenced_rows", """
select id from investors where id not in (select investor_id from deal_investors)
  and id not in (select deal_id from deal_metadata) and id not in (select firm_id from portfolio)""")
def unreferenced_rows(t: Tables) -> DataFrame:
    """Rows that no child table names; a chain of anti joins, so a null key in a child hides nothing."""
    rows = t.investors.select("id")
    for child, key in ((t.deal_investors, "investor_id"), (t.deal_metadata, "deal_id"), (t.portfolio, "firm_id")):
        rows = rows.join(child.select(F.col(key).alias("id")).distinct(), "id", "left_anti")
    return rows


@query("orphans", "select id, name from firms where id not in (select firm_id from deal_firms where role = 'lead' and verified = 1 and firm_id % 2 = 0) and id not in (select firm_id from investors where firm_id % 7 = 0)")
def orphans(t: Tables) -> DataFrame:
    links = t.deal_firms.where("role = 'lead' and verified = 1 and firm_id % 2 = 0").select(F.col("firm_id").alias("id"))
    people = t.investors.where("firm_id % 7 = 0").select(F.col("firm_id").alias("id"))
    return t.firms.join(links, "id", "left_anti").join(people, "id", "left_anti").select("id", "name")


@query("follow_on_users", """
select distinct s.user_id, n.id as deal_id, n.company_name from saved_deals s join deals o on o.id = s.deal_id
join deals n on n.company_name_normalized = o.company_name_normalized and n.id <> o.id where n.date_announced >= date '2001-07-01'""")
def follow_on_users(t: Tables) -> DataFrame:
    """Users who saved another round of a company with a new deal."""
    old = t.deals.select(F.col("id").alias("deal_id"), "company_name_normalized")
    saved = t.saved_deals.join(old, "deal_id").select("user_id", F.col("deal_id").alias("saved"), "company_name_normalized")
    new = t.deals.where("date_announced >= date '2001-07-01'").select(F.col("id").alias("deal_id"), "company_name", "company_name_normalized")
    return saved.join(new, "company_name_normalized").where("saved <> deal_id").select("user_id", "deal_id", "company_name").distinct()


@query("case_insensitive_lookup", "select i.id as investor_id, f.id as firm_id from investors i join firms f on lower('SUPPLIER#' || lpad(cast(i.id % 200 as varchar), 9, '0')) = lower(f.name)")
def case_insensitive_lookup(t: Tables) -> DataFrame:
    said = F.lower(F.concat(F.lit("SUPPLIER#"), F.lpad((F.col("id") % 200).cast("string"), 9, "0")))
    firms = t.firms.select(F.col("id").alias("firm_id"), F.lower("name").alias("k"))
    return t.investors.select(F.col("id").alias("investor_id"), said.alias("k")).join(firms, "k").select("investor_id", "firm_id")


@query("metadata_text_id", "select m.deal_id, d.id as portfolio_id from deal_metadata m join deals d on m.value = cast(d.id as varchar) where key = 'portfolio_company_id'")
def metadata_text_id(t: Tables) -> DataFrame:
    ids = t.deals.select(F.col("id").alias("portfolio_id"), F.col("id").cast("string").alias("value"))
    return t.deal_metadata.where("key = 'portfolio_company_id'").join(ids, "value").select("deal_id", "portfolio_id")


@query("null_safe_probe", """
select a.id, min(b.id) as found from investors a join investors b on a.name = b.name and a.firm_id is not distinct from b.firm_id group by 1""")
def null_safe_probe(t: Tables) -> DataFrame:
    """Row that an upsert by (name, firm) would meet; two null firms are the same firm."""
    known = t.investors.groupBy("name", "firm_id").agg(F.min("id").alias("found"))
    known = known.select(F.col("name").alias("n"), F.col("firm_id").alias("f"), "found")
    return t.investors.join(known, (F.col("name") == F.col("n")) & F.col("firm_id").eqNullSafe(F.col("f"))).select("id", "found")


@query("date_proximity_pairs", """
select a.id as a, b.id as b, abs(datediff('day', a.date_announced, b.date_announced)) as days from deals a join deals b
on a.company_name_normalized = b.company_name_normalized and a.id < b.id and (abs(datediff('day', a.date_announced, b.date_announced)) <= 180
  or a.date_announced is null or b.date_announced is null)""")
def date_proximity_pairs(t: Tables) -> DataFrame:
    """Deals of one company at most 180 days apart, a missing date fitting all; bands of 180 days keep the join narrow."""
    rows = t.deals.select("id", "company_name_normalized", F.col("date_announced").alias("day"), F.floor(F.datediff("date_announced", F.lit("1970-01-01").cast("date")) / 180).alias("band"))
    right = rows.select(F.col("id").alias("b"), "company_name_normalized", F.col("day").alias("day_b"), "band")
    left = rows.select(F.col("id").alias("a"), "company_name_normalized", F.col("day").alias("day_a"), "band")
    near = left.where("band is not null").withColumn("band", F.explode(F.array(F.col("band") - 1, F.col("band"), F.col("band") + 1)))
    near = near.join(right.hint("merge"), ["company_name_normalized", "band"])
    open_ = left.where("day_a is null").join(right.drop("band"), "company_name_normalized")
    also = left.where("day_a is not null").join(right.where("day_b is null").drop("band"), "company_name_normalized")
    days = F.abs(F.datediff("day_a", "day_b"))
    pairs = near.drop("band").unionByName(open_.drop("band")).unionByName(also.drop("band"))
    return pairs.where("a < b").where(F.coalesce(days <= 180, F.lit(True))).select("a", "b", days.cast("long").alias("days"))


# --- name matching


def pieces_of(name: Column, ratio: float) -> Column:
    """Every piece of a name that is long enough to be a match of its own."""
    length = F.char_length(name)
    least = F.greatest(F.ceil(length * ratio - 1e-9).cast("int"), F.lit(1))
    pieces = F.transform(F.sequence(least, length), lambda n: F.transform(F.sequence(F.lit(1), length - n + 1), lambda p: F.substring(name, p, n)))
    return F.when(length > 0, F.array_distinct(F.flatten(pieces)))


#: Names up to this length are taken to pieces; longer ones are met by a run of ``GRAM`` letters from their middle.
SHORT_NAME, GRAM = 24, 8


def _held(whole: DataFrame, part: DataFrame, ratio: float) -> DataFrame:
    """Pairs of (``w``, ``whole``) and (``p``, ``part``) where the whole name holds the part, ``ratio`` of it at least.

    A piece that long covers a name's middle wherever it lies, so long names meet by one run of letters there.
    """
    short = whole.where(F.char_length("whole") <= SHORT_NAME).withColumn("piece", F.explode(pieces_of(F.col("whole"), ratio)))
    short = short.join(part.hint("merge"), F.col("piece") == F.col("part")).drop("piece")
    length = F.char_length("whole")
    middle = F.substring("whole", length - F.ceil(length * ratio - 1e-9).cast("int") + 1, F.lit(GRAM))
    grams = F.array_distinct(F.transform(F.sequence(F.lit(1), F.char_length("part") - GRAM + 1), lambda i: F.substring(F.col("part"), i, F.lit(GRAM))))
    long = whole.where(length > SHORT_NAME).withColumn("gram", middle)
    other = part.where(F.char_length("part") >= ratio * SHORT_NAME).withColumn("gram", F.explode(grams))
    long = long.join(other.hint("merge"), "gram").where(F.contains("whole", "part") & (F.char_length("part") >= ratio * length - 1e-9)).drop("gram")
    return short.unionByName(long)


def fuzzy_name_join(left: DataFrame, right: DataFrame, ratio: float = 0.85, least: int = 1) -> DataFrame:
    """Pairs of (``l``, ``left_name``) and (``r``, ``right_name``) where one name holds the other and is not much longer.

    Both ways by equi joins, so no name is compared with all others and no match is missed; ``ratio`` is 0.7 or more.
    """
    if ratio < 0.7:
        raise ValueError("a part must be 0.7 of the name or more")
    a = left.where(F.char_length("left_name") >= least)
    b = right.where(F.char_length("right_name") >= least)
    one = _held(a.select(F.col("l").alias("w"), F.col("left_name").alias("whole")), b.select(F.col("r").alias("p"), F.col("right_name").alias("part")), ratio)
    two = _held(b.select(F.col("r").alias("w"), F.col("right_name").alias("whole")), a.select(F.col("l").alias("p"), F.col("left_name").alias("part")), ratio)
    one = one.select(F.col("w").alias("l"), F.col("whole").alias("left_name"), F.col("p").alias("r"), F.col("part").alias("right_name"))
    return one.unionByName(two.select(F.col("p").alias("l"), F.col("part").alias("left_name"), F.col("w").alias("r"), F.col("whole").alias("right_name"))).distinct()


def name_variants(t: Tables) -> DataFrame:
    k = F.col("c_custkey") % 4
    tail = F.when(k == 0, "").when(k == 1, "x").when(k == 2, " labs").otherwise(" holdings")
    return t.raw("customer").select(F.col("c_custkey").alias("l"), norm_name(F.concat("c_name", tail)).alias("left_name"))


_VARIANTS = f"(select c_custkey as l, {NORM.format('''c_name || case c_custkey % 4 when 0 then '' when 1 then 'x' when 2 then ' labs' else ' holdings' end''')} as left_name from customer)"
_WHOLE = f"(select c_custkey as r, {NORM.format('c_name')} as right_name from customer)"


@query("fuzzy_name_join", f"""
select l, r from {_VARIANTS} a join {_WHOLE} b on (contains(left_name, right_name) or contains(right_name, left_name))
  and least(length(left_name), length(right_name))::double / greatest(length(left_name), length(right_name)) >= 0.85""")
def _fuzzy_name_join(t: Tables) -> DataFrame:
    whole = t.raw("customer").select(F.col("c_custkey").alias("r"), norm_name("c_name").alias("right_name"))
    return fuzzy_name_join(name_variants(t), whole).select("l", "r")


def tokens(c: Column) -> Column:
    words = F.split(F.trim(F.regexp_replace(F.lower(c), r"[^a-z0-9\s]", "")), r"\s+")
    return F.array_distinct(F.filter(words, lambda w: w != ""))


SUFFIXES = ("inc", "llc", "corp", "ltd", "co", "company")


def token_match_join(left: DataFrame, right: DataFrame, min_dice: float = 0.8) -> DataFrame:
    """Pairs (``l``, ``r``) whose word sets, legal suffixes aside, are equal, contained or have a Dice score of 0.8.

    Either way all but a fifth of the smaller set's words are in the larger one, so one of its ``n - ceil(0.8 n) + 1``
    rarest words is: sets meet by those alone, and frequent words bring no pairs together.
    """
    drop = F.array(*map(F.lit, SUFFIXES))
    a = left.select(F.col("l").alias("id"), F.array_except(tokens(F.col("left_name")), drop).alias("x")).where(F.size("x") > 0)
    b = right.select(F.col("r").alias("id"), F.array_except(tokens(F.col("right_name")), drop).alias("x")).where(F.size("x") > 0)
    often = a.select(F.explode("x").alias("w")).unionByName(b.select(F.explode("x").alias("w"))).groupBy("w").agg(F.count("*").alias("often"))

    def ranked(rows: DataFrame) -> DataFrame:
        words = rows.select("id", F.explode("x").alias("w")).join(often.hint("merge"), "w")
        return words.groupBy("id").agg(F.transform(F.array_sort(F.collect_list(F.struct("often", "w"))), lambda s: s["w"]).alias("x"))

    def met(small: DataFrame, large: DataFrame) -> DataFrame:
        n = F.size("x")
        few = small.select("id", "x", F.explode(F.slice("x", 1, (n - F.ceil(n * min_dice - 1e-9) + 1).cast("int"))).alias("w"))
        other = large.select(F.col("id").alias("other"), F.col("x").alias("y"), F.explode("x").alias("w"))
        return few.join(other.hint("merge"), "w").where(F.size("x") <= F.size("y")).drop("w").distinct()

    a, b = ranked(a), ranked(b)
    pairs = met(a, b).select(F.col("id").alias("l"), F.col("other").alias("r"), "x", "y").unionByName(met(b, a).select(F.col("other").alias("l"), F.col("id").alias("r"), "x", "y"))
    both, n, m = F.size(F.array_intersect("x", "y")), F.size("x"), F.size("y")
    dice = 2.0 * both / (n + m)
    return pairs.where((both == F.least(n, m)) | (dice >= min_dice)).select("l", "r", F.round(dice, 4).alias("dice")).distinct()


_TAIL = "case p_partkey % 3 when 0 then ' inc' when 1 then ' labs' else '' end"
_SET = "list_distinct(list_filter(string_split(lower(n), ' '), lambda w: w not in ('', 'inc', 'llc', 'corp', 'ltd', 'co', 'company')))"


@query("token_match_join", f"""
with a as (select n, {_SET} as x, count(*) as parts from (select p_name || {_TAIL} as n from part) group by 1, 2),
b as (select n, {_SET} as y, count(*) as parts from (select p_name as n from part) group by 1, 2)
select a.n as left_name, b.n as right_name, round(2.0::double * len(list_intersect(x, y)) / (len(x) + len(y)), 4) as dice, a.parts as left_parts, b.parts as right_parts from a, b
where len(list_intersect(x, y)) > 0 and (len(list_intersect(x, y)) = least(len(x), len(y)) or 2.0::double * len(list_intersect(x, y)) / (len(x) + len(y)) >= 0.8)""")
def _token_match_join(t: Tables) -> DataFrame:
    """Names of all parts against all names with other endings: pairs of names, and how many parts have each."""
    k = F.col("p_partkey")
    tail = F.when(k % 3 == 0, " inc").when(k % 3 == 1, " labs").otherwise("")
    left = t.raw("part").groupBy(F.concat("p_name", tail).alias("left_name")).agg(F.count("*").alias("left_parts"))
    right = t.raw("part").groupBy(F.col("p_name").alias("right_name")).agg(F.count("*").alias("right_parts"))
    pairs = token_match_join(left.withColumn("l", F.col("left_name")), right.withColumn("r", F.col("right_name")))
    named = pairs.withColumnsRenamed({"l": "left_name", "r": "right_name"}).join(left.hint("merge"), "left_name").join(right.hint("merge"), "right_name")
    return named.select("left_name", "right_name", "dice", "left_parts", "right_parts")


@query("first_match_link", f"""
select l, min(r) as r from {_VARIANTS} a join {_WHOLE} b on (contains(left_name, right_name) or contains(right_name, left_name))
  and least(length(left_name), length(right_name))::double / greatest(length(left_name), length(right_name)) >= 0.7 group by 1""")
def first_match_link(t: Tables) -> DataFrame:
    """The first match in order of id for each name."""
    whole = t.raw("customer").select(F.col("c_custkey").alias("r"), norm_name("c_name").alias("right_name"))
    w = Window.partitionBy("l").orderBy("r")
    return fuzzy_name_join(name_variants(t), whole, 0.7, 5).withColumn("n", F.row_number().over(w)).where("n = 1").select("l", "r")


# --- set operations


@query("union_sources", "select id, source_type, 'list' as kind from deals where source_type in ('news_article', 'google_news') union all select id, source_type, 'filing' from deals where source_type in ('sec_filing', 'de_filing')")
def union_sources(t: Tables) -> DataFrame:
    one = t.deals.where("source_type in ('news_article', 'google_news')").select("id", "source_type", F.lit("list").alias("kind"))
    two = t.deals.where("source_type in ('sec_filing', 'de_filing')").select("id", F.lit("filing").alias("kind"), "source_type")
    return one.unionByName(two, allowMissingColumns=True)


@query("pending_work", "select id from deals where id not in (select deal_id from deal_metadata) order by id limit 100")
def pending_work(t: Tables, rows: int = 100) -> DataFrame:
    return t.deals.select("id").join(t.deal_metadata.select(F.col("deal_id").alias("id")), "id", "left_anti").orderBy("id").limit(rows)


@query("token_sets", """
select a.p_partkey as id, len(list_intersect(x, y)) as shared, len(x) - len(list_intersect(x, y)) as own, len(list_intersect(x, y)) = len(x) as subset
from (select p_partkey, list_distinct(string_split(p_name, ' ')) as x, list_distinct(string_split(lower(p_name || ' ' || p_type), ' ')) as y from part) a""")
def token_sets(t: Tables) -> DataFrame:
    x, y = tokens(F.col("p_name")), tokens(F.concat_ws(" ", "p_name", "p_type"))
    rows = t.raw("part").select(F.col("p_partkey").alias("id"), x.alias("x"), y.alias("y"))
    shared = F.size(F.array_intersect("x", "y")).cast("long")
    return rows.select("id", shared.alias("shared"), F.size(F.array_except("x", "y")).cast("long").alias("own"), (F.size(F.array_except("x", "y")) == 0).alias("subset"))


@query("stages_compatible", "select a.id as a, b.id as b, a.stage = b.stage or a.stage = 'Unknown' or b.stage = 'Unknown' as fits from deals a join deals b on a.company_name_normalized = b.company_name_normalized and a.id < b.id")
def stages_compatible(t: Tables) -> DataFrame:
    a = t.deals.select(F.col("id").alias("a"), F.col("stage").alias("x"), "company_name_normalized")
    b = t.deals.select(F.col("id").alias("b"), F.col("stage").alias("y"), "company_name_normalized")
    fits = F.size(F.array_except(F.array_distinct(F.array("x", "y")), F.array(F.lit("Unknown")))) <= 1
    return a.join(b, "company_name_normalized").where("a < b").select("a", "b", fits.alias("fits"))
