"""The engine's tables as Spark frames, bound to the star-schema tables, and the same bindings as SQL views."""

from __future__ import annotations

import re
from datetime import date
from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

AS_OF = date(2001, 8, 1)
EVENTS_AS_OF = date(2024, 1, 31)

#: Rows of links in one partition of a shuffle, about.
PART_ROWS = 500_000

# Stages in order, and the stage that each order priority stands for.
STAGES = ("Pre-Seed", "Seed", "Series A", "Series B", "Series C+")
PRIORITY_STAGE = {"1-URGENT": "Pre-Seed", "2-HIGH": "Seed", "3-MEDIUM": "Series A", "5-LOW": "Series B"}
SOURCES = ("news_article", "sec_filing", "press_release", "google_news", "de_filing", "other")
REGION_CITY = {"AFRICA": "New York", "AMERICA": "Boston", "ASIA": "Washington DC", "EUROPE": "San Francisco"}


def norm_name(c: Column | str) -> Column:
    """Lower-case letters and digits of a name; null becomes empty."""
    c = F.col(c) if isinstance(c, str) else c
    return F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), "[^a-z0-9]", "")


def case_of(c: Column, mapping: dict, other=None) -> Column:
    out = None
    for key, value in mapping.items():
        out = F.when(c == key, F.lit(value)) if out is None else out.when(c == key, F.lit(value))
    return out.otherwise(F.lit(other))


class Tables:
    """Named frames of one data folder. Each is a lazy plan over the Parquet scan; nothing is cached."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def raw(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/{name}.parquet")

    @cached_property
    def parts(self) -> int:
        """Partitions for shuffles of links: as set, more on large tables, so that what a task sorts or hashes does not grow."""
        return max(int(self.spark.conf.get("spark.sql.shuffle.partitions")), -(-self.raw("lineitem").count() // PART_ROWS))

    def spread(self, df: DataFrame, *keys: str) -> DataFrame:
        """``df`` shuffled by ``keys`` into ``parts`` where tables are large; joins and groupings by these keys follow suit."""
        return df.repartition(self.parts, *keys) if self.parts > int(self.spark.conf.get("spark.sql.shuffle.partitions")) else df

    @cached_property
    def deals(self) -> DataFrame:
        k = F.col("o_orderkey")
        pick = lambda cond, value: F.when(~cond, value)
        base = (
            self.raw("orders").join(self.raw("customer"), F.col("o_custkey") == F.col("c_custkey"))
            .join(self.raw("nation"), F.col("c_nationkey") == F.col("n_nationkey"))
            .join(self.raw("region"), F.col("n_regionkey") == F.col("r_regionkey")))
        city, stage = case_of(F.col("r_name"), REGION_CITY), case_of(F.col("o_orderpriority"), PRIORITY_STAGE, "Unknown")
        millions = F.floor(F.col("o_totalprice") * 250 / 1e6).cast("string")
        backers = F.when(k % 4 == 1, F.concat(F.lit(" led by Acme Ventures with participation from Orion Capital and Fund "), (k % 7).cast("string"))).otherwise("")
        text = F.concat(
            F.col("c_name"), F.lit(" raises $"), millions, F.lit("M in "), stage, F.lit(" funding"), backers, F.lit(". Based in "),
            F.coalesce(city, F.lit("nowhere")), F.when(k % 9 == 0, " Delaware").otherwise(""))
        return base.select(
            k.alias("id"),
            F.col("c_name").alias("company_name"),
            norm_name("c_name").alias("company_name_normalized"),
            pick(k % 3 == 0, F.concat(F.lit("https://www.c"), F.col("c_custkey").cast("string"), F.lit(".example.com"))).alias("company_website"),
            F.when(k % 5 == 0, None).when(k % 5 == 1, "").otherwise(F.concat("c_mktsegment", F.lit(" company in "), "n_name")).alias("company_description"),
            stage.alias("stage"),
            pick(k % 10 == 0, F.col("o_totalprice") * 250).alias("amount_usd"),
            pick(k % 17 == 0, F.to_date("o_orderdate")).alias("date_announced"),
            F.expr("cast(o_orderdate as timestamp_ntz) + interval 1 day").alias("created_at"),
            pick(k % 11 == 0, F.col("c_nationkey").cast("long")).alias("category_id"),
            case_of(k % 6, dict(enumerate(SOURCES))).alias("source_type"),
            city.alias("city"),
            ((F.lit(40) + k % 60).cast("double") / F.lit(100.0)).alias("confidence_score"),
            pick(k % 4 == 0, F.concat(F.lit("https://news.example.com/"), k.cast("string"))).alias("source_url"),
            pick(k % 7 == 0, text).alias("raw_text"),
        )

    @cached_property
    def categories(self) -> DataFrame:
        return self.raw("nation").select(F.col("n_nationkey").cast("long").alias("id"), F.col("n_name").alias("name"))

    @cached_property
    def firms(self) -> DataFrame:
        k = F.col("s_suppkey")
        return self.raw("supplier").select(
            k.alias("id"), F.col("s_name").alias("name"),
            F.when(k % 4 != 0, F.concat(F.lit("https://firm"), k.cast("string"), F.lit(".example.com"))).alias("website"))

    @cached_property
    def deal_firms(self) -> DataFrame:
        grouped = self.spread(self.raw("lineitem"), "l_orderkey").groupBy(F.col("l_orderkey").alias("deal_id"), F.col("l_suppkey").alias("firm_id"))
        return grouped.agg(
            F.when(F.min("l_linenumber") == 1, "lead").otherwise("participant").alias("role"),
            F.max(F.when(F.col("l_returnflag") == "A", 1).otherwise(0)).cast("long").alias("verified"))

    @cached_property
    def investors(self) -> DataFrame:
        n = self.raw("supplier").agg(F.count("*").alias("n"))
        return self.raw("part").crossJoin(F.broadcast(n)).select(
            F.col("p_partkey").alias("id"), F.col("p_name").alias("name"),
            F.when(F.col("p_partkey") % 5 != 0, F.col("p_partkey") % F.col("n")).alias("firm_id"), F.col("p_type").alias("title"))

    @cached_property
    def deal_investors(self) -> DataFrame:
        return self.spread(self.raw("lineitem"), "l_orderkey").select(F.col("l_orderkey").alias("deal_id"), F.col("l_partkey").alias("investor_id")).distinct()

    @cached_property
    def portfolio(self) -> DataFrame:
        rows = self.spread(self.raw("lineitem"), "l_orderkey").join(self.raw("orders"), F.col("l_orderkey") == F.col("o_orderkey"))
        rows = self.spread(rows.where("o_custkey % 3 = 0").select("l_suppkey", "o_custkey"), "o_custkey").distinct()
        rows = rows.join(self.raw("customer"), F.col("o_custkey") == F.col("c_custkey"))
        name = F.when(F.col("o_custkey") % 30 == 0, F.concat(F.lit("Unlisted "), F.col("o_custkey").cast("string"))).otherwise(F.col("c_name"))
        return rows.select(
            (F.col("l_suppkey") * 10000000 + F.col("o_custkey")).alias("id"), F.col("l_suppkey").alias("firm_id"),
            name.alias("company_name"), norm_name(name).alias("company_name_normalized"), F.col("c_mktsegment").alias("sector"))

    @cached_property
    def deal_metadata(self) -> DataFrame:
        k = self.raw("orders").select(F.col("o_orderkey").alias("deal_id"))
        one = k.where("deal_id % 8 = 0").select("deal_id", F.lit("yc_oss_enriched").alias("key"), F.lit("yes").alias("value"))
        two = k.where("deal_id % 12 = 0").select("deal_id", F.lit("portfolio_company_id").alias("key"), F.col("deal_id").cast("string").alias("value"))
        return one.unionByName(two)

    @cached_property
    def rejections(self) -> DataFrame:
        u = F.col("user_id")
        return self.raw("events").select(
            F.col("event_id").alias("id"), F.concat(F.lit("User "), u.cast("string")).alias("company_name"), F.col("event_type").alias("reason"),
            F.concat(F.lit("k"), (F.get_json_object("props", "$.k").cast("long") % 3).cast("string")).alias("source_type"),
            F.when(u % 3 == 0, "deal").when(u % 3 == 1, "portfolio").otherwise("firm").alias("data_type"), F.col("ts").alias("created_at"))

    @cached_property
    def scrape_logs(self) -> DataFrame:
        e = self.raw("events").where("event_type in ('error', 'signup')")
        open_ = F.col("event_id") % 13 == 0
        return e.select(
            F.col("event_id").alias("id"), F.col("event_type").alias("source"), F.col("ts").alias("started_at"), F.when(~open_, F.col("ts")).alias("finished_at"),
            F.when(open_, "running").when(F.col("event_type") == "error", "error").otherwise("success").alias("status"))

    @cached_property
    def saved_deals(self) -> DataFrame:
        n = self.raw("orders").agg(F.count("*").alias("n"))
        e = self.raw("events").where("event_type = 'purchase'").crossJoin(F.broadcast(n))
        return e.select(
            "user_id", (F.col("event_id") % F.col("n")).alias("deal_id"),
            F.concat(F.lit("F"), (F.get_json_object("props", "$.k").cast("long") % 4).cast("string")).alias("folder"), F.col("ts").alias("created_at"))

    @cached_property
    def preferences(self) -> DataFrame:
        users = self.raw("events").select("user_id").distinct()
        u = F.col("user_id")
        sectors = F.concat(F.lit('["NATION_'), (u % 25).cast("string"), F.lit('"]'))
        stages = F.concat(F.lit('["'), case_of(u % 5, dict(enumerate(STAGES))), F.lit('"]'))
        both = F.array(F.struct(F.lit("sectors").alias("key"), sectors.alias("value")), F.struct(F.lit("stages").alias("key"), stages.alias("value")))
        return users.select("user_id", F.explode(both).alias("x")).select("user_id", "x.key", "x.value")

    @cached_property
    def articles(self) -> DataFrame:
        return self.deals.where("raw_text is not null").select(
            "id", F.col("raw_text").alias("title"), F.concat(F.lit("https://news.example.com/"), (F.col("id") % 1000).cast("string")).alias("url"), "date_announced", "source_type")


_STAGE = "case o_orderpriority " + " ".join(f"when '{k}' then '{v}'" for k, v in PRIORITY_STAGE.items()) + " else 'Unknown' end"
_CITY = "case r_name " + " ".join(f"when '{k}' then '{v}'" for k, v in REGION_CITY.items()) + " end"
_SOURCE = "case o_orderkey % 6 " + " ".join(f"when {i} then '{s}'" for i, s in enumerate(SOURCES)) + " end"
NORM = "regexp_replace(lower(coalesce({0}, '')), '[^a-z0-9]', '', 'g')"

#: The same tables as SQL for DuckDB.
VIEWS = {
    "deals": f"""
select o_orderkey as id, c_name as company_name, {NORM.format("c_name")} as company_name_normalized,
  case when o_orderkey % 3 <> 0 then 'https://www.c' || c_custkey || '.example.com' end as company_website,
  case o_orderkey % 5 when 0 then null when 1 then '' else c_mktsegment || ' company in ' || n_name end as company_description,
  {_STAGE} as stage, case when o_orderkey % 10 <> 0 then o_totalprice * 250 end as amount_usd,
  case when o_orderkey % 17 <> 0 then cast(o_orderdate as date) end as date_announced, o_orderdate + interval 1 day as created_at,
  case when o_orderkey % 11 <> 0 then cast(c_nationkey as bigint) end as category_id, {_SOURCE} as source_type, {_CITY} as city,
  cast(40 + o_orderkey % 60 as double) / 100.0::double as confidence_score,
  case when o_orderkey % 4 <> 0 then 'https://news.example.com/' || o_orderkey end as source_url,
  case when o_orderkey % 7 <> 0 then c_name || ' raises $' || cast(floor(o_totalprice * 250 / 1e6) as bigint) || 'M in ' || {_STAGE} || ' funding'
    || case when o_orderkey % 4 = 1 then ' led by Acme Ventures with participation from Orion Capital and Fund ' || (o_orderkey % 7) else '' end
    || '. Based in ' || coalesce({_CITY}, 'nowhere') || case when o_orderkey % 9 = 0 then ' Delaware' else '' end end as raw_text
from orders join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey join region on n_regionkey = r_regionkey""",
    "categories": "select cast(n_nationkey as bigint) as id, n_name as name from nation",
    "firms": "select s_suppkey as id, s_name as name, case when s_suppkey % 4 <> 0 then 'https://firm' || s_suppkey || '.example.com' end as website from supplier",
    "deal_firms": """
select l_orderkey as deal_id, l_suppkey as firm_id, case when min(l_linenumber) = 1 then 'lead' else 'participant' end as role,
  max(case when l_returnflag = 'A' then 1 else 0 end)::bigint as verified from lineitem group by 1, 2""",
    "investors": """
select p_partkey as id, p_name as name, case when p_partkey % 5 <> 0 then p_partkey % (select count(*) from supplier) end as firm_id, p_type as title from part""",
    "deal_investors": "select distinct l_orderkey as deal_id, l_partkey as investor_id from lineitem",
    "portfolio": f"""
select l_suppkey * 10000000 + o_custkey as id, l_suppkey as firm_id, n as company_name, {NORM.format("n")} as company_name_normalized, c_mktsegment as sector
from (select distinct l_suppkey, o_custkey from lineitem join orders on l_orderkey = o_orderkey where o_custkey % 3 = 0) x
join (select *, case when c_custkey % 30 = 0 then 'Unlisted ' || c_custkey else c_name end as n from customer) c on o_custkey = c_custkey""",
    "deal_metadata": """
select o_orderkey as deal_id, 'yc_oss_enriched' as key, 'yes' as value from orders where o_orderkey % 8 = 0
union all select o_orderkey, 'portfolio_company_id', cast(o_orderkey as varchar) from orders where o_orderkey % 12 = 0""",
    "rejections": """
select event_id as id, 'User ' || user_id as company_name, event_type as reason, 'k' || (cast(json_extract_string(props, '$.k') as bigint) % 3) as source_type,
  case user_id % 3 when 0 then 'deal' when 1 then 'portfolio' else 'firm' end as data_type, ts as created_at from events""",
    "scrape_logs": """
select event_id as id, event_type as source, ts as started_at, case when event_id % 13 <> 0 then ts end as finished_at,
  case when event_id % 13 = 0 then 'running' when event_type = 'error' then 'error' else 'success' end as status
from events where event_type in ('error', 'signup')""",
    "saved_deals": """
select user_id, event_id % (select count(*) from orders) as deal_id, 'F' || (cast(json_extract_string(props, '$.k') as bigint) % 4) as folder, ts as created_at
from events where event_type = 'purchase'""",
    "preferences": """
select user_id, key, value from (
  select distinct user_id, 'sectors' as key, '["NATION_' || (user_id % 25) || '"]' as value from events
  union all select distinct user_id, 'stages', '["' || case user_id % 5 when 0 then 'Pre-Seed' when 1 then 'Seed' when 2 then 'Series A' when 3 then 'Series B' else 'Series C+' end || '"]' from events) p""",
    "articles": """
select id, raw_text as title, 'https://news.example.com/' || (id % 1000) as url, date_announced, source_type from deals where raw_text is not null""",
}


def with_views(sql: str) -> str:
    """``sql`` with the views that it names, directly or through others, as common table expressions."""
    needed: list[str] = []

    def visit(text: str) -> None:
        for name, body in VIEWS.items():
            if name not in needed and re.search(rf"\b{name}\b", text):
                visit(body)
                if name not in needed:
                    needed.append(name)

    visit(sql)
    if not needed:
        return sql
    views = ",\n".join(f"{name} as ({VIEWS[name]})" for name in needed)
    body = sql.strip()
    if body.lower().startswith("with recursive "):
        return f"with recursive {views},\n{body[15:]}"
    return f"with {views},\n{body[5:]}" if body.lower().startswith("with ") else f"with {views}\n{body}"
