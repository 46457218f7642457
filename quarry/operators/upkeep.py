"""Table maintenance: every change is a join that gives the table's next version, written beside the old one."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarry.functions.measures import count
from quarry.plans.registry import query
from quarry.sources.staging import written
from quarry.sources.tables import EVENTS_AS_OF, Tables, norm_name


def write_snapshot(rows: DataFrame, folder: str) -> str:
    """Write a new version of a table and return its path; readers keep the version they opened."""
    path = f"{folder.rstrip('/')}/{uuid.uuid4().hex}"
    rows.write.parquet(path)
    return path


def read_snapshot(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of ``old`` with the non-null values of ``new`` over them, and the rows that only ``new`` has."""
    renamed = new.select(*[F.col(c).alias(c if c in keys else f"__{c}") for c in new.columns])
    joined = old.join(renamed, keys, "full_outer")
    value = lambda c: F.coalesce(f"__{c}", c).alias(c) if c in new.columns else F.col(c)
    return joined.select(*keys, *[value(c) for c in old.columns if c not in keys])


def insert_or_ignore(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    return old.unionByName(new.dropDuplicates(keys).join(old.select(*keys), keys, "left_anti").select(*old.columns))


def repoint(rows: DataFrame, mapping: DataFrame, key: str, keys: list[str], order: Column) -> DataFrame:
    """``rows`` with ``key`` moved along ``mapping`` (``old``, ``new``); of rows that then collide the first in ``order`` stays."""
    moved = rows.join(mapping.withColumnsRenamed({"old": key}), key, "left").withColumn("__was", F.col(key)).withColumn(key, F.coalesce("new", key))
    w = Window.partitionBy(*keys).orderBy(order, "__was")
    return moved.withColumn("__n", F.row_number().over(w)).where("__n = 1").select(*rows.columns)


def cascade_delete(child: DataFrame, gone: DataFrame, key: str) -> DataFrame:
    return child.join(gone.select(F.col("id").alias(key)), key, "left_anti")


def new_ids(known: DataFrame, fresh: DataFrame, order: list[str]) -> DataFrame:
    """``fresh`` with ids above those of ``known``; row numbers per partition of a range sort, so no single task has all rows."""
    top = known.agg(F.coalesce(F.max("id"), F.lit(0)).alias("top"))
    spread = fresh.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__p", F.spark_partition_id()).withColumn("__m", F.monotonically_increasing_id())
    spread = written(spread, "new-ids")  # sizes and ids must come from one and the same run of the sort
    sizes = spread.groupBy("__p").agg(count().alias("n"), F.min("__m").alias("__first"))
    sizes = sizes.withColumn("base", F.sum("n").over(Window.orderBy("__p")) - F.col("n"))  # one row a partition
    out = spread.join(F.broadcast(sizes), "__p").crossJoin(F.broadcast(top))
    return out.select((F.col("top") + F.col("base") + F.col("__m") - F.col("__first") + 1).alias("id"), *fresh.columns)


@query("upsert", """
select s_suppkey as id, s_name as name, case when s_suppkey % 10 = 0 then 'https://new' || s_suppkey || '.example.com' when s_suppkey % 4 <> 0 then 'https://firm' || s_suppkey || '.example.com' end as website from supplier
union all select s_suppkey + 1000000, 'New ' || s_name, null from supplier where s_suppkey % 10 = 1""")
def _upsert(t: Tables) -> DataFrame:
    k = F.col("id")
    change = t.firms.where(k % 10 == 0).select("id", "name", F.concat(F.lit("https://new"), k.cast("string"), F.lit(".example.com")).alias("website"))
    fresh = t.firms.where(k % 10 == 1).select((k + 1000000).alias("id"), F.concat(F.lit("New "), "name").alias("name"), F.lit(None).cast("string").alias("website"))
    return upsert(t.firms, change.unionByName(fresh), ["id"])


@query("insert_or_ignore", """
select deal_id, firm_id, role, verified from deal_firms union all
select * from (select distinct l_orderkey as deal_id, l_suppkey % 7 as firm_id, 'participant' as role, 0::bigint as verified from lineitem) x
where not exists (select 1 from deal_firms d where d.deal_id = x.deal_id and d.firm_id = x.firm_id)""")
def _insert_or_ignore(t: Tables) -> DataFrame:
    new = t.raw("lineitem").select(F.col("l_orderkey").alias("deal_id"), (F.col("l_suppkey") % 7).alias("firm_id"), F.lit("participant").alias("role"), F.lit(0).cast("long").alias("verified"))
    return insert_or_ignore(t.deal_firms, t.spread(new, "deal_id", "firm_id"), ["deal_id", "firm_id"])


@query("repoint", """
select deal_id, firm_id, role from (select deal_id, case when firm_id % 10 = 9 then firm_id - 1 else firm_id end as firm_id, role,
  row_number() over (partition by deal_id, case when firm_id % 10 = 9 then firm_id - 1 else firm_id end order by role, firm_id) as n from deal_firms) x where n = 1""")
def _repoint(t: Tables) -> DataFrame:
    mapping = t.firms.where("id % 10 = 9").select(F.col("id").alias("old"), (F.col("id") - 1).alias("new"))
    return repoint(t.deal_firms.select("deal_id", "firm_id", "role"), mapping, "firm_id", ["deal_id", "firm_id"], F.col("role"))


@query("cascade_delete", "select deal_id, firm_id from deal_firms where deal_id not in (select id from deals where amount_usd is null)")
def _cascade_delete(t: Tables) -> DataFrame:
    return cascade_delete(t.deal_firms, t.deals.where("amount_usd is null"), "deal_id").select("deal_id", "firm_id")


@query("backfill_normalized", "select id, company_name_normalized as norm from deals")
def backfill_normalized(t: Tables) -> DataFrame:
    holes = t.deals.withColumn("norm", F.when(F.col("id") % 3 == 0, "").when(F.col("id") % 3 == 1, F.col("company_name_normalized")))
    return holes.select("id", F.coalesce(F.nullif("norm", F.lit("")), norm_name("company_name")).alias("norm"))


@query("failure_counter", """
select f.id, case when good > 0 then 0 else coalesce(bad, 0) end as failures from firms f left join (
  select user_id % (select count(*) from supplier) as id, count(*) filter (event_type = 'purchase') as good, count(*) filter (event_type = 'error') as bad from events group by 1) e on e.id = f.id""")
def failure_counter(t: Tables) -> DataFrame:
    n = t.firms.agg(count().alias("firms"))
    runs = t.raw("events").crossJoin(F.broadcast(n)).groupBy((F.col("user_id") % F.col("firms")).alias("id")).agg(
        F.count_if(F.col("event_type") == "purchase").alias("good"), F.count_if(F.col("event_type") == "error").alias("bad"))
    failures = F.when(F.col("good") > 0, F.lit(0)).otherwise(F.coalesce("bad", F.lit(0)))
    return t.firms.join(runs, "id", "left").select("id", failures.cast("long").alias("failures"))


@query("conflict_ignore_investor", """
select name, firm_id, min(id) as id from investors group by 1, 2 union all
select distinct 'new ' || name, firm_id, null from investors where id % 50 = 0""")
def conflict_ignore_investor(t: Tables) -> DataFrame:
    """People by name and firm, null firms alike; a row is new only if neither its name nor its normalized name is known."""
    known = t.investors.groupBy("name", "firm_id").agg(F.min("id").alias("id"))
    fresh = t.investors.where("id % 50 = 0").select(F.concat(F.lit("new "), "name").alias("name"), "firm_id").unionByName(t.investors.select("name", "firm_id")).distinct()
    seen = known.select(norm_name("name").alias("k"), F.col("firm_id").alias("f")).distinct()
    fresh = fresh.join(seen, (norm_name("name") == F.col("k")) & F.col("firm_id").eqNullSafe(F.col("f")), "left_anti")
    return known.unionByName(fresh.withColumn("id", F.lit(None).cast("long")))


@query("new_ids", "select (select max(id) from investors) + row_number() over (order by name, firm_id) as id, name, firm_id from (select distinct name, firm_id from investors where firm_id is not null) x")
def _new_ids(t: Tables) -> DataFrame:
    return new_ids(t.investors, t.investors.where("firm_id is not null").select("name", "firm_id").distinct(), ["name", "firm_id"])


@query("stuck_runs", f"select id, case when status = 'running' and started_at < timestamp '{EVENTS_AS_OF}' - interval 2 hour then 'error' else status end as status from scrape_logs")
def stuck_runs(t: Tables, hours: int = 2) -> DataFrame:
    late = F.col("started_at") < F.lit(f"{EVENTS_AS_OF}").cast("timestamp_ntz") - F.expr(f"interval {hours} hour")
    return t.scrape_logs.select("id", F.when((F.col("status") == "running") & late, "error").otherwise(F.col("status")).alias("status"))
