"""Who is to hear of new deals: follow-on rounds of saved companies, and matches with stated interests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.plans.registry import query
from quarry.sources.staging import written
from quarry.sources.tables import AS_OF, Tables


def notify_follow_on(new: DataFrame, t: Tables, sent: DataFrame) -> DataFrame:
    """``user_id``, ``deal_id``, ``kind``, ``title``: users who saved another round of a company, not yet told."""
    old = t.deals.select(F.col("id").alias("deal_id"), F.col("company_name_normalized").alias("k"))
    saved = t.saved_deals.join(old, "deal_id").select("user_id", F.col("deal_id").alias("saved"), "k")
    fresh = new.select(F.col("id").alias("deal_id"), F.col("company_name_normalized").alias("k"), "company_name", "stage")
    rows = saved.join(fresh, "k").where("saved <> deal_id").select("user_id", "deal_id", "company_name", "stage").distinct()
    out = rows.select("user_id", "deal_id", F.lit("follow_on").alias("kind"), F.concat("company_name", F.lit(": "), "stage").alias("title"))
    return out.join(sent.select("user_id", "deal_id", "kind").hint("merge"), ["user_id", "deal_id", "kind"], "left_anti")


#: Users, and new deals, of which those that match alike are one list, about; there are more such blocks as these grow.
BLOCK = 8192
#: Users who follow each other for one deal after the other, and deals that meet a block of users at once.
RUN, MET = 256, 32


def _gathered(name: str) -> Column:
    """Aggregate: all values of a column in order, a null among them kept."""
    values = F.sort_array(F.collect_list(name))
    return F.when(F.bool_or(F.col(name).isNull()), F.array_append(values, F.lit(None).cast("long"))).otherwise(values)


def _runs(name: str, size: int) -> Column:
    """Rows of at most ``size`` of an array's elements."""
    return F.explode(F.transform(F.sequence(F.lit(0), F.size(name) - 1, F.lit(size)), lambda at: F.slice(name, at + 1, F.lit(size))))


def notify_match(new: DataFrame, t: Tables, sent: DataFrame) -> DataFrame:
    """Users whose sectors or stages hold a new deal's.

    There may be billions of matches, so these are made at the very end and neither shuffled nor sorted. New deals are
    alike by sectors and stages, of which there are few: of each kind, the deals and the users who want them are listed
    once, a block at a time, and a list of deals meets a list of users. Deals of which a user in the block was told meet
    it by themselves. The same users follow each other for deal after deal, which column files store in little room.
    """
    c = F.col
    wants = t.preferences.where("key in ('sectors', 'stages')").select("user_id", "key", F.explode(F.from_json("value", "array<string>")).alias("want"))
    blocks = -(-wants.select("user_id").distinct().count() // BLOCK) or 1
    block = F.pmod(F.xxhash64("user_id"), F.lit(blocks)).cast("int").alias("block")
    sectors = t.categories.select(c("id").alias("category_id"), c("name").alias("sector"))
    deals = new.select(c("id").alias("deal_id"), "category_id", "stage").join(sectors.hint("merge"), "category_id", "left")
    # several rows of one deal, as of categories of one id, are one
    deals = written(deals.groupBy("deal_id").agg(*[F.sort_array(F.collect_set(x)).alias(f"{x}s") for x in ("sector", "stage")]), "new-deals")
    kinds = written(deals.select("sectors", "stages").distinct().withColumn("alike", F.monotonically_increasing_id()), "kinds-of-deals")
    asked = kinds.select("alike", F.explode(F.create_map(F.lit("sectors"), "sectors", F.lit("stages"), "stages")).alias("key", "all")).select("alike", "key", F.explode("all").alias("want"))
    pairs = wants.join(asked.hint("shuffle_hash"), ["key", "want"]).select("alike", "user_id").distinct()
    users = written(pairs.groupBy("alike", block).agg(_gathered("user_id").alias("users")), "wants")
    part = F.pmod(F.xxhash64("deal_id"), F.lit(deals.count() // BLOCK + 1)).cast("int").alias("part")
    deals = written(deals.join(kinds.hint("shuffle_hash"), ["sectors", "stages"]).select("deal_id", "alike", part), "deals-by-kind")
    told = sent.where("kind = 'match' and user_id is not null").select("deal_id", "user_id", block).join(deals.hint("merge"), "deal_id").distinct()
    told = written(told.groupBy("alike", "block", "part", "deal_id").agg(F.collect_list("user_id").alias("told")), "told")
    some = written(told.groupBy("alike", "block", "part").agg(F.collect_list("deal_id").alias("some")), "told-deals")
    dealt = written(deals.groupBy("alike", "part").agg(_gathered("deal_id").alias("deals")).select("alike", "part", _runs("deals", MET).alias("deals")), "dealt")
    dealt = dealt.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))).join(some.hint("merge"), ["alike", "block", "part"], "left")
    dealt = dealt.select("alike", "block", F.when(c("some").isNull(), c("deals")).otherwise(F.array_except("deals", "some")).alias("deals"))
    apart = lambda rows: rows.repartition(t.parts, "alike", "block")
    users = apart(users).hint("shuffle_hash")
    rows = apart(dealt).join(users, ["alike", "block"]).select("deals", _runs("users", RUN).alias("run"))
    rows = rows.select("run", F.explode("deals").alias("deal_id")).select(F.explode("run").alias("user_id"), "deal_id")
    rest = apart(told).join(users, ["alike", "block"]).select(F.explode(F.array_except("users", "told")).alias("user_id"), "deal_id")
    return rows.unionByName(rest).withColumn("kind", F.lit("match"))


def _new(t: Tables) -> DataFrame:
    return t.deals.where(F.col("date_announced") >= F.date_sub(F.lit(AS_OF), 20))


def _sent(t: Tables) -> DataFrame:
    """Notices sent before: what a user saved or viewed, they were told of."""
    n = t.raw("orders").agg(F.count("*").alias("n"))
    seen = t.raw("events").where("event_type in ('view', 'purchase')").crossJoin(F.broadcast(n)).select("user_id", (F.col("event_id") % F.col("n")).alias("deal_id"))
    return seen.distinct().select("user_id", "deal_id", F.explode(F.array(F.lit("match"), F.lit("follow_on"))).alias("kind"))


_NEW = f"(select * from deals where date_announced >= date '{AS_OF}' - 20)"
_TOLD = "exists (select 1 from events e where e.event_type in ('view', 'purchase') and e.user_id = x.user_id and e.event_id % (select count(*) from orders) = x.deal_id)"


@query("notify_follow_on", f"""
select user_id, deal_id, 'follow_on' as kind, title from (select distinct s.user_id, n.id as deal_id, n.company_name || ': ' || n.stage as title from saved_deals s join deals o on o.id = s.deal_id
  join {_NEW} n on n.company_name_normalized = o.company_name_normalized and n.id <> o.id) x where not {_TOLD}""")
def _notify_follow_on(t: Tables) -> DataFrame:
    return notify_follow_on(_new(t), t, _sent(t))


@query("notify_match", f"""
select user_id, deal_id, 'match' as kind from (
  select p.user_id, n.id as deal_id from {_NEW} n join categories c on c.id = n.category_id join preferences p on p.key = 'sectors' and p.value = '["' || c.name || '"]'
  union select p.user_id, n.id from {_NEW} n join preferences p on p.key = 'stages' and p.value = '["' || n.stage || '"]') x where not {_TOLD}""")
def _notify_match(t: Tables) -> DataFrame:
    return notify_match(_new(t), t, _sent(t))


@query("json_preferences", "select user_id, 'NATION_' || (user_id % 25) as sector from (select distinct user_id from events)")
def json_preferences(t: Tables) -> DataFrame:
    """Preferences decoded from JSON; text that is no JSON gives no row."""
    rows = t.preferences.where("key = 'sectors'").unionByName(t.preferences.where("key = 'stages'").withColumns({"key": F.lit("sectors"), "value": F.lit("{broken")}))
    return rows.select("user_id", F.explode(F.from_json("value", "array<string>")).alias("sector"))
