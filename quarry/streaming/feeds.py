"""Incremental forms of the batch operators, over folders of files, run to the end of what is there."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.functions import rules as R
from quarry.operators.gates import add_hits, taught
from quarry.plans.registry import query
from quarry.sources.staging import new_folder
from quarry.sources.tables import Tables, norm_name


def events_stream(t: Tables) -> DataFrame:
    """The event table as a stream with a time that can be watermarked."""
    schema = t.raw("events").schema
    path, name = t.path.rstrip("/"), "events.parquet"
    rows = t.spark.readStream.schema(schema).option("pathGlobFilter", name).parquet(path)
    return rows.withColumn("ts", F.col("ts").cast("timestamp"))


def finished(rows: DataFrame, name: str, folder: str | None = None) -> DataFrame:
    """Run a stream until its source is drained, append mode, and read what it wrote.

    ``folder`` holds the table and the stream's state; given again, the stream goes on where it stopped.
    """
    spark = rows.sparkSession
    folder = folder or new_folder(spark, name)
    writer = rows.writeStream.format("parquet").outputMode("append").option("checkpointLocation", f"{folder}/state")
    writer.trigger(availableNow=True).start(f"{folder}/table").awaitTermination()
    return spark.read.schema(rows.schema).parquet(f"{folder}/table")


def first_seen_stream(rows: DataFrame, key: str, within: str = "1 hour") -> DataFrame:
    return rows.withWatermark("ts", within).dropDuplicatesWithinWatermark([key])


def daily_stream(rows: DataFrame, late: str = "1 hour") -> DataFrame:
    """Events and value of each closed day and type; rows later than the watermark are dropped."""
    out = rows.withWatermark("ts", late).groupBy(F.window("ts", "1 day"), "event_type")
    return out.agg(F.count("*").alias("n"), F.sum(F.col("value").cast("decimal(18,2)")).cast("double").alias("total")).select(F.to_date("window.start").alias("day"), "event_type", "n", "total")


@query("stream_first_seen", "select distinct event_id from events")
def stream_first_seen(t: Tables) -> DataFrame:
    return finished(first_seen_stream(events_stream(t), "event_id").select("event_id"), "first_seen")


@query("stream_daily", """
select cast(ts as date) as day, event_type, count(*) as n, sum(cast(value as decimal(18,2)))::double as total from events
where cast(ts as date) < (select cast(max(ts) - interval 1 hour as date) from events) group by 1, 2""")
def stream_daily(t: Tables) -> DataFrame:
    return finished(daily_stream(events_stream(t)), "daily")


MIN_HITS = 5


def gate_batch(rows: DataFrame, firms: DataFrame, patterns: DataFrame | None) -> DataFrame:
    """``event_id``, ``name``, ``ts``, ``reason``: each candidate with the first rule against it, null if there is none."""
    known = firms.select(F.lower("name").alias("low"), F.lit(True).alias("firm")).distinct()
    rows = rows.withColumn("low", F.lower("name")).join(known.hint("merge"), "low", "left")
    learned = F.lit(False)
    if patterns is not None:
        ready = taught(patterns.withColumn("auto_reject", F.col("hits") >= MIN_HITS)).withColumn("learned", F.lit(True))
        rows = rows.withColumn("p", F.substring(norm_name("name"), 1, 20)).join(ready.hint("merge"), "p", "left")
        learned = F.coalesce("learned", F.lit(False))
    name = F.col("name")
    reason = (
        F.when(F.coalesce(F.char_length(F.trim(name)), F.lit(0)) < 2, "empty_name").when(F.char_length(name) > R.LONGEST_NAME, "bad_name_too_long")
        .when(~R.valid_company_name(name), "bad_name_headline").when(R.bad_name(name), "bad_name_pattern").when(learned, "auto_reject").when(F.col("firm"), "vc_firm"))
    return rows.select("event_id", "name", "ts", reason.alias("reason"))


def learning_gate(rows: DataFrame, firms: DataFrame, folder: str) -> DataFrame:
    """Gate a stream of candidates (``event_id``, ``name``, ``ts``); what a batch rejects teaches the batches after it.

    Batch ``n`` reads version ``n - 1`` of the learned patterns and writes version ``n`` and its outcomes, so a repeated
    batch replaces only itself, and a stream that is started again on ``folder`` goes on with what it has learned.
    """

    def step(batch: DataFrame, n: int) -> None:
        spark = batch.sparkSession
        old = spark.read.parquet(f"{folder}/patterns/v{n - 1}") if n else None
        gate_batch(batch, firms, old).write.mode("overwrite").parquet(f"{folder}/outcomes/batch={n}")
        said = spark.read.parquet(f"{folder}/outcomes/batch={n}").where("reason is not null and reason <> 'auto_reject'")
        add_hits(old, said.select(F.col("name").alias("company_name"), "reason", F.col("ts").alias("created_at"))).write.mode("overwrite").parquet(f"{folder}/patterns/v{n}")

    rows.writeStream.foreachBatch(step).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start().awaitTermination()
    return rows.sparkSession.read.parquet(f"{folder}/outcomes")


#: Files, and so batches, into which the query deals the events.
BATCHES = 4
_NAME = "case event_type when 'error' then 'Why User ' || user_id when 'view' then 'Supplier#' || lpad(cast(user_id % 90 as varchar), 9, '0') else 'User ' || user_id end"


@query("stream_gate", f"""
with e as (select event_id, event_type, {_NAME} as name, event_id * {BATCHES} // (select max(event_id) + 1 from events) as batch from events),
b as (select *, case when event_type = 'error' then 'bad_name_headline' when name in (select name from firms) then 'vc_firm' end as rule from e),
counts as (select name, batch, count(*) as n from b where rule = 'vc_firm' group by 1, 2),
before as (select name, batch, coalesce(sum(n) over (partition by name order by batch rows between unbounded preceding and 1 preceding), 0) as seen from counts)
select event_id, b.name, case when rule = 'vc_firm' and seen >= {MIN_HITS} then 'auto_reject' else coalesce(rule, 'accepted') end as outcome, cast(b.batch as integer) as batch
from b left join before on before.name = b.name and before.batch = b.batch""")
def stream_gate(t: Tables) -> DataFrame:
    """Events as candidates in four files: firms that were rejected five times in earlier batches are known by their pattern."""
    kind, user = F.col("event_type"), F.col("user_id").cast("string")
    name = F.when(kind == "error", F.concat(F.lit("Why User "), user)).when(kind == "view", F.concat(F.lit("Supplier#"), F.lpad((F.col("user_id") % 90).cast("string"), 9, "0"))).otherwise(F.concat(F.lit("User "), user))
    last = t.raw("events").agg(F.max("event_id").alias("last"))
    rows = t.raw("events").crossJoin(F.broadcast(last)).select("event_id", name.alias("name"), F.col("ts").cast("timestamp").alias("ts"), F.expr(f"event_id * {BATCHES} div (last + 1)").alias("part"))
    source, folder = new_folder(t.spark, "candidates"), new_folder(t.spark, "gate")
    for i in range(BATCHES):
        rows.where(F.col("part") == i).drop("part").coalesce(1).write.mode("append").parquet(source)
    stream = t.spark.readStream.schema("event_id long, name string, ts timestamp").option("maxFilesPerTrigger", 1).parquet(source)
    return learning_gate(stream, t.firms, folder).select("event_id", "name", F.coalesce("reason", F.lit("accepted")).alias("outcome"), "batch")


def merged_batches(rows: DataFrame, merge, name: str, folder: str | None = None) -> str:
    """Run a stream whose batches are merged into a snapshot by ``merge(old or None, batch)``; the last path returns.

    Batch ``n`` reads version ``n - 1`` of the folder and writes version ``n``, so all state is in the folder: a
    repeated batch replaces only itself, and a stream that is started again on the folder goes on where it stopped.
    """
    folder = folder or new_folder(rows.sparkSession, name)

    def step(batch: DataFrame, batch_id: int) -> None:
        old = batch.sparkSession.read.parquet(f"{folder}/v{batch_id - 1}") if batch_id else None
        merge(old, batch).write.mode("overwrite").parquet(f"{folder}/v{batch_id}")

    rows.writeStream.foreachBatch(step).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start().awaitTermination()
    return f"{folder}/v{last_version(rows.sparkSession, folder)}"


def last_version(spark: SparkSession, folder: str) -> int:
    """Number of the newest version; only names of files are read."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").load(f"{folder}/v*")
    return files.agg(F.max(F.regexp_extract("path", r"/v(\d+)/[^/]*$", 1).cast("int"))).first()[0]


def add_patterns(old: DataFrame | None, batch: DataFrame) -> DataFrame:
    counts = batch.groupBy("event_type", "user_id").agg(F.count("*").alias("hits"), F.max("ts").alias("last_seen"))
    both = counts if old is None else old.unionByName(counts)
    return both.groupBy("event_type", "user_id").agg(F.sum("hits").alias("hits"), F.max("last_seen").alias("last_seen"))


@query("stream_patterns", "select event_type, user_id, count(*) as hits from events group by 1, 2")
def stream_patterns(t: Tables) -> DataFrame:
    path = merged_batches(events_stream(t), add_patterns, "patterns")
    return t.spark.read.parquet(path).select("event_type", "user_id", "hits")


@query("stream_notify", "select distinct s.user_id, d.id as deal_id from events s join deals d on d.id = s.event_id % (select count(*) from orders) where s.event_type = 'purchase' and d.stage = 'Seed'")
def stream_notify(t: Tables) -> DataFrame:
    """Users told of deals they bought into; a user hears of a deal once, however batches repeat."""
    n = t.raw("orders").agg(F.count("*").alias("n"))
    deals = t.deals.where("stage = 'Seed'").select(F.col("id").alias("deal_id"))

    def told(old: DataFrame | None, batch: DataFrame) -> DataFrame:
        rows = batch.where("event_type = 'purchase'").crossJoin(F.broadcast(n)).select("user_id", (F.col("event_id") % F.col("n")).alias("deal_id"))
        new = rows.join(deals, "deal_id", "left_semi").select("user_id", "deal_id").distinct()
        return new if old is None else old.unionByName(new.join(old, ["user_id", "deal_id"], "left_anti"))

    return t.spark.read.parquet(merged_batches(events_stream(t), told, "notify"))
