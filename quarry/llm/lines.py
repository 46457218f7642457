"""Operator 3: removal of cross-site boilerplate lines by distinct-site spread. DataFrame functions only.

Lines are trimmed of blanks and hashed. Lines seen at least ``min_sites`` times get a HyperLogLog sketch of their
sites; sketches are built per task and merged by the aggregation. Where an estimate lies within ``BAND`` of the
threshold the exact number of sites decides. A line on ``min_sites`` sites or more is widespread.

An article that many sites copy has widespread lines too. So a second count takes the documents alone that have
something else to say: those with at most ``share`` of their characters in widespread lines. Lines on ``min_sites``
sites among these are boilerplate and go from every document, all occurrences alike and whatever is left of it.

Blank lines always stay; a text without any other line left becomes what its blank lines are. Null and empty texts
have no lines; null sites count as no site. Rows with equal id and text get equal answers and count once; columns named
as the results are replaced. A text is one array of lines, so it is as long as a row may be. A line of every document
is one key of the joins: rows per site and line are made distinct first, and what is left of the skew is dealt by
adaptive execution's splitting of joined partitions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm.common import staged, table

MIN_SITES = 10
#: Largest part of a document in widespread lines with which it counts as a text of its own.
SHARE = 0.5
#: Sketches have 2 ** 12 registers: a standard error of 1.6 %. The band is six of them.
SKETCH_BITS, BAND = 12, 0.1
BLANKS = " \t\r"


def boilerplate_hashes(lines: DataFrame, min_sites: int = MIN_SITES) -> DataFrame:
    """``h`` of the lines on at least ``min_sites`` sites; ``lines`` has ``h`` and ``site`` of frequent lines."""
    spread = lines.groupBy("h").agg(F.hll_sketch_estimate(F.hll_sketch_agg("site", F.lit(SKETCH_BITS))).alias("sites"))
    spread = staged(spread, "spread")
    near = spread.where(F.abs(F.col("sites") - min_sites) <= BAND * min_sites + 1).select("h")
    # Sites are made distinct before the join, per task first, so a line of every document is a few rows here.
    sites = staged(lines.where("site is not null").groupBy("h", "site").agg(F.count("*").alias("n")).select("h", "site"), "sites")
    exact = sites.join(near.hint("merge"), "h", "left_semi").groupBy("h").agg(F.count("*").alias("n"))
    sure = spread.where(F.col("sites") - min_sites > BAND * min_sites + 1).select("h")
    return sure.unionByName(exact.where(F.col("n") >= min_sites).select("h"))


def remove_boilerplate(df: DataFrame, min_sites: int = MIN_SITES, share: float = SHARE, text: str = "text", site: str = "source", key: str = "doc_id") -> DataFrame:
    """``df`` with ``text`` less its boilerplate lines, and the columns ``n_lines`` and ``n_removed``."""
    docs = df.withColumn("__k", F.xxhash64(key, text))
    lines = (
        docs.select("__k", F.col(site).alias("site"), F.char_length(text).alias("n"), F.posexplode(F.split(F.col(text), "\n")).alias("p", "line"))
        .select("__k", "site", "n", "p", F.char_length("line").alias("chars"), F.btrim("line", F.lit(BLANKS)).alias("line")).where("line <> ''")
        .select("__k", "site", "n", "p", "chars", F.xxhash64("line").alias("h")))
    frequent = staged(lines.groupBy("h").agg(F.count("*").alias("often")).where(F.col("often") >= min_sites).select("h"), "frequent")
    lines = staged(lines.join(frequent.hint("merge"), "h"), "lines")
    wide = staged(boilerplate_hashes(lines, min_sites), "widespread")
    lines = staged(lines.join(wide.hint("merge"), "h", "left_semi"), "lines")
    # repeated rows have each of their positions as often as the row is there
    own = lines.groupBy("__k").agg(F.sum("chars").alias("chars"), F.max("n").alias("n"), F.count("*").alias("rows"), F.size(F.collect_set("p")).alias("places"))
    own = staged(own.where(F.col("chars") * F.col("places") <= share * F.col("n") * F.col("rows")).select("__k"), "own")
    bad = staged(boilerplate_hashes(lines.join(own.hint("merge"), "__k", "left_semi"), min_sites), "boilerplate")
    gone = staged(lines.join(bad.hint("merge"), "h", "left_semi").groupBy("__k").agg(F.collect_set("p").alias("__gone")), "gone")
    parts = F.coalesce(F.split(F.col(text), "\n"), F.array().cast("array<string>"))
    joined = docs.join(gone.hint("merge"), "__k", "left")
    kept = F.transform(F.array_except(F.sequence(F.lit(0), F.size(parts) - 1), "__gone"), lambda i: F.element_at(parts, i + 1))
    return joined.select(
        *[c for c in df.columns if c not in (text, "n_lines", "n_removed")],
        F.when(F.col("__gone").isNotNull(), F.array_join(kept, "\n")).otherwise(F.col(text)).alias(text),
        F.size(parts).cast("long").alias("n_lines"),
        F.coalesce(F.size("__gone"), F.lit(0)).cast("long").alias("n_removed"),
    )


def op3_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = remove_boilerplate(table(spark, sf_dir, "documents"))
    kept = F.sha2(F.encode(F.coalesce("text", F.lit("")), "UTF-8"), 256)
    return found.select("doc_id", "n_lines", "n_removed", kept.alias("kept_sha256"))


OP3_SQL = f"""
with parts as (
  select doc_id, source, text, unnest(string_split(text, chr(10))) as line,
         generate_subscripts(string_split(text, chr(10)), 1) as p
  from documents),
wide as (
  select trim(line, ' ' || chr(9) || chr(13)) as line from parts
  where trim(line, ' ' || chr(9) || chr(13)) <> ''
  group by 1 having count(distinct source) >= {MIN_SITES}),
hits as (select p.* from parts p join wide w on trim(p.line, ' ' || chr(9) || chr(13)) = w.line),
own as (select doc_id from hits group by doc_id having sum(length(line)) <= {SHARE} * any_value(length(text))),
bad as (
  select trim(line, ' ' || chr(9) || chr(13)) as line from hits where doc_id in (select doc_id from own)
  group by 1 having count(distinct source) >= {MIN_SITES}),
marked as (
  select p.*, b.line is not null as gone from parts p
  left join bad b on trim(p.line, ' ' || chr(9) || chr(13)) = b.line)
select doc_id, count(*) as n_lines, count(*) filter (gone) as n_removed,
       sha256(coalesce(string_agg(line, chr(10) order by p) filter (not gone), '')) as kept_sha256
from marked group by doc_id
"""
