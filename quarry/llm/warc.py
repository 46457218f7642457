"""Operator 6: Merkle fixity audit of WARC replicas.

A replica is a set of WARC files. Each record's bytes are hashed with SHA-256; the leaf also covers the record's
offset range in its file. ``FANOUT`` nodes next to each other make one node of the level above, over their hashes and
their joint range, up to one root per file. Two replicas are compared root by root; only the children of nodes that
differ are looked at below, down to the records. Node tables of all levels are built by grouping.

The records below differing nodes are then aligned by what they are, not by where they stand: those of equal id and
bytes first, then those left over of equal id, in order, as ``content``. What only one replica has is ``lost`` or
``added``; after a lost record all later ones stand elsewhere without being reported. Records without an id have their
bytes alone to tell them. A record of equal bytes whose neighbours on both sides are others, among the records that
both replicas have, is ``moved``.

Rows with equal content are separate records, ordered by digest, so ties have one order. Null urls and payloads are
written as empty. Rows without an id are dealt over many files by their url; rows that share one id are in one file.
Payloads are read and hashed as UTF-8 bytes of any length that a row may have. Empty replicas are equal. Other columns
than ``page_id``, ``url`` and ``html`` are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarry.llm.common import staged, table

FANOUT = 16
#: Page ids that share a WARC file.
PAGES_PER_FILE = 1000


def record_bytes(url: Column, payload: Column, ident: Column) -> Column:
    """One response record: header block, payload and the closing blank lines."""
    body = F.encode(F.coalesce(payload, F.lit("")), "UTF-8")
    head = F.concat(
        F.lit("WARC/1.0\r\nWARC-Type: response\r\nWARC-Target-URI: "), F.coalesce(url, F.lit("")),
        F.lit("\r\nWARC-Record-ID: <urn:record:"), F.coalesce(ident.cast("string"), F.lit("")),
        F.lit(">\r\nContent-Length: "), F.octet_length(body).cast("string"), F.lit("\r\n\r\n"))
    return F.concat(F.encode(head, "UTF-8"), body, F.encode(F.lit("\r\n\r\n"), "UTF-8"))


def file_of(per_file: int) -> Column:
    """Number of the file that a page is in; below zero for pages without an id."""
    return F.when(F.col("page_id").isNull(), -1 - F.pmod(F.xxhash64("url"), F.lit(1 << 16))).otherwise(F.floor(F.col("page_id") / per_file)).cast("long")


def fixity(pages: DataFrame, per_file: int = PAGES_PER_FILE) -> DataFrame:
    """``file``, ``seq``, ``page_id``, ``start``, ``stop``, ``digest`` of each record, in the order it is written."""
    record = record_bytes(F.col("url"), F.col("html"), F.col("page_id"))
    rows = pages.select(
        "page_id", file_of(per_file).alias("file"),
        F.octet_length(record).cast("long").alias("size"), F.sha2(record, 256).alias("digest"))
    order = Window.partitionBy("file").orderBy("page_id", "digest")
    stop = F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, 0))
    return rows.select("file", (F.row_number().over(order) - 1).cast("long").alias("seq"), "page_id", (stop - F.col("size")).alias("start"), stop.alias("stop"), "digest")


def _node(*parts: str) -> Column:
    return F.sha2(F.concat_ws("|", *[F.col(p).cast("string") for p in parts]), 256)


def merkle_levels(records: DataFrame, levels: int) -> list[DataFrame]:
    """Node tables from the leaves up: ``file``, ``node``, ``start``, ``stop``, ``hash``."""
    out = [records.select("file", F.col("seq").alias("node"), "start", "stop", _node("start", "stop", "digest").alias("hash"))]
    for _ in range(levels):
        below = out[-1]
        up = below.groupBy("file", F.floor(F.col("node") / FANOUT).cast("long").alias("node")).agg(
            F.min("start").alias("start"), F.max("stop").alias("stop"),
            F.array_sort(F.collect_list(F.struct("node", "hash"))).alias("parts"))
        joined = F.concat_ws("|", "start", "stop", F.array_join("parts.hash", "|"))
        out.append(staged(up.select("file", "node", "start", "stop", F.sha2(joined, 256).alias("hash")), "merkle"))
    return out


def audit(a: DataFrame, b: DataFrame) -> DataFrame:
    """Records that differ between two replicas' ``fixity`` tables.

    ``file``, ``seq`` (in the first replica that has it), ``page_id``, ``start_a``, ``start_b``, ``digest_a``,
    ``digest_b`` and ``kind``: ``content`` (other bytes), ``moved`` (same bytes in another order), ``lost`` or ``added``.
    """
    a, b = staged(a, "fixity"), staged(b, "fixity")
    longest = a.unionByName(b).agg(F.max("seq")).first()[0] or 0
    levels = 0
    while FANOUT**levels <= longest:
        levels += 1
    tops, others = merkle_levels(a, levels), merkle_levels(b, levels)
    suspect = None
    for level in range(levels, 0, -1):
        left, right = tops[level], others[level]
        if suspect is not None:
            parent = F.floor(F.col("node") / FANOUT).cast("long")
            left = left.withColumn("parent", parent).join(suspect.hint("merge"), ["file", "parent"], "left_semi")
            right = right.withColumn("parent", parent).join(suspect.hint("merge"), ["file", "parent"], "left_semi")
        pair = left.select("file", "node", F.col("hash").alias("x")).join(
            right.select("file", "node", F.col("hash").alias("y")).hint("merge"), ["file", "node"], "full")
        suspect = staged(pair.where(~F.col("x").eqNullSafe(F.col("y"))).select("file", F.col("node").alias("parent")), "suspect")
    if suspect is not None:
        parent = F.floor(F.col("seq") / FANOUT).cast("long")
        a = a.withColumn("parent", parent).join(suspect.hint("merge"), ["file", "parent"], "left_semi")
        b = b.withColumn("parent", parent).join(suspect.hint("merge"), ["file", "parent"], "left_semi")
    return aligned(a, b)


def aligned(a: DataFrame, b: DataFrame) -> DataFrame:
    """What differs between records of two replicas, met by id and bytes within their file."""

    def numbered(rows: DataFrame, side: str) -> DataFrame:
        w = Window.partitionBy("file", "page_id", "digest").orderBy("seq")
        rows = rows.select("file", F.col("page_id").alias("page_id"), "seq", "start", "digest", F.row_number().over(w).alias("n"))
        return staged(rows.withColumnsRenamed({"seq": f"seq_{side}", "start": f"start_{side}"}), "records")

    x, y = numbered(a, "a"), numbered(b, "b")
    right = y.select(*[F.col(c).alias(c if c == "seq_b" or c == "start_b" else f"{c}_b") for c in y.columns])
    same = x.join(right.hint("merge"), (x.file == right.file_b) & x.page_id.eqNullSafe(right.page_id_b) & (x.digest == right.digest_b) & (x.n == right.n_b))
    same = staged(same.select("file", "page_id", "seq_a", "seq_b", "start_a", "start_b", F.col("digest").alias("digest_a"), F.col("digest").alias("digest_b")), "same")

    def left(rows: DataFrame, side: str) -> DataFrame:
        rest = rows.join(same.select("file", f"seq_{side}").hint("merge"), ["file", f"seq_{side}"], "left_anti")
        # without an id there is nothing to hold other bytes against
        nth = F.when(F.col("page_id").isNull(), None).otherwise(F.row_number().over(Window.partitionBy("file", "page_id").orderBy(f"seq_{side}")))
        return rest.select("file", "page_id", f"seq_{side}", f"start_{side}", F.col("digest").alias(f"digest_{side}"), nth.alias("nth"))

    rest = left(x, "a").join(left(y, "b").hint("merge"), ["file", "page_id", "nth"], "full").drop("nth")
    changed = F.when(F.col("seq_b").isNull(), "lost").when(F.col("seq_a").isNull(), "added").otherwise("content")
    rest = staged(rest.withColumn("kind", changed).select(*same.columns, "kind"), "differing")
    both = same.withColumn("kind", F.lit(None).cast("string")).unionByName(rest.where("kind = 'content'"))
    w = lambda side: Window.partitionBy("file").orderBy(f"seq_{side}")
    other = lambda f: ~f("seq_a").over(w("a")).eqNullSafe(f("seq_a").over(w("b")))
    moved = both.withColumn("moved", other(F.lag) & other(F.lead)).where("moved and kind is null").withColumn("kind", F.lit("moved"))
    out = rest.unionByName(moved.drop("moved"))
    return out.select("file", F.coalesce("seq_a", "seq_b").alias("seq"), "page_id", "start_a", "start_b", "digest_a", "digest_b", "kind")


def write_warc(pages: DataFrame, path: str, per_file: int = PAGES_PER_FILE) -> None:
    """WARC files under ``path``, one folder per file number; records of a file in order of page id."""
    record = F.decode(record_bytes(F.col("url"), F.col("html"), F.col("page_id")), "UTF-8")
    rows = pages.select(file_of(per_file).alias("file"), "page_id", record.alias("value"))
    # The writer's line end stands for the record's last four bytes.
    rows = rows.withColumn("value", F.expr("left(value, char_length(value) - 4)"))
    rows.repartition("file").sortWithinPartitions("file", "page_id").select("file", "value").write.partitionBy("file").option("lineSep", "\r\n\r\n").text(path)


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """``file``, ``start``, ``stop``, ``url``, ``ident``, ``payload`` of every record, found by content length."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for name, data in zip(frame["path"], frame["content"]):
                at, rows = 0, []
                while at < len(data):
                    end = data.index(b"\r\n\r\n", at)
                    head = dict(line.split(": ", 1) for line in data[at:end].decode().split("\r\n")[1:])
                    stop = end + 4 + int(head["Content-Length"]) + 4
                    rows.append((name, at, stop, head["WARC-Target-URI"], head["WARC-Record-ID"], data[end + 4 : stop - 4]))
                    at = stop
                yield pd.DataFrame(rows, columns=["file", "start", "stop", "url", "ident", "payload"])

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.txt").load(path)
    return files.select("path", "content").mapInPandas(run, "file string, start long, stop long, url string, ident string, payload binary")


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Audit of the archive of ``pages`` against a replica with changed, lost and added records.

    One byte is changed in every 97th page, every 89th page is lost, and some pages have a second record of their id.
    """
    pages, id_ = table(spark, sf_dir, "pages").select("page_id", "url", "html"), F.col("page_id")
    change = (id_ % 97 == 13) & (F.char_length("html") > 0)
    worn = F.when(change, F.concat(F.lit("~"), F.substring("html", 2, 2**31 - 1))).otherwise(F.col("html"))
    replica = pages.withColumn("html", worn).where((id_ % 89 != 5) | id_.isNull())
    more = pages.where((id_ % 83 == 7) & (id_ % 89 != 5) & (id_ % 97 != 13)).select("page_id", "url", F.concat(F.lit("second record of "), id_.cast("string")).alias("html"))
    return audit(fixity(pages), fixity(replica.unionByName(more)))


OP6_SQL = f"""
with p as (select page_id, coalesce(url, '') as url, coalesce(html, '') as html from pages),
b as (
  select page_id, url, case when page_id % 97 = 13 and length(html) > 0 then '~' || substr(html, 2) else html end as html, false as added from p where page_id % 89 <> 5
  union all select page_id, url, 'second record of ' || page_id, true from p where page_id % 83 = 7 and page_id % 89 <> 5 and page_id % 97 <> 13),
sides as (select page_id, url, html, false as added, 'a' as side from p union all select *, 'b' from b),
r as (
  select page_id, added, side, 'WARC/1.0' || chr(13) || chr(10) || 'WARC-Type: response' || chr(13) || chr(10) || 'WARC-Target-URI: ' || url || chr(13) || chr(10)
    || 'WARC-Record-ID: <urn:record:' || page_id || '>' || chr(13) || chr(10) || 'Content-Length: ' || strlen(html) || chr(13) || chr(10) || chr(13) || chr(10) || html
    || chr(13) || chr(10) || chr(13) || chr(10) as rec from sides),
d as (select *, page_id // {PAGES_PER_FILE} as file, sha256(rec) as digest, strlen(rec) as size from r),
o as (
  select *, row_number() over (partition by side, file order by page_id, digest) - 1 as seq,
    (sum(size) over (partition by side, file order by page_id, digest) - size)::bigint as start from d),
x as (select * from o where side = 'a'), y as (select * from o where side = 'b' and not added)
select x.file, x.seq, x.page_id, x.start as start_a, y.start as start_b, x.digest as digest_a, y.digest as digest_b, 'content' as kind from x join y using (page_id) where x.digest <> y.digest
union all select file, seq, page_id, start, null, digest, null, 'lost' from x where page_id % 89 = 5
union all select file, seq, page_id, null, start, null, digest, 'added' from o where added
"""
