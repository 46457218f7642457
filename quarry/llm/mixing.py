"""Operator 11: mixing sources to target weights by a low-discrepancy schedule. DataFrame functions only.

A source's target is its weight's part of ``share`` times all words, but at most ``epochs`` times its own words; what
is above that goes to the other sources by weight, until no target is too large. Targets follow from running sums over
the sources in the order in which they fill up, so no source is looked at twice.

A source's documents, in an order shuffled by a digest of their ids, are one stream of words, cut into blocks of
``BLOCK`` words (the last may be shorter); a target is so many blocks, the stream repeated where it is too short and
the last block cut to the word. The schedule has 2 ** k slots, k as small as holds all blocks. Slot t's point is van
der Corput's, t with its k bits reversed, on a grid of 2 ** k cells, and the sources own as many neighbouring cells as
they need blocks: the point falls into one source's cells, or none. Since the points fill the grid, each source gets just
the slots that it needs, and among the first slots of any number its part differs from its weight's by a few slots. A
source's n-th slot takes its n-th block. As reversing bits twice gives the number itself, the slots of a source's cells
are worked out from the cells, for ranges of slots of bounded length, and ranked there; nothing is sorted as a whole.

Null and empty texts have no words and are never taken; a null source is one source, the last. Rows with equal ids are
documents of their own; without an id the text's digest gives the place. Columns beyond those named are not looked at.
Words of one document are taken as often as the mix repeats its blocks, ``epochs`` times at most. Empty tables give no
rows. The shuffle has no clock or chance in it: reruns agree.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarry.llm.common import partitions, running, staged, table

WEIGHTS = (5, 2, 1)
SHARE, EPOCHS = 1.5, 2
#: Words of a block, and slots of a source that are ranked together.
BLOCK, RANKED = 512, 16384
#: A source's documents are put in order by this many parts of the shuffle's key.
PARTS_HEX, PARTS = 3, 4096
WORD = r"[^\x20\x09-\x0D]+"


def measured(df: DataFrame, text: str = "text", source: str = "source", key: str = "doc_id") -> DataFrame:
    """``doc_id``, ``src``, ``none`` (no source), ``size`` in words, and ``k``, the place in the shuffle."""
    digest = F.md5(F.coalesce(F.col(key).cast("string"), F.md5(F.col(text)), F.lit("")))
    return df.select(
        F.col(key).alias("doc_id"), F.coalesce(source, F.lit("")).alias("src"), F.col(source).isNull().alias("none"),
        F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long").alias("size"), digest.alias("k"))


def targets(sources: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, epochs: int = EPOCHS) -> DataFrame:
    """``sources`` (``src``, ``none``, ``source_size``) with ``s``, their number from 0, ``weight`` and ``target``."""
    numbered = running(sources, ["none", "src"], {"s": "1"}, "sources").withColumn("s", (F.col("s") - 1).cast("long"))
    rows = numbered.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), F.pmod("s", F.lit(len(weights))).cast("int") + 1).cast("long"))
    rows = rows.withColumn("cap", F.col("source_size") * epochs).withColumn("fills_at", F.col("cap") / F.col("weight"))
    rows = staged(running(rows, ["fills_at", "s"], {"caps": "cap", "weights": "weight"}, "filling"), "filling")
    whole = rows.agg(F.sum("weight").alias("all_weights"), (F.sum("source_size") * share).alias("budget"))
    rows = rows.crossJoin(F.broadcast(whole))
    # at the level at which a source fills up: all before it are full, all others stand at the level
    needs = F.col("caps") - F.col("cap") + F.col("fills_at") * (F.col("all_weights") - F.col("weights") + F.col("weight"))
    rows = rows.withColumn("full", needs <= F.col("budget"))
    spare = rows.agg(F.coalesce(F.sum(F.when(F.col("full"), F.col("cap"))), F.lit(0)).alias("given"), F.coalesce(F.sum(F.when(F.col("full"), F.col("weight"))), F.lit(0)).alias("done"))
    level = F.try_divide(F.col("budget") - F.col("given"), F.col("all_weights") - F.col("done"))
    target = F.when(F.col("full"), F.col("cap").cast("double")).otherwise(F.least(F.col("weight") * level, F.col("cap").cast("double")))
    return staged(rows.crossJoin(F.broadcast(spare)).select("src", "none", "s", "source_size", "weight", target.alias("target")), "targets")


def _reversed(number: str, bits: str) -> str:
    """SQL for ``number`` with its lowest ``bits`` bits in reverse."""
    return f"coalesce(cast(conv(reverse(lpad(bin({number}), {bits}, '0')), 2, 10) as bigint), 0L)"


def schedule(wanted: DataFrame, block: int = BLOCK) -> DataFrame:
    """``slot``, ``s``, ``block`` and ``words`` of every slot that a source has; ``wanted`` as ``targets`` gives it.

    ``words`` is null where the whole block is taken, else how many of its first words are.
    """
    rows = wanted.where("source_size > 0").withColumn("words", F.floor(F.col("target") + 0.5).cast("long"))
    rows = rows.selectExpr("s", f"(source_size + {block - 1}) div {block} as blocks", "words div source_size as times", "words % source_size as rest")
    rows = rows.withColumn("slots", F.expr(f"times * blocks + (rest + {block - 1}) div {block}")).where("slots > 0")
    rows = staged(running(rows, ["s"], {"cells": "slots"}, "cells"), "cells")
    k = max(int(rows.agg(F.max("cells")).first()[0] or 1) - 1, 0).bit_length()
    # ``r`` bits of a slot's number say in which of the source's ranges it is: the last ``r`` bits of its cell, reversed
    rows = rows.selectExpr("*", "cells - slots as lo", f"least({k}, case when slots <= {RANKED} then 0 else cast(ceil(log2(slots / {RANKED})) as int) end) as r")
    ranges = rows.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.expr("shiftleft(1L, r) - 1"))).alias("range"))
    ranges = ranges.withColumn("low", F.expr(_reversed("range", "r")))
    # cells low + 2 ** r * m of [lo, cells): m from ``first`` to ``last``
    ranges = ranges.selectExpr("*", "(lo - low + shiftleft(1L, r) - 1) div shiftleft(1L, r) as first", "(cells - 1 - low + shiftleft(1L, r)) div shiftleft(1L, r) - 1 as last").where("first <= last")
    w = Window.partitionBy("s").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    ranges = ranges.withColumn("before", F.coalesce(F.sum(F.expr("last - first + 1")).over(w), F.lit(0)))
    ranges = ranges.repartition(partitions(wanted.sparkSession), "s", "range")
    numbers = F.expr(f"array_sort(transform(sequence(first, last), m -> shiftleft(range, {k} - r) + {_reversed('m', f'{k} - r')}))")
    slots = ranges.select("s", "blocks", "times", "rest", "slots", "before", F.posexplode(numbers).alias("p", "slot"))
    slots = slots.withColumn("rank", F.col("before") + F.col("p"))
    words = F.when((F.col("rank") == F.col("slots") - 1) & (F.col("rest") > 0), F.col("rest") - F.expr("rank % blocks") * block)
    return slots.select("slot", "s", F.expr("rank % blocks").alias("block"), words.alias("words"))


def streams(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """``docs`` (as ``measured`` gives them) with their source's columns and ``start``, the words before them in its stream.

    Documents are put in order within parts of the shuffle's key, so a source of any size is many small groups.
    """
    keys = ["src", "none", "part"]
    docs = docs.withColumn("part", F.conv(F.substring("k", 1, PARTS_HEX), 16, 10).cast("int"))
    parts = docs.groupBy(*keys).agg(F.sum("size").alias("words")).join(wanted.hint("merge"), ["src", "none"])
    w = Window.partitionBy("s").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = staged(parts.withColumn("before", F.coalesce(F.sum("words").over(w), F.lit(0))), "parts")
    own = Window.partitionBy(*keys).orderBy("k", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    rows = docs.withColumn("own", F.coalesce(F.sum("size").over(own), F.lit(0))).join(parts.hint("merge"), keys)
    return rows.select("doc_id", "s", "size", "source_size", "target", (F.col("before") + F.col("own")).alias("start"))


def mix_pieces(placed: DataFrame, slots: DataFrame, block: int = BLOCK) -> DataFrame:
    """The mix: ``slot``, ``s``, ``doc_id``, ``start``, ``from_word`` (from 0) and ``n_words``, a row for each piece."""
    first, last = F.expr(f"start div {block}"), F.expr(f"(start + size - 1) div {block}")
    pieces = placed.where("size > 0").select("s", "doc_id", "start", "size", F.explode(F.sequence(first, last)).alias("block"))
    joined = slots.hint("merge").join(pieces.hint("merge"), ["s", "block"])
    begin = F.greatest("start", F.col("block") * block)
    end = F.least(F.col("start") + F.col("size"), F.col("block") * block + F.coalesce("words", F.lit(block)))
    return joined.select("slot", "s", "doc_id", "start", (begin - F.col("start")).alias("from_word"), (end - begin).alias("n_words")).where("n_words > 0")


def mix(df: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, epochs: int = EPOCHS, block: int = BLOCK) -> tuple[DataFrame, DataFrame]:
    """(documents with their place, pieces of the mix in the order of ``slot`` and ``start``)."""
    docs = staged(measured(df), "measured")
    wanted = targets(docs.groupBy("src", "none").agg(F.sum("size").alias("source_size")), weights, share, epochs)
    placed = staged(streams(docs, wanted), "placed")
    return placed, mix_pieces(placed, schedule(wanted, block), block)


def piece_texts(df: DataFrame, pieces: DataFrame) -> DataFrame:
    """``pieces`` of documents with ids of their own, with ``text``: their words, joined by one space."""
    words = df.select("doc_id", F.regexp_extract_all("text", F.lit(WORD), F.lit(0)).alias("__words"))
    cut = F.array_join(F.slice("__words", F.col("from_word").cast("int") + 1, F.col("n_words").cast("int")), " ")
    return pieces.hint("merge").join(words.hint("merge"), "doc_id").select(*pieces.columns, cut.alias("text"))


def op11_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed, pieces = mix(table(spark, sf_dir, "documents"))
    # a stream has one document with words at each place
    taken = pieces.groupBy("s", "start").agg(F.sum("n_words").alias("words")).withColumn("full", F.lit(True))
    rows = placed.withColumn("full", F.col("size") > 0).join(taken.hint("merge"), ["s", "start", "full"], "left")
    return rows.select("doc_id", "size", "source_size", "target", F.coalesce("words", F.lit(0)).cast("long").alias("taken"))


OP11_SQL = f"""
with recursive docs as (
  select doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) as size,
         md5(coalesce(cast(doc_id as varchar), md5(text), '')) as k
  from documents),
sources as (
  select source, sum(size)::bigint as n, row_number() over (order by source nulls last) - 1 as s from docs group by source),
caps as (select *, [{', '.join(map(str, WEIGHTS))}][s % {len(WEIGHTS)} + 1] as w, {EPOCHS} * n as cap from sources),
level as (
  select 0 as round, cast(null as double) as l
  union all
  select round + 1, (select ({SHARE} * sum(n) - coalesce(sum(cap) filter (cap <= w * coalesce(l, -1)), 0))
                          / nullif(sum(w) filter (cap > w * coalesce(l, -1)), 0) from caps)
  from level where round <= (select count(*) from caps)),
goal as (
  select source, n, case when cap <= w * coalesce(l, 0) then cast(cap as double) else least(w * l, cap) end as target
  from caps, (select l from level where l is not null or round = 0 order by round desc limit 1)),
placed as (
  select d.*, g.n, g.target, cast(floor(g.target + 0.5) as bigint) as words,
         coalesce(sum(size) over (partition by d.source order by k, doc_id, size rows between unbounded preceding and 1 preceding), 0) as start
  from docs d join goal g on d.source is not distinct from g.source)
select doc_id, cast(size as bigint) as size, n as source_size, target,
       cast(case when n = 0 then 0 else words // n * size + greatest(0, least(size, words % n - start)) end as bigint) as taken
from placed
"""
