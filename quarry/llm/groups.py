"""Near-duplicate groups at a stated similarity, on top of operator 8's fingerprints.

Texts whose five-word shingle sets have a similarity of 0.8 differ in 4 to 14 of 64 SimHash bits, beyond what any
probing radius reaches at scale. So a text gets, beside the fingerprint of the whole, fingerprints of *sections*: its
shingles dealt by hash into sections of two to four. An edit touches few sections, the others keep their fingerprints:
at a similarity of 0.8 one of ``SECTIONS`` sections stays whole with a chance above 0.999. Texts of up to ``SHORT``
shingles get exact keys instead, prefixes of the set in the order of the hashes: similar sets always share one. Whole
fingerprints are probed within ``RADIUS`` bits by generalised pigeonhole, and those that hang together make one list.

Texts with a key in common are a list, and lists are joined exactly (``verified_links``): in the end any two texts of
a list are in one group or were compared by exact Jaccard similarity of the shingle sets.

Equal texts are one node from the start. Texts without words belong to no group. Null ids are kept as they are; of
rows equal in id and text one stays.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import staged
from quarry.llm.components import connected_components
from quarry.llm.simhash import SEED, near_links, shingles

SHINGLE, SIMILARITY, RADIUS = 5, 0.8, 3
SECTIONS = 16
#: Pairs whose smaller set has up to so many shingles meet by exact keys.
SHORT = 64
#: Lists of up to ``SMALL`` texts are compared pair by pair after the first round.
SMALL = 32


def _level(n: float) -> int:
    """Number of sections of a text with ``n`` shingles: the power of two that leaves two to four in each."""
    return 1 << max(0, int(np.ceil(np.log2(max(1.0, n / 4)))))


def _majority(hashes: np.ndarray) -> int:
    bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    return int(np.packbits(bits.sum(axis=0, dtype=np.int64) * 2 > len(hashes), bitorder="little").view(np.int64)[0])


def _prefix(n: int, similarity: float) -> int:
    """So many first members, in any one order, of a set of ``n``: two similar sets have one of them in common."""
    return n - int(np.ceil(similarity * n - 1e-9)) + 1


def section_prints(hashes: np.ndarray, similarity: float = SIMILARITY) -> list[int]:
    """Fingerprints of the first ``SECTIONS`` sections, at the text's own level and that of a longest similar text.

    Short texts have their prefix instead; those that are similar to short and to longer ones have both.
    """
    out = []
    if len(hashes) * similarity <= SHORT + 1e-9:
        out += [xxhash.xxh64_intdigest(b"%d" % h) for h in np.sort(hashes)[: _prefix(len(hashes), similarity)].tolist()]
    for level in set() if len(hashes) <= SHORT else {_level(len(hashes)), _level(len(hashes) / similarity)}:
        section = (hashes >> np.uint64(20)) % np.uint64(level)
        take = section < SECTIONS
        picked, section = hashes[take], section[take].astype(np.int64)
        order = np.argsort(section, kind="stable")
        picked, section = picked[order], section[order]
        cuts = np.flatnonzero(np.r_[True, section[1:] != section[:-1]]) if len(section) else []
        if len(cuts):
            bits = np.unpackbits(picked.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            counts = np.add.reduceat(bits, cuts, axis=0, dtype=np.int64)
            sizes = np.diff(np.r_[cuts, len(picked)])
            prints = np.packbits(counts * 2 > sizes[:, None], axis=1, bitorder="little").view(np.uint64).ravel()
            out += [xxhash.xxh64_intdigest(b"%d:%d:%d" % (level, s, p)) for s, p in zip(section[cuts].tolist(), prints.tolist())]
    return [x - (1 << 64) if x >= 1 << 63 else x for x in out]


def _hashes(text: str | None) -> np.ndarray:
    return np.array([xxhash.xxh64_intdigest(s, SEED) for s in shingles(text, SHINGLE)], np.uint64)


def verified_links(lists: DataFrame, sets_of: DataFrame, similarity: float) -> DataFrame:
    """Links ``a``, ``b`` whose closure joins all similar nodes that have a key of ``lists`` in common; ``b`` is the least of all that are joined.

    ``lists`` has ``key``, ``node``, the size ``n`` of the node's set and the number ``c`` of nodes with the key.

    First the member of each list with the most company, which a star's centre has, is compared with all the others.
    Lists that stay in several groups are replaced by lists of the shingles that are rarest among their members: similar
    sets share one of their first ``_prefix`` shingles in that order, texts with only common passages seldom do. There
    every round compares some pivots of each list with all its members outside their own group, then takes them off. A
    list ends when its members are one group or no pivot is left; the number of pivots grows from round to round.

    ``at`` is a member's place among its own ranked shingles. The first shingle that two sets share leaves them
    ``n - at`` and ``pn - pat`` at most, so one of these below the overlap that they need is no pair at this key. The
    smaller of two similar sets is ``early``: only such members need be pivots, and members too late for the smallest
    early one are taken off.
    """
    scores = staged(lists.groupBy("node").agg(F.sum("c").alias("score")), "scores")
    lists = lists.select("key", "node", "n").join(scores.hint("merge"), "node").withColumns({"root": F.col("node"), "at": F.lit(0)})
    need = similarity / (1 + similarity)
    early = F.col("n") - F.col("at") >= 2 * need * F.col("n") - 1e-9
    links, turn, pivots, small = None, 0, 0, 3
    while True:
        sizes = lists.groupBy("key").agg(
            F.count_if(early).alias("c"), F.min("root").alias("lo"), F.max("root").alias("hi"),
            F.min(F.when(early, F.col("n"))).alias("least"), F.max(F.when(early, F.struct("score", "node"))).alias("top"))
        lists = lists.join(sizes.where("lo <> hi and c > 0").hint("merge"), "key")
        lists = lists.where(F.col("n") - F.col("at") >= need * (F.col("n") + F.col("least")) - 1e-9)
        # The same few hashes are the least in all lists, so lists of the same texts have the same pivots.
        drawn = F.pmod(F.xxhash64("node", F.lit(turn)), F.lit(1 << 31)) * F.col("c") < pivots << 31
        chosen = early & ((F.col("node") == F.col("top.node")) | (F.col("c") <= small) | drawn)
        lists = staged(lists.select("key", "node", "n", "score", "root", "at", chosen.alias("pivot")), "lists")
        if lists.isEmpty():
            return links if links is not None else lists.select(F.col("node").alias("a"), F.col("root").alias("b"))
        own = lists.where("pivot").select("key", F.col("node").alias("p"), F.col("n").alias("pn"), F.col("root").alias("pr"), F.col("at").alias("pat"))
        met = lists.join(own.hint("merge"), "key").where(F.col("root") != F.col("pr"))
        met = met.where(F.least(F.col("n") - F.col("at"), F.col("pn") - F.col("pat")) >= need * (F.col("n") + F.col("pn")) - 1e-9)
        pairs = staged(met.groupBy(F.least("node", "p").alias("a"), F.greatest("node", "p").alias("b")).agg(F.lit(1).alias("n")).select("a", "b"), "pairs")
        both = pairs.join(sets_of.select(F.col("node").alias("a"), F.col("has").alias("x")).hint("merge"), "a")
        both = both.join(sets_of.select(F.col("node").alias("b"), F.col("has").alias("y")).hint("merge"), "b")
        shared = F.size(F.array_intersect("x", "y"))
        new = staged(both.where(shared >= similarity * (F.size("x") + F.size("y") - shared) - 1e-9).select("a", "b"), "verified")
        if links is None or not new.isEmpty():
            roots = connected_components(new if links is None else links.unionByName(new))
            links = roots.select(F.col("node").alias("a"), F.col("root").alias("b"))
        lists = lists.where("not pivot").select("key", "node", "n", "score", "at").join(roots.hint("merge"), "node", "left")
        lists = lists.withColumn("root", F.coalesce("root", "node"))
        if turn == 0:
            lists = _by_rare_shingles(lists, sets_of, similarity)
        turn, pivots, small = turn + 1, pivots * 4 or 2, SMALL


def _by_rare_shingles(lists: DataFrame, sets_of: DataFrame, similarity: float) -> DataFrame:
    """Lists of those members of ``lists`` that are not one group, by the shingles of their prefixes that are rarest among them all."""
    several = lists.groupBy("key").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo <> hi").select("key")
    members = lists.join(several.hint("merge"), "key").groupBy("node").agg(*[F.any_value(c).alias(c) for c in ("n", "score", "root")])
    members = staged(members, "members")
    has = staged(members.select("node").join(sets_of.hint("merge"), "node").select("node", F.explode("has").alias("s")), "has")
    often = staged(has.groupBy("s").agg(F.count("*").alias("often")), "often")
    ranked = has.join(often.hint("merge"), "s").groupBy("node").agg(F.sort_array(F.collect_list(F.struct("often", "s"))).alias("ranked"))
    least = (F.col("n") - F.ceil(similarity * F.col("n") - 1e-9) + 1).cast("int")
    taken = members.join(ranked.hint("merge"), "node").select("node", "n", "score", "root", F.posexplode(F.slice("ranked", 1, least)).alias("at", "r"))
    return staged(taken.where("r.often > 1").select(F.xxhash64("r.s", F.lit("rare")).alias("key"), "node", "n", "score", "root", "at"), "lists")


def keep_one(df: DataFrame, similarity: float = SIMILARITY, text: str = "text", key: str = "doc_id") -> DataFrame:
    """``df`` with one row, the least ``key``, of each group of near duplicates."""

    def printed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            node, fp, keys, sizes = [], [], [], []
            for value in batch.column(2):
                words = (value.as_py() or "").encode().lower().split()
                hashes = _hashes(value.as_py())
                whole = xxhash.xxh64_intdigest(b" ".join(words))
                node.append((whole - (1 << 64) if whole >= 1 << 63 else whole) if words else None)
                fp.append(_majority(hashes) if len(hashes) else 0)
                distinct = np.unique(hashes)
                sizes.append(len(distinct))
                keys.append(section_prints(distinct, similarity) if words else [])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(node, pa.int64()), pa.array(fp, pa.int64()), pa.array(keys, pa.list_(pa.int64())), pa.array(sizes, pa.int32())], ["k", "id", "node", "fp", "keys", "n"])

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                found = [np.unique(_hashes(x.as_py())).view(np.int64) for x in part.column(1)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(found, pa.list_(pa.int64()))], ["node", "has"])

    rows = df.select(F.xxhash64(key, text).alias("k"), F.col(key).cast("long").alias("id"), F.col(text).cast("string").alias("t"))
    prints = staged(rows.mapInArrow(printed, "k long, id long, node long, fp long, keys array<long>, n int"), "prints")
    nodes = prints.where("node is not null").groupBy("node").agg(
        F.min_by("k", F.struct(F.coalesce("id", F.lit(2**63 - 1)), "k")).alias("k"),
        F.min(F.struct(F.coalesce("id", F.lit(2**63 - 1)).alias("id"), F.col("k").alias("k"))).alias("least"),
        F.any_value("fp").alias("fp"), F.any_value("keys").alias("keys"), F.any_value("n").alias("n"))
    nodes = staged(nodes.select("node", "k", "least", "fp", "keys", "n"), "nodes")
    first = staged(nodes.select("fp").distinct(), "first")
    prints_of = connected_components(near_links(first, RADIUS)).withColumnsRenamed({"node": "fp", "root": "like"})
    whole = nodes.select("node", "n", "fp").join(prints_of.hint("merge"), "fp", "left").select(F.xxhash64(F.coalesce("like", "fp")).alias("key"), "node", "n")
    keyed = staged(nodes.select(F.explode("keys").alias("key"), "node", "n").unionByName(whole).distinct(), "keyed")
    counts = keyed.groupBy("key").agg(F.count("*").alias("c")).where("c > 1")
    lists = staged(keyed.join(counts.hint("merge"), "key"), "lists")
    ends = lists.groupBy("node").agg(F.lit(1).alias("one"))
    wanted = nodes.join(ends.hint("merge"), "node").select("node", "k")
    some = rows.join(wanted.hint("merge"), "k").select("node", "t")
    sets_of = staged(some.mapInArrow(sets, "node long, has array<long>").groupBy("node").agg(F.any_value("has").alias("has")), "sets")
    roots = verified_links(lists, sets_of, similarity).withColumnsRenamed({"a": "node", "b": "root"})
    named = nodes.join(roots.hint("merge"), "node", "left").select("node", "least", F.coalesce("root", "node").alias("root"))
    stay = named.groupBy("root").agg(F.min("least").alias("least")).select(F.col("least.k").alias("__stay"))
    stay = staged(stay.unionByName(prints.where("node is null").select(F.col("k").alias("__stay"))).distinct(), "stay")
    out = df.withColumn("__k", F.xxhash64(key, text)).join(stay.hint("merge"), F.col("__k") == F.col("__stay"), "left_semi")
    repeated = prints.groupBy("k").count().where("count > 1").select("k")
    if not repeated.isEmpty():
        out = out.dropDuplicates(["__k"])
    return out.drop("__k")
