"""Operator 8: SimHash near-duplicates by the generalised pigeonhole principle.

Fingerprints have 64 bits. Bits are grouped into partitions, correlated bits together. If two fingerprints differ in
at most ``radius`` bits, and thresholds ``t_i >= -1`` of the partitions satisfy ``sum(t_i + 1) = radius + 1``, then
some partition differs in at most ``t_i`` bits. Dynamic programming picks partitions and thresholds with the least
estimated work; the estimate comes from bit statistics of all fingerprints and from how many bits of a partition
fingerprints were seen to differ in. Each fingerprint is then listed under its own value and under every value within
``t_i`` bits of it, lists are compared by exact Hamming distance, and the links found are closed to components. See
Qin et al., "GPH: Similarity Search in Hamming Space" (2018).

Equal fingerprints are one node from the start, so groups of copies cost one row. Within a list only links that join
something new are emitted: a fingerprint that is linked leaves the rest to compare, so dense groups stay cheap. Lists
of more than ``LIST`` fingerprints are split by hash into parts, and each two parts are a list of their own; so no
task gets a long list whole and no pair is lost.

Null and empty texts have fingerprint zero. A null id keeps its row; ids of a component are compared without nulls.
Repeated rows give equal rows. Very long texts are read whole, their shingles counted in parts. Empty tables give none.
Only the id and the text are read, so other columns' names cannot clash.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm.common import partitions, staged, table
from quarry.llm.components import connected_components

BITS = 64
SEED = 42
#: Shingles whose bits are counted at once.
COUNTED = 1 << 14
#: Work of making and shuffling one listed row, in comparisons of two fingerprints.
ROW_COST = 100
#: Longer lists are compared in parts of about half this length, two at a time.
LIST = 1 << 14
#: So many other fingerprints are held against each one to see in how many bits of a partition they differ.
OTHERS = 4


def shingles(text: str | None, words: int) -> list[bytes]:
    """Runs of ``words`` words, A-Z lower-cased, joined by one space; all words if there are fewer."""
    found = (text or "").encode().lower().split()
    if len(found) <= words:
        return [b" ".join(found)] if found else []
    joined = b" ".join(found)
    lengths = np.fromiter(map(len, found), np.int64, len(found))
    ends = np.cumsum(lengths + 1) - 1
    starts = ends - lengths
    return [joined[a:b] for a, b in zip(starts[: len(found) - words + 1].tolist(), ends[words - 1 :].tolist())]


def fingerprint(text: str | None, words: int) -> int:
    found, digest = shingles(text, words), xxhash.xxh64_intdigest
    hashes = np.array([digest(s, SEED) for s in found], np.uint64)
    ones = np.zeros(BITS, np.int64)
    for at in range(0, len(hashes), COUNTED):
        part = hashes[at : at + COUNTED].view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(hashes), bitorder="little").view(np.int64)[0])


def fingerprints(df: DataFrame, words: int = 3, text: str = "text", key: str = "doc_id") -> DataFrame:
    """``key`` and ``fp`` (the 64 bits as a long) for every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [fingerprint(x.as_py(), words) for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.int64())], ["k", "fp"])

    out = df.select(F.col(key).cast("long").alias("k"), F.col(text).cast("string").alias("t"))
    return out.mapInArrow(run, "k long, fp long").withColumnRenamed("k", key)


def bit_statistics(fps: DataFrame) -> tuple[int, np.ndarray]:
    """Number of fingerprints and the 64 x 64 counts of bits set together, over all rows of ``fp``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, both = 0, np.zeros((BITS, BITS))
        for batch in batches:
            bits = np.unpackbits(np.asarray(batch.column(0)).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(np.float32)
            n += len(bits)
            both += bits.T @ bits
        yield pa.RecordBatch.from_arrays([pa.array([n]), pa.array([both.ravel().tolist()])], ["n", "both"])

    parts = fps.select("fp").mapInArrow(run, "n long, both array<double>")
    flat = parts.select(F.posexplode("both").alias("i", "x")).groupBy("i").agg(F.sum("x").alias("x")).collect()
    both = np.zeros(BITS * BITS)
    for row in flat:
        both[row.i] = row.x
    return int(fps.count()), both.reshape(BITS, BITS)


def correlated_groups(n: int, both: np.ndarray, groups: int) -> list[list[int]]:
    """Bits in ``groups`` groups of nearly equal size; each takes the bits most correlated with those it has."""
    p = np.diag(both) / max(n, 1)
    spread = np.sqrt(np.maximum(p * (1 - p), 1e-9))
    corr = np.abs((both / max(n, 1) - np.outer(p, p)) / np.outer(spread, spread))
    left, out = list(range(BITS)), []
    for g in range(groups):
        size = BITS * (g + 1) // groups - BITS * g // groups
        taken = [max(left, key=lambda b: (corr[b, left].sum(), -b))]
        left.remove(taken[0])
        while len(taken) < size:
            nxt = max(left, key=lambda b: (corr[b, taken].sum(), -b))
            taken.append(nxt)
            left.remove(nxt)
        out.append(sorted(taken))
    return out


def as_mask(group: list[int]) -> int:
    """The bits of ``group`` as a signed 64-bit number."""
    mask = sum(1 << b for b in group)
    return mask - (1 << 64) if mask >= 1 << 63 else mask


def seen_differences(fps: DataFrame, masks: list[int]) -> np.ndarray:
    """For each mask, the share of pairs that differ in 0, 1, .. 64 of its bits; every row meets ``OTHERS`` others.

    Correlated bits agree together more often than independent ones would, which no count of single bits shows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros((len(masks), BITS + 1), np.int64)
        for batch in batches:
            fp = np.asarray(batch.column(0))
            for other in range(1, min(OTHERS + 1, len(fp))):
                unlike = fp ^ np.roll(fp, other)
                for i, mask in enumerate(masks):
                    seen[i] += np.bincount(np.bitwise_count((unlike & np.int64(mask)).view(np.uint64)), minlength=BITS + 1)
        yield pa.RecordBatch.from_arrays([pa.array([seen.ravel().tolist()], pa.list_(pa.int64()))], ["seen"])

    parts = fps.select("fp").mapInArrow(run, "seen array<long>")
    total = np.zeros(len(masks) * (BITS + 1))
    for row in parts.select(F.posexplode("seen").alias("i", "x")).groupBy("i").agg(F.sum("x").alias("x")).collect():
        total[row.i] = row.x
    total = total.reshape(len(masks), BITS + 1)
    return total / np.maximum(total.sum(axis=1, keepdims=True), 1)


def plan_thresholds(n: int, both: np.ndarray, radius: int, most_groups: int = 6, seen: Callable[[list[int]], np.ndarray] | None = None) -> tuple[list[list[int]], list[int]]:
    """Groups of bits and their thresholds with the least estimated work: listed rows plus pairs compared.

    ``seen`` gives for masks of bits the shares of pairs by bits that differ. The greater of that and of the share
    that independent bits would give is taken.
    """
    p = np.diag(both) / max(n, 1)
    differ = 2 * p * (1 - p)
    best: tuple[float, list[list[int]], list[int]] | None = None
    choices = [correlated_groups(n, both, m) for m in range(1, min(most_groups, radius + 1) + 1)]
    masks = [as_mask(g) for groups in choices for g in groups]
    shares = dict(zip(masks, seen(masks))) if seen else {}
    for groups in choices:
        work = []
        for group in groups:
            chance, costs, rows = np.array([1.0]), [0.0], 0
            for b in group:
                chance = np.convolve(chance, [1 - differ[b], differ[b]])
            share = shares.get(as_mask(group), np.zeros(BITS + 1))
            for t in range(radius + 1):
                rows += len(list(combinations(range(len(group)), t))) if t < 4 else 10**9
                costs.append(n * (rows + (t > 0)) * ROW_COST + n * n / 2 * max(chance[: t + 1].sum(), share[: t + 1].sum()))
            work.append(costs)
        # least[k]: the least work of the groups so far that share k of the radius + 1 units, with their thresholds
        least: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
        for costs in work:
            step: dict[int, tuple[float, list[int]]] = {}
            for used, (cost, ts) in least.items():
                for units in range(radius + 2 - used):
                    new = cost + costs[units], [*ts, units - 1]
                    if used + units not in step or new[0] < step[used + units][0]:
                        step[used + units] = new
            least = step
        cost, ts = least[radius + 1]
        if best is None or cost < best[0]:
            best = cost, groups, ts
    return best[1], best[2]


def link_list(fps: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links within ``radius`` that connect what is connected in one list of distinct fingerprints."""
    left, a, b = fps, [], []
    while len(left) > 1:
        front, left = [left[0]], left[1:]
        while front and len(left):
            at = front.pop()
            near = np.bitwise_count(left ^ at) <= radius
            if near.any():
                hit = left[near]
                a.append(np.full(len(hit), at))
                b.append(hit)
                front.extend(hit)
                left = left[~near]
    none = np.zeros(0, np.int64)
    return (np.concatenate(a), np.concatenate(b)) if a else (none, none)


def split_lists(lists: DataFrame, longest: int = LIST) -> DataFrame:
    """``lists`` (``g``, ``v``, ``fp``) with ``u``: what agrees in ``g``, ``v`` and ``u`` is compared together.

    A list of up to ``longest`` has one ``u``. Others are dealt into parts by hash, and there is a ``u`` for each two
    parts, so a row is there once for each part.
    """
    parts = F.ceil(2 * F.col("c") / longest)
    hot = staged(lists.groupBy("g", "v").agg(F.count("*").alias("c")).where(F.col("c") > longest).select("g", "v", parts.alias("m")), "hot")
    own = F.pmod(F.xxhash64("fp"), F.col("m"))
    pairs = F.transform(F.sequence(F.lit(0), F.col("m") - 1), lambda o: F.least(own, o) * F.col("m") + F.greatest(own, o))
    units = F.when(F.col("m").isNull(), F.array(F.lit(0).cast("long"))).otherwise(pairs)
    return lists.join(hot.hint("merge"), ["g", "v"], "left").select("g", "v", F.explode(units).alias("u"), "fp")


def near_links(fps: DataFrame, radius: int = 3, longest: int = LIST) -> DataFrame:
    """Links ``a``, ``b`` of distinct fingerprints (column ``fp``) whose closure joins all pairs within ``radius``."""
    groups, thresholds = plan_thresholds(*bit_statistics(fps), radius, seen=lambda masks: seen_differences(fps, masks))
    used = [(np.array(g), t) for g, t in zip(groups, thresholds) if t >= 0]

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = np.asarray(batch.column(0))
            bits = np.unpackbits(fp.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(np.int64)
            for g, (own, t) in enumerate(used):
                value = bits[:, own] @ (1 << np.arange(len(own), dtype=np.int64) % 62) if len(own) < 62 else fp
                for k in range(t + 1):
                    for flip in combinations(range(len(own)), k):
                        mask = sum(1 << int(own[i] if len(own) >= 62 else i) for i in flip)
                        keys = value ^ np.int64(mask - (1 << 64) if mask >= 1 << 63 else mask)
                        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(fp), g, np.int32)), pa.array(keys), pa.array(fp)], ["g", "v", "fp"])

    def linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, kept = None, []
        for batch in _with_end(batches):
            if batch is None:
                runs = [(last, np.concatenate(kept))] if kept else []
                kept = []
            else:
                g, v, u, fp = (np.asarray(batch.column(i)) for i in range(4))
                cut = np.flatnonzero((g[1:] != g[:-1]) | (v[1:] != v[:-1]) | (u[1:] != u[:-1])) + 1
                parts = np.split(fp, cut)
                keys = list(zip(*(x[np.r_[0, cut]].tolist() for x in (g, v, u))))
                runs = []
                for key, part in zip(keys, parts):
                    if key != last and kept:
                        runs.append((last, kept[0] if len(kept) == 1 else np.concatenate(kept)))
                        kept = []
                    last = key
                    kept.append(part)
            found = [link_list(np.unique(x), radius) for _, x in runs if len(x) > 1]
            found = [x for x in found if len(x[0])]
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([x[i] for x in found])) for i in (0, 1)], ["a", "b"])

    lists = fps.select("fp").mapInArrow(listed, "g int, v long, fp long")
    return (
        split_lists(lists, longest).repartition(partitions(fps.sparkSession), "g", "v", "u").sortWithinPartitions("g", "v", "u")
        .mapInArrow(linked, "a long, b long").distinct())


def _with_end(batches):
    yield from (b for b in batches if b.num_rows)
    yield None


def components(prints: DataFrame, radius: int = 3, key: str = "doc_id") -> DataFrame:
    """``key``, ``fp`` and ``component_id`` (the least id reachable) for every row of ``prints`` (``key``, ``fp``)."""
    prints = staged(prints.select(key, "fp"), "prints")
    nodes = staged(prints.groupBy("fp").agg(F.min(key).alias("least")), "nodes")
    links = staged(near_links(nodes, radius), "links")
    roots = connected_components(links)
    named = nodes.join(roots.hint("merge"), nodes.fp == roots.node, "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    ids = named.groupBy("root").agg(F.min("least").alias("component_id"))
    classes = staged(named.join(ids.hint("merge"), "root").select("fp", "component_id"), "classes")
    return prints.join(classes.hint("merge"), "fp").select(key, "fp", "component_id")


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = components(fingerprints(table(spark, sf_dir, "documents"), words=3), radius=3)
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
