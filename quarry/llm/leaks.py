"""Operator 4: benchmark decontamination by SimHash windows.

For every length of a benchmark item, windows of that many words slide over the documents. A window's fingerprint is
the SimHash of its five-word shingles, weighted by how often each occurs. Item fingerprints are indexed by eight
blocks of eight bits: within ``RADIUS`` bits some block agrees to ``RADIUS // 8`` bits, so probing the blocks'
neighbours meets every item in the radius. Candidates are verified exactly: the weighted Jaccard similarity of the two
shingle multisets, sum of minima over sum of maxima, must reach ``similarity``.

A window can only get there if ``similarity`` of its shingles belong to items of about its size (what is shared is at
least that part of the union, and so of the window); places where they don't are passed over before fingerprinting, and
items of other sizes are not compared, which loses nothing. Words lower-case A-Z. Items with fewer than five words are
one shingle of all their words. Null and empty texts and items match nothing; items without an id are not looked for.
Of windows of equal similarity the first counts, then the shorter. Repeated rows get equal answers, items that repeat
are one by id and text. Very long texts are read in one piece, one at a time. A column named ``leaks`` is replaced. An
empty benchmark or table gives no leaks.

The benchmark is read in slices of at most ``SLICE`` bytes, each sent to the executors as one broadcast; the documents
are gone through once for each slice, so a benchmark of any size is covered whole.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm.common import table, text_chunks
from quarry.llm.substring import run_hashes, word_hashes

SHINGLE, SIMILARITY = 5, 0.8
#: Fingerprints of texts with a similarity of 0.8 differ in 7 to 12 of 64 bits on average, most with few shingles. Of
#: 4,000 simulated pairs of each of 13 sizes none but one of five shingles differed in 24 or more.
RADIUS = 26
SLICE = 8 << 20
_BASE = np.uint64(0xA0761D6478BD642F)
_COUNT = np.array([bin(x).count("1") for x in range(256)], np.uint8)
LEAK = "array<struct<item_id:bigint,start:bigint,n_words:bigint,similarity:double>>"


def simhash(hashes: np.ndarray) -> np.ndarray:
    """Eight bytes: the bits set in over half of the hashes, repeats counted."""
    bits = np.unpackbits(np.ascontiguousarray(hashes).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    return np.packbits(bits.sum(axis=0, dtype=np.int64) * 2 > len(hashes), bitorder="little")


def weighted_jaccard(a: Counter, b: Counter) -> float:
    both = sum((a & b).values())
    return both / max(1, a.total() + b.total() - both)


def _class(span: int) -> int:
    """Sizes of two multisets with a similarity of 0.8 are in equal or neighbouring classes."""
    return min(60, int(np.log(span) / np.log(1 / SIMILARITY)))


class Items:
    """One slice of the benchmark: shingle sets, fingerprints and their block index."""

    def __init__(self, rows: list[tuple[int, str]], radius: int = RADIUS):
        self.radius = radius
        self.ids, self.sets, prints, spans, sizes = [], [], [], [], []
        self.lengths: dict[int, int] = {}
        seen: dict[int, dict[int, int]] = {}
        for item, text in rows:
            words, _ = word_hashes([(text or "").encode().lower()])
            if len(words):
                size = min(SHINGLE, len(words))
                hashes = run_hashes(words, size, _BASE)
                self.ids.append(item)
                self.lengths[len(words)] = size
                self.sets.append(Counter(hashes.tolist()))
                prints.append(simhash(hashes))
                spans.append(len(hashes))
                sizes.append(size)
                own = seen.setdefault(size, {})
                for h in hashes.tolist():
                    own[h] = own.get(h, 0) | 1 << _class(len(hashes))
        self.prints = np.array(prints, np.uint8).reshape(-1, 8)
        self.spans, self.sizes = np.array(spans, np.int64), np.array(sizes, np.int64)
        self.known, self.classes = {}, {}
        for size, own in seen.items():
            keys = np.array(sorted(own), np.uint64)
            self.known[size], self.classes[size] = keys, np.array([own[int(k)] for k in keys], np.uint64)
        # reach[j, v]: the items whose block j is within radius // 8 bits of v
        values = np.arange(256, dtype=np.uint8)
        self.reach = np.array([_COUNT[values[:, None] ^ self.prints[:, j]] <= radius // 8 for j in range(8)])

    def within(self, windows: np.ndarray, peers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(window, item) numbers of all pairs within the radius; ``peers`` are the items to look among."""
        met = np.zeros((len(windows), len(peers)), bool)
        for j in range(8):
            met |= self.reach[j][np.ix_(windows[:, j], peers)]
        w, i = np.nonzero(met)
        close = _COUNT[windows[w] ^ self.prints[peers[i]]].sum(axis=1, dtype=np.int64) <= self.radius
        return w[close], peers[i[close]]


def leaks_of(hashes: dict[int, np.ndarray], known: dict[int, np.ndarray], n: int, items: Items, similarity: float) -> list[dict]:
    """Best window for each item in one text of ``n`` words; ``known`` has the size classes of benchmark shingles."""
    best: dict[int, tuple[float, int, int]] = {}
    bits: dict[int, np.ndarray] = {}
    for length, size in sorted(items.lengths.items()):
        if length > n:
            continue
        span = length - size + 1
        around = np.uint64(sum(1 << c for c in {_class(span), max(0, _class(span) - 1), min(60, _class(span) + 1)}))
        sums = np.r_[0, np.cumsum((known[size] & around) != 0)]
        starts = np.flatnonzero(sums[span:] - sums[:-span] >= similarity * span - 1e-9)
        if not len(starts):
            continue
        if size not in bits:
            flat = np.unpackbits(np.ascontiguousarray(hashes[size]).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            bits[size] = np.vstack([np.zeros((1, 64), np.int32), np.cumsum(flat, axis=0, dtype=np.int32)])
        prints = np.packbits((bits[size][starts + span] - bits[size][starts]) * 2 > span, axis=1, bitorder="little")
        peers = np.flatnonzero((items.sizes == size) & (items.spans >= similarity * span - 1e-9) & (items.spans * similarity <= span + 1e-9))
        own: dict[int, Counter] = {}
        for w, i in zip(*(x.tolist() for x in items.within(prints, peers))):
            start = int(starts[w])
            if w not in own:
                own[w] = Counter(hashes[size][start : start + span].tolist())
            if own[w].keys().isdisjoint(items.sets[i]):
                continue  # most pairs that are near by chance alone
            found = weighted_jaccard(own[w], items.sets[i])
            if found >= similarity and (-found, start, length) < best.get(i, (0.0, 0, 0)):
                best[i] = (-found, start, length)
    return [{"item_id": items.ids[i], "start": s, "n_words": w, "similarity": -f} for i, (f, s, w) in sorted(best.items())]


def find_leaks(df: DataFrame, benchmark: DataFrame, similarity: float = SIMILARITY, text: str = "text") -> DataFrame:
    """``df`` with ``leaks``: for each benchmark item in a row's text, its best window and similarity."""
    if similarity < SIMILARITY:
        raise ValueError(f"size classes are made for a similarity of {SIMILARITY} or more")
    spark = df.sparkSession
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text"))
    items = items.where("item_id is not null and text is not null")
    total = items.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    slices = max(1, -(-total * 2 // SLICE))
    out = df.withColumn("leaks", F.array().cast(LEAK))
    for k in range(slices):
        rows = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(slices)) == k).collect()
        if rows:
            out = _scan(out, spark.sparkContext.broadcast([(r.item_id, r.text) for r in rows]), similarity, text)
    return out


def _scan(df: DataFrame, rows, similarity: float, text: str) -> DataFrame:
    names, kind = df.columns, df.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items = Items(rows.value)
        for batch in batches:
            for part in text_chunks(batch, text):
                words, first = word_hashes([(t or "").encode().lower() for t in part.column(text).to_pylist()])
                hashes = {size: run_hashes(words, size, _BASE) for size in items.known}
                known = {size: _classes(hashes[size], items.known[size], items.classes[size]) for size in items.known}
                sums = {size: np.r_[0, np.cumsum(k != 0)] for size, k in known.items()}
                least = {size: similarity * min(n - size + 1 for n, s in items.lengths.items() if s == size) for size in known}
                before = part.column("leaks").to_pylist()
                for i, (a, b) in enumerate(zip(first[:-1].tolist(), first[1:].tolist())):
                    ends = {size: max(a, b - size + 1) for size in known}
                    if any(sums[s][min(ends[s], len(known[s]))] - sums[s][min(a, len(known[s]))] >= least[s] - 1e-9 for s in known):
                        own = {s: hashes[s][a : ends[s]] for s in known}
                        before[i] = before[i] + leaks_of(own, {s: known[s][a : ends[s]] for s in known}, b - a, items, similarity)
                columns = [part.column(c) for c in names if c != "leaks"]
                leaks = pa.array(before, pa.list_(pa.struct([("item_id", pa.int64()), ("start", pa.int64()), ("n_words", pa.int64()), ("similarity", pa.float64())])))
                yield pa.RecordBatch.from_arrays([*columns, leaks], [*(c for c in names if c != "leaks"), "leaks"])

    return df.mapInArrow(run, kind)


def _classes(hashes: np.ndarray, known: np.ndarray, classes: np.ndarray) -> np.ndarray:
    """Size classes of the benchmark items with each shingle, 0 for none; a table of 20 bits settles most at once."""
    rough = np.zeros(1 << 20, bool)
    rough[(known >> np.uint64(44)).astype(np.int64)] = True
    out = np.zeros(len(hashes), np.uint64)
    at = np.flatnonzero(rough[(hashes >> np.uint64(44)).astype(np.int64)])
    place = np.minimum(np.searchsorted(known, hashes[at]), len(known) - 1)
    out[at] = np.where(known[place] == hashes[at], classes[place], np.uint64(0))
    return out


def op4_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_leaks(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    rows = found.select("doc_id", F.explode("leaks").alias("x"))
    return rows.select("doc_id", "x.item_id", F.col("x.start").alias("first_word"), "x.n_words", "x.similarity")
