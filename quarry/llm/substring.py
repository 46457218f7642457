"""Operator 2: removal of repeated word sequences by difference-cover anchors.

A window is ``window`` consecutive words. Every residue modulo ``PERIOD`` is a difference of two members of ``COVER``,
so two equal windows, wherever they start, share a place below ``PERIOD`` from their starts that is a cover position
in both texts. Only the short anchors at cover positions are hashed first, a quarter of all places. A window that holds an
anchor which occurs elsewhere too is a candidate; candidates extend to the whole window, compared by 96 hash bits.

Hashes travel packed, one row per chunk of texts and bucket of hashes; a shuffle partition is one bucket. What repeats within a chunk is settled there
and sent once, so a passage that a third of all documents hold costs one entry per chunk. Answers go back as places:
the anchors that repeat, then the few candidate windows that don't.

Null and empty texts have no words; texts shorter than a window lose none. Rows with equal id and text get equal
answers and count as repeats of one another. A very long text is a chunk of its own: a task holds it with some eight
bytes of hashes for each of its words. Empty tables give empty results; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm.common import CHUNK_BYTES, mix, partitions, table, text_chunks

WINDOW = 35
PERIOD = 21
#: Perfect difference set modulo 21: each nonzero residue is one difference of members.
COVER = (3, 6, 7, 12, 14)
_BYTE, _WORD1, _WORD2 = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xD6E8FEB86659FD93))
_SEPARATORS = np.zeros(256, bool)
_SEPARATORS[[0x20, *range(0x09, 0x0E)]] = True
_ENTRY = "bucket int, h binary, g binary, k binary, p binary"


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base)
    out[:1] = 1
    return np.cumprod(out, dtype=np.uint64)


def _inverse(base: np.uint64) -> np.uint64:
    return np.uint64(pow(int(base), -1, 1 << 64))


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit hash of every word of all texts, and where each text's words begin (one more entry than texts)."""
    raw = np.frombuffer(b" ".join(texts) + b" ", np.uint8)
    first = np.cumsum([0, *(len(t) + 1 for t in texts)])
    gap = np.r_[True, _SEPARATORS[raw]]
    starts, ends = np.flatnonzero(gap[:-1] & ~gap[1:]), np.flatnonzero(~gap[:-1] & gap[1:])
    sums = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * _powers(_BYTE, len(raw)), out=sums[1:])
    hashes = mix((sums[ends] - sums[starts]) * _powers(_inverse(_BYTE), len(raw))[starts])
    return hashes, np.searchsorted(starts, first)


def run_hashes(words: np.ndarray, length: int, base: np.uint64) -> np.ndarray:
    """A hash of every run of ``length`` words, by start."""
    n = len(words) - length + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    sums = np.zeros(len(words) + 1, np.uint64)
    np.cumsum(words * _powers(base, len(words)), out=sums[1:])
    return mix((sums[length:] - sums[:n]) * _powers(_inverse(base), len(words))[:n])


def _places(first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each word, the number of its text and its place in it."""
    counts = np.diff(first)
    doc = np.repeat(np.arange(len(counts)), counts)
    return doc, np.arange(first[-1] - first[0]) - first[doc]


def _packed(h, g, k, p, buckets: int) -> pa.RecordBatch:
    bucket = (h >> np.uint64(40)).astype(np.int64) % buckets
    order = np.argsort(bucket, kind="stable")
    h, g, k, p, bucket = h[order], g[order], k[order], p[order], bucket[order]
    at = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]]) if len(bucket) else np.zeros(0, np.int64)
    to = np.r_[at[1:], len(bucket)].tolist()
    cut = lambda x: pa.array([x[a:b].tobytes() for a, b in zip(at.tolist(), to)], pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(bucket[at].astype(np.int32)), cut(h), cut(g), cut(k), cut(p)], ["bucket", "h", "g", "k", "p"])


def _same(h: np.ndarray, g: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An order by hash, and for each entry in that order whether an equal one is beside it."""
    order = np.lexsort((g, h))
    a, b = h[order], g[order]
    equal = np.r_[False, (a[1:] == a[:-1]) & (b[1:] == b[:-1])]
    return order, equal | np.r_[equal[1:], False]


def _sent(h, g, k, p, buckets: int, tell_repeats: bool) -> Iterator[pa.RecordBatch]:
    """Entries of a chunk: each hash once. Place -1 says that it repeats within the chunk and needs no answer."""
    order, many = _same(h, g)
    h, g, k, p = h[order], g[order], k[order], p[order]
    lone = ~many
    lead = many & np.r_[True, (h[1:] != h[:-1]) | (g[1:] != g[:-1])][: len(h)]
    keep = lone | lead
    yield _packed(h[keep], g[keep], k[keep], np.where(lone, p, -1)[keep].astype(np.int32), buckets)
    if tell_repeats and many.any():
        at = int(h[0] >> np.uint64(40)) % buckets
        yield pa.RecordBatch.from_arrays(
            [pa.array([at], pa.int32()), *[pa.array([x], pa.binary()) for x in (b"", b"", k[many].tobytes(), p[many].astype(np.int32).tobytes())]],
            ["bucket", "h", "g", "k", "p"])


def _buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[list[tuple[bytes, bytes, bytes, bytes]]]:
    """The rows of each bucket; rows come sorted by bucket."""
    last, rows = None, []
    for batch in batches:
        for bucket, *row in zip(*(c.to_pylist() for c in batch.columns)):
            if bucket != last and rows:
                yield rows
                rows = []
            last = bucket
            rows.append(row)
    if rows:
        yield rows


def _answers(wanted: bool):
    """Places whose hash occurs more than once (``wanted``), or those whose hash occurs once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _buckets(batches):
            told = [r for r in rows if not r[0]]
            h, g, k, p = (np.concatenate([np.frombuffer(r[i], t) for r in rows if r[0]] or [np.zeros(0, t)]) for i, t in enumerate((np.uint64, np.uint32, np.int64, np.int32)))
            order, many = _same(h, g)
            ask = order[(many == wanted) & (p[order] >= 0)]
            ks = [k[ask], *(np.frombuffer(r[2], np.int64) for r in told)]
            ps = [p[ask], *(np.frombuffer(r[3], np.int32) for r in told)]
            for a in range(0, len(ks)):
                if len(ks[a]):
                    yield pa.RecordBatch.from_arrays([pa.array(ks[a]), pa.array(ps[a])], ["k", "p"])

    return run


def _candidates(first: np.ndarray, places: list, window: int) -> np.ndarray:
    """Whether each word starts a window in its text that holds one of the text's ``places`` of repeated anchors."""
    _, at = _places(first)
    hit = np.zeros(len(at) + PERIOD, bool)
    for i, ps in enumerate(places):
        if ps is not None and len(ps):
            hit[first[i] + np.asarray(ps)] = True
    seen = np.r_[0, np.cumsum(hit)]
    n = len(at)
    return (seen[PERIOD : n + PERIOD] > seen[:n]) & (at + window <= np.repeat(np.diff(first), np.diff(first)))


def remove_repeats(df: DataFrame, window: int = WINDOW, text: str = "text", key: str = "doc_id") -> DataFrame:
    """``key``, ``n_words``, ``n_removed``, ``kept`` (the words left, joined by a space) for every row of ``df``.

    A word goes if a window that covers it has the words of another window, in the same text or another.
    """
    spark = df.sparkSession
    n = partitions(spark)
    buckets, anchor = n, window - PERIOD + 1
    if anchor < 1:
        raise ValueError(f"a window needs at least {PERIOD} words")

    def anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_chunks(batch, "t", CHUNK_BYTES // 2):
                keys = np.asarray(part.column("k"))
                words, first = word_hashes([(t or "").encode() for t in part.column("t").to_pylist()])
                h = run_hashes(words, anchor, _WORD1)
                doc, at = _places(first)
                counts = np.diff(first)[doc]
                take = np.flatnonzero(np.isin(at % PERIOD, COVER) & (at + anchor <= counts) & (counts >= window))
                if len(take):
                    yield from _sent(h[take], np.zeros(len(take), np.uint32), keys[doc[take]], at[take], buckets, True)

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            batch = batch.filter(pc.is_valid(batch.column("ps")))
            for part in text_chunks(batch, "t", CHUNK_BYTES // 2):
                keys = np.asarray(part.column("k"))
                words, first = word_hashes([(t or "").encode() for t in part.column("t").to_pylist()])
                take = np.flatnonzero(_candidates(first, part.column("ps").to_pylist(), window))
                if len(take):
                    doc, at = _places(first)
                    h, g = run_hashes(words, window, _WORD1)[take], run_hashes(words, window, _WORD2)[take]
                    yield from _sent(h, (g >> np.uint64(32)).astype(np.uint32), keys[doc[take]], at[take], buckets, False)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_chunks(batch, "t"):
                rows = []
                for t, ps, single in zip(*(part.column(c).to_pylist() for c in ("t", "ps", "single"))):
                    words = (t or "").encode().split()
                    kept = words
                    if ps:
                        starts = _candidates(np.array([0, len(words)]), [ps], window)
                        starts[np.asarray(single or [], np.int64)] = False
                        at = np.flatnonzero(starts)
                        edge = np.zeros(len(words) + 1, np.int64)
                        np.add.at(edge, at, 1)
                        np.add.at(edge, at + window, -1)
                        kept = [words[i] for i in np.flatnonzero(np.cumsum(edge[:-1]) == 0).tolist()]
                    rows.append((len(words), len(words) - len(kept), b" ".join(kept)))
                yield pa.RecordBatch.from_arrays(
                    [part.column("id"), *(pa.array(c, kind) for c, kind in zip(zip(*rows), (pa.int64(), pa.int64(), pa.binary())))],
                    ["id", "n_words", "n_removed", "kept"])

    # The windows read the same columns as the last step, so that one shuffle of the texts serves both.
    def dealt(entries: DataFrame) -> DataFrame:
        return entries.repartitionById(n, F.col("bucket")).sortWithinPartitions("bucket")

    docs = df.select(F.col(key).cast("long").alias("id"), F.col(text).cast("string").alias("t"))
    docs = docs.withColumn("k", F.xxhash64("id", "t"))
    repeated = dealt(docs.select("k", "t").mapInArrow(anchors, _ENTRY)).mapInArrow(_answers(True), "k long, p int")
    places = repeated.groupBy("k").agg(F.collect_set("p").alias("ps"))
    joined = docs.repartition(n, "k").join(places.hint("shuffle_hash"), "k", "left")
    single = dealt(joined.select("id", "k", "t", "ps").mapInArrow(windows, _ENTRY)).mapInArrow(_answers(False), "k long, p int")
    single = single.groupBy("k").agg(F.collect_set("p").alias("single"))
    return (
        joined.join(single.hint("shuffle_hash"), "k", "left").select("id", "t", "ps", "single")
        .mapInArrow(cut, "id long, n_words long, n_removed long, kept binary")
        .withColumnRenamed("id", key))


def op2_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = remove_repeats(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))
