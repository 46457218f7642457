"""Operator 12: ranked lexical search by range-maximum sparse tables.

Terms are runs of ASCII letters and digits and of all other letters and signs beyond ASCII; only A-Z is lower-cased. A
first pass over the documents counts terms and keeps how often those of the items occur; term weights follow from these
counts. Documents are then searched where they lie, in blocks: a block's posting lists stand end to end, sorted by term
and document, with one sparse table that answers where the largest impact of any stretch of a list is. Each item goes
through a block best first: an interval of documents is bounded by the sum of its terms' largest impacts in it; the
interval with the largest bound is split at the document of the largest single impact, which is scored, and both rests
are bounded and wait. It ends when no bound can reach the item's ``k`` best so far, which go along from block to block
of a task; the tasks' lists are merged by rank. A few intervals are taken at once, so that numpy does the work; results
don't depend on it.

Work and memory of a task are bounded by a block (``DOCS`` documents, ``POSTINGS`` postings, or one document), whatever
the table's size. Items go to the workers in slices of about ``SLICE_BYTES``, each slice a further pass over the texts.

Null and empty texts hold no term, count nowhere and are never found; items without a term known to any document find
nothing. Rows of documents with equal ids are ranked each; rows of items with equal id and text are one item, those with
equal ids and other texts are ranked apart. Equal scores go by ascending id, null ids last. Columns beyond those named
are not looked at. Empty tables give no rows.
"""

from __future__ import annotations

import heapq
import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarry.llm.common import staged, table, text_chunks

K = 50
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SLICE_BYTES = 4 << 20
DOCS, POSTINGS = 16384, 1 << 19
#: A text is taken apart in pieces of about so many bytes.
PIECE = 1 << 20
#: Intervals that are split together.
BATCH = 32
#: For UTF-8: bytes of terms stay, A-Z lower-cased, all others become blanks.
BYTES = bytes(i if i >= 128 or chr(i).isalnum() and chr(i) not in UPPER else i + 32 if chr(i) in UPPER else 32 for i in range(256))
FOUND = "q int, item_id long, doc_id long, score long"


def terms(text: str):
    """Distinct terms of a column."""
    return F.array_distinct(F.regexp_extract_all(F.translate(text, UPPER, LOWER), F.lit(TERM), F.lit(0)))


def counted(df: DataFrame, words: list[str]) -> DataFrame:
    """``doc_id``, ``n`` (terms with repeats), and the places in ``words`` and the numbers of those that occur."""
    known = df.sparkSession.sparkContext.broadcast({x.encode(): i for i, x in enumerate(words)})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        places = known.value
        for whole in batches:
            for batch in text_chunks(whole, "text"):
                ids, ns, which, often = [], [], [], []
                for doc, text in zip(batch.column("doc_id"), batch.column("text")):
                    found, data, at = Counter(), (text.as_buffer().to_pybytes() if text.is_valid else b"").translate(BYTES), 0
                    while at < len(data):  # a long text in pieces that end with a word
                        end = data.find(b" ", at + PIECE)
                        end = end if end >= 0 else len(data)
                        found.update(data[at:end].split())
                        at = end
                    if found:
                        here = sorted(places[x] for x in found.keys() & places.keys())
                        ids.append(doc.as_py())
                        ns.append(found.total())
                        which.append(here)
                        often.append([found[names[i]] for i in here])
                columns = [pa.array(ids, pa.int64()), pa.array(ns, pa.int64()), pa.array(which, pa.list_(pa.int32())), pa.array(often, pa.list_(pa.int64()))]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n", "terms", "tfs"])

    names = [x.encode() for x in words]
    return df.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, n long, terms array<int>, tfs array<long>")


class Block:
    """Posting lists of some documents, ascending by id, with a sparse table over their impacts."""

    def __init__(self, ids: list, ns: list[int], which: np.ndarray, often: np.ndarray, sizes: np.ndarray, weights: np.ndarray, n_docs: int, n_terms: int):
        order = sorted(range(len(ids)), key=lambda i: (ids[i] is None, ids[i] or 0))
        place = np.empty(len(ids), np.int64)
        place[order] = np.arange(len(ids))
        self.ids, self.n = [ids[i] for i in order], len(ids)
        m = np.array([50 + 50 * n * n_docs // n_terms for n in ns], np.int64)
        doc = np.repeat(np.arange(len(ids)), sizes)
        keep = weights[which] > 0
        which, often, doc = which[keep], often[keep], doc[keep]
        impact = weights[which] * (1_000_000_000 * often // (1000 * often + 20 * m[doc]))
        keys = which.astype(np.int64) * self.n + place[doc]
        by = np.argsort(keys, kind="stable")
        self.keys, self.impact = keys[by], np.append(impact[by], 0)
        starts = np.searchsorted(self.keys, np.arange(len(weights) + 1) * self.n)
        self.starts = starts
        longest = int((starts[1:] - starts[:-1]).max()) if len(weights) else 0
        # row j: where the largest of 2 ** j neighbours is, the first of equals; never asked across the end of a list
        rows = [np.arange(len(self.keys), dtype=np.int32)]
        while 2 << (len(rows) - 1) <= longest:
            half, last = 1 << (len(rows) - 1), rows[-1]
            row = last.copy()
            a, b = last[:-half], last[half:]
            row[:-half] = np.where(self.impact[a] >= self.impact[b], a, b)
            rows.append(row)
        self.table = np.stack(rows)
        self.level = np.zeros(longest + 1, np.int64)
        for i in range(2, longest + 1):
            self.level[i] = self.level[i >> 1] + 1

    def largest(self, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        """Places of the largest impacts of the stretches [lo, hi) of lists; the place past the end for none."""
        size = hi - lo
        level = self.level[size]
        some = size > 0
        first = self.table[level, np.where(some, lo, 0)]
        second = self.table[level, np.where(some, hi - (1 << level), 0)]
        return np.where(some, np.where(self.impact[first] >= self.impact[second], first, second), len(self.keys))

    def search(self, query: np.ndarray, best: list, k: int) -> None:
        """Puts what is among the ``k`` best into ``best``, a heap of (score, null id, -id) with the least on top."""
        query = query[self.starts[query] < self.starts[query + 1]]
        if not len(query) or not len(self.keys):
            return
        base, waiting, held = query.astype(np.int64) * self.n, [], {}
        fresh = 0

        def put(lo, hi, a, b) -> None:
            """Intervals of documents [lo, hi), with the stretches [a, b) of each list that lie in them."""
            nonlocal fresh
            at = self.largest(a, b)
            most = self.impact[at]
            bound = most.sum(axis=1)
            top = most.argmax(axis=1)
            for i in np.nonzero((bound > 0) & (bound >= (best[0][0] if len(best) == k else 1)))[0]:
                cut = int(self.keys[at[i, top[i]]] - base[top[i]])
                heapq.heappush(waiting, (-int(bound[i]), fresh, int(lo[i]), int(hi[i]), cut))
                held[fresh] = a[i], b[i]
                fresh += 1

        put(np.zeros(1, np.int64), np.full(1, self.n), self.starts[query][None], self.starts[query + 1][None])
        while waiting:
            lo, hi, cut, a, b = [], [], [], [], []
            while waiting and len(lo) < BATCH:
                bound, i, first, last, at = heapq.heappop(waiting)
                stretch = held.pop(i)
                if len(best) == k and (-bound, *self._id(first)) <= best[0]:
                    if -bound < best[0][0]:
                        waiting.clear()
                    continue
                lo.append(first), hi.append(last), cut.append(at), a.append(stretch[0]), b.append(stretch[1])
            if not lo:
                return
            lo, hi, cut, a, b = map(np.array, (lo, hi, cut, a, b))
            where = np.searchsorted(self.keys, base[None] + cut[:, None])
            there = (where < b) & (where >= a)
            there &= self.keys[np.where(there, where, 0)] == base[None] + cut[:, None]
            score = np.where(there, self.impact[np.where(there, where, 0)], 0).sum(axis=1)
            for i in np.nonzero(score >= (best[0][0] if len(best) == k else 1))[0]:
                entry = (int(score[i]), *self._id(int(cut[i])))
                if len(best) < k:
                    heapq.heappush(best, entry)
                elif entry > best[0]:
                    heapq.heapreplace(best, entry)
            put(np.concatenate([lo, cut + 1]), np.concatenate([cut, hi]), np.concatenate([a, where + there]), np.concatenate([where, b]))

    def _id(self, place: int) -> tuple[int, int]:
        """So that of equal scores the smaller id is the greater entry, a null id the least."""
        x = self.ids[place]
        return (0, 0) if x is None else (1, -x)


def found(rows: DataFrame, queries: list[tuple[int, list[int]]], weights: list[int], n_docs: int, n_terms: int, k: int) -> DataFrame:
    """Each task's ``k`` best documents of every query: ``q``, ``item_id``, ``doc_id``, ``score``."""
    sent = rows.sparkSession.sparkContext.broadcast((queries, weights))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queries, own = sent.value
        wanted, own = [np.array(x, np.int64) for _, x in queries], np.array(own, np.int64)
        best: list[list] = [[] for _ in queries]
        held: list[pa.RecordBatch] = []

        def flush() -> None:
            if held:
                t = pa.Table.from_batches(held).combine_chunks()
                held.clear()
                lists = t.column("terms").chunk(0)
                often = t.column("tfs").chunk(0).flatten().to_numpy()
                block = Block(t.column("doc_id").to_pylist(), t.column("n").to_pylist(), lists.flatten().to_numpy(), often, lists.value_lengths().to_numpy(), own, n_docs, n_terms)
                for q, query in enumerate(wanted):
                    block.search(query, best[q], k)

        docs = postings = 0
        for batch in batches:
            at = 0
            sizes = batch.column("terms").value_lengths().to_numpy()
            for i in range(batch.num_rows):
                if docs and (docs == DOCS or postings + sizes[i] > POSTINGS):
                    held.append(batch.slice(at, i - at))
                    flush()
                    at, docs, postings = i, 0, 0
                docs, postings = docs + 1, postings + int(sizes[i])
            held.append(batch.slice(at))
        flush()
        for q, (item, _) in enumerate(queries):
            if best[q]:
                ids, scores = [-x if known else None for _, known, x in best[q]], [s for s, _, _ in best[q]]
                columns = [pa.array([q] * len(ids), pa.int32()), pa.array([item] * len(ids), pa.int64()), pa.array(ids, pa.int64()), pa.array(scores, pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, ["q", "item_id", "doc_id", "score"])

    return rows.where(F.size("terms") > 0).mapInArrow(run, FOUND)


def rank(df: DataFrame, items: DataFrame, k: int = K, slice_bytes: int = SLICE_BYTES) -> DataFrame:
    """``item_id``, ``rank``, ``doc_id`` and ``score`` of the ``k`` best documents of every item."""
    own = staged(items.select(F.col("item_id").cast("long"), "text").distinct().select("item_id", F.xxhash64("item_id", "text").alias("h"), terms("text").alias("terms")), "items")
    size = own.agg(F.sum(F.octet_length(F.array_join("terms", " ")))).first()[0] or 0
    slices = -(-size // slice_bytes)
    lists = None
    for s in range(slices):
        rows = own.where(F.pmod("h", F.lit(slices)) == s).orderBy("item_id", "h").collect()
        words = sorted({x for r in rows for x in r.terms or ()})
        place = {x: i for i, x in enumerate(words)}
        counts = staged(counted(df, words), "term_counts")
        n_docs, n_terms = counts.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
        held = dict(counts.select(F.explode("terms").alias("t")).groupBy("t").count().collect())
        weights = [math.floor(1000 * math.log((2 * n_docs + 2) / (2 * held.get(i, 0) + 1))) for i in range(len(words))]
        queries = [(r.item_id, [place[x] for x in r.terms or ()]) for r in rows]
        some = found(counts, queries, weights, n_docs, n_terms, k).withColumn("slice", F.lit(s))
        lists = some if lists is None else lists.unionByName(some)
    if lists is None:
        return df.sparkSession.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    w = Window.partitionBy("slice", "q").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return staged(lists, "found").withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")


def op12_lexical(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rank(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


OP12_SQL = f"""
with words as (
  select doc_id, unnest(regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'), '{TERM}')) as term from documents),
tf as (select doc_id, term, count(*) as tf from words group by all),
sizes as (select doc_id, count(*) as n from words group by all),
whole as (select count(*) as docs, sum(n)::bigint as terms from sizes),
df as (select term, count(*) as df from tf group by all),
items as (
  select distinct item_id, unnest(regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'), '{TERM}')) as term from benchmark),
weighed as (
  select item_id, term, cast(floor(1000 * ln((2 * docs + 2) / (2 * df + 1))) as bigint) as w
  from items join df using (term), whole),
scored as (
  select item_id, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * n * docs) // terms))))::bigint as score
  from weighed join tf using (term) join sizes using (doc_id), whole group by all)
select item_id, cast(r as integer) as rank, doc_id, score
from (select *, row_number() over (partition by item_id order by score desc, doc_id) as r from scored where score > 0)
where r <= {K}
"""
