"""Operator 12 against SQL, brute force over every document, and odd tables."""

import collections
import glob
import math
import os
import random
import re

import duckdb
import numpy as np
import pytest

from quarry.llm import lexical

DATA = "/root/testdata/sf0.001"
TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
DOC, ITEM = "doc_id long, text string, n long, terms string", "item_id long, text string, score long, doc_id long"


def terms(x):
    return TERM.findall("".join(c.lower() if c in lexical.UPPER else c for c in x or ""))


def brute(docs, items, k):
    count = [(i, collections.Counter(terms(x))) for i, x in docs]
    count = [(i, c) for i, c in count if c]
    n_docs, n_terms = len(count), sum(c.total() for _, c in count)
    df = collections.Counter(t for _, c in count for t in c)
    out = []
    for item, text in set(items):
        scores = []
        for i, c in count:
            m = 50 + 50 * c.total() * n_docs // n_terms
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 20 * m)) for t in set(terms(text)) if c[t])
            if score > 0:
                scores.append((-score, i is None, i))
        out += [(item, r, i, -s) for r, (s, _, i) in enumerate(sorted(scores, key=lambda x: (x[0], x[1], x[2] or 0))[:k], 1)]
    return sorted(map(repr, out))


def run(spark, docs, items, k=50, **how):
    d = spark.createDataFrame([(i, x, 1, "t") for i, x in docs], DOC).repartition(3)
    q = spark.createDataFrame([(i, x, 1, 2) for i, x in items], ITEM)
    got = lexical.rank(d, q, k, **how)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    return sorted(repr(tuple(r)) for r in got.collect())


def words(seed, n, letters="abcdefg"):
    pick = random.Random(seed)
    return " ".join("".join(pick.choice(letters) for _ in range(pick.randint(1, 2))) for _ in range(n))


def test_equals_sql(spark):
    c = duckdb.connect()
    for path in glob.glob(f"{DATA}/*.parquet"):
        c.sql(f"create view {os.path.basename(path)[:-8]} as select * from '{path}'")
    rows = lambda f: sorted(map(tuple, f[sorted(f.columns)].itertuples(index=False)))
    assert rows(lexical.op12_lexical(spark, DATA).toPandas()) == rows(c.sql(lexical.OP12_SQL).df())


@pytest.mark.parametrize("docs_, postings, slice_bytes", [(16384, 1 << 19, 4 << 20), (7, 1 << 19, 60), (16384, 40, 200)])
def test_equals_brute_force(spark, monkeypatch, docs_, postings, slice_bytes):
    """Blocks of any size, several slices, ties among copies, and more documents than ``k``."""
    monkeypatch.setattr(lexical, "DOCS", docs_)
    monkeypatch.setattr(lexical, "POSTINGS", postings)
    docs = [(i, words(i % 60, 1 + i % 25)) for i in range(200)]
    items = [(i, words(i, 1 + i)) for i in range(12)]
    assert run(spark, docs, items, k=10, slice_bytes=slice_bytes) == brute(docs, items, 10)


def test_odd_texts(spark):
    docs = [(1, None), (2, ""), (3, " \n?!"), (None, "Alpha BETA"), (4, "alpha beta"), (4, "alpha beta"), (5, "alpha" * 9), (6, "ÉCOLE École école a1B2 x_y"), (7, "漢字 ２x alpha\x00beta"), (8, "alpha " * 300_000), (-9, "beta alpha")]
    items = [(1, "alpha BETA"), (1, "alpha BETA"), (1, "école École"), (2, None), (3, ""), (None, "a1b2 X Y"), (4, "nowhere"), (5, "alpha " * 50)]
    assert run(spark, docs, items) == brute(docs, items, 50)


@pytest.mark.parametrize("docs, items", [([], [(1, "a")]), ([(1, "a")], []), ([(1, None)], [(1, "a")])])
def test_empty_tables(spark, docs, items):
    assert run(spark, docs, items) == []


def test_long_texts_in_pieces(spark, monkeypatch):
    monkeypatch.setattr(lexical, "PIECE", 7)
    docs = [(i, words(i, 400)) for i in range(5)]
    items = [(1, words(3, 20))]
    assert run(spark, docs, items) == brute(docs, items, 50)


def test_sparse_table_and_fewer_scored_than_documents():
    """Range maxima equal those by scanning; a rare term keeps most documents from being looked at."""
    rng = np.random.default_rng(1)
    n, weights = 3000, np.array([5, 4000], np.int64)
    which = np.concatenate([np.zeros(n, np.int64), np.ones(20, np.int64)])
    per = [[0, 1] if i < 20 else [0] for i in range(n)]
    flat, sizes = np.concatenate(per), np.array([len(x) for x in per])
    block = lexical.Block(list(range(n)), [10] * n, flat, rng.integers(1, 9, len(flat)), sizes, weights, n, n * 10)
    assert len(which) == len(block.keys)
    for _ in range(200):
        lo, hi = sorted(rng.integers(0, n, 2))
        got = block.largest(np.array([[lo]]), np.array([[hi]]))[0, 0]
        assert block.impact[got] == (block.impact[lo:hi].max() if hi > lo else 0)
    asked, own = 0, block.largest
    def counting(a, b):
        nonlocal asked
        asked += len(a)
        return own(a, b)
    block.largest, best = counting, []
    block.search(np.array([0, 1]), best, 5)
    assert len(best) == 5 and all(-x < 20 for _, _, x in best) and asked < n / 4
