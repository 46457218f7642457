"""Operator 11 against SQL, a plain version of the schedule, and odd tables."""

import collections
import glob
import hashlib
import os
import re

import duckdb
import pytest

from quarry.llm import mixing
from quarry.llm.common import running

DATA = "/root/testdata/sf0.001"
DOC = "doc_id long, text string, source string, size string, src long"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def frame(spark, rows):
    return spark.createDataFrame([(i, x, s, "extra", 7) for i, x, s in rows], DOC)


def plain_targets(sizes, weights=(5, 2, 1), share=1.5):
    names = sorted((x for x in sizes if x is not None), key=lambda x: x.encode()) + [None] * (None in sizes)
    w = {x: weights[i % len(weights)] for i, x in enumerate(names)}
    full, total = set(), sum(sizes.values())
    while True:
        rest = sum(w[x] for x in names if x not in full)
        level = (share * total - sum(2 * sizes[x] for x in full)) / rest if rest else 0
        new = {x for x in names if x not in full and w[x] * level > 2 * sizes[x]}
        if not new:
            return {x: 2.0 * sizes[x] if x in full else w[x] * level for x in names}
        full |= new


def plain_slots(targets, sizes, block):
    """Slots by trying every point of the grid."""
    names = sorted((x for x in sizes if x is not None), key=lambda x: x.encode()) + [None] * (None in sizes)
    cells = []
    for x in names:
        words = int(targets[x] + 0.5)
        times, rest = divmod(words, sizes[x]) if sizes[x] else (0, 0)
        cells += [x] * (times * -(-sizes[x] // block) + -(-rest // block))
    k = max(len(cells) - 1, 0).bit_length()
    out, seen = [], collections.Counter()
    for t in range(2**k):
        c = int(format(t, f"0{k}b")[::-1] or "0", 2) if k else 0
        if c < len(cells):
            x = cells[c]
            out.append((t, names.index(x), seen[x] % -(-sizes[x] // block)))
            seen[x] += 1
    return out


def run(spark, rows, **how):
    placed, pieces = mixing.mix(frame(spark, rows), **how)
    return placed.collect(), pieces.orderBy("slot", "start").collect()


def test_equals_sql(spark):
    c = duckdb.connect()
    for path in glob.glob(f"{DATA}/*.parquet"):
        c.sql(f"create view {os.path.basename(path)[:-8]} as select * from '{path}'")
    want = c.sql(mixing.OP11_SQL).df()
    got = mixing.op11_mixing(spark, DATA).toPandas()
    key = lambda f: sorted(map(tuple, f[sorted(f.columns)].itertuples(index=False)))
    assert key(got) == key(want) and (got["taken"] <= 2 * got["size"]).all()


def test_schedule_and_pieces_equal_a_plain_version(spark, monkeypatch):
    monkeypatch.setattr(mixing, "RANKED", 4)
    pick = lambda i: int(hashlib.md5(str(i).encode()).hexdigest(), 16)
    rows = [(i, " ".join(f"w{j}" for j in range(pick(i) % 40)), ["a", "b", "c", None, "é", "hot", "hot", "hot"][i % 8]) for i in range(240)]
    placed, pieces = run(spark, rows, block=10)
    sizes = collections.Counter()
    for _, x, s in rows:
        sizes[s] += len(WORD.findall(x))
    targets = plain_targets(sizes)
    names = sorted((x for x in sizes if x is not None), key=lambda x: x.encode()) + [None]
    assert {(r.s, r.source_size) for r in placed} == {(i, sizes[x]) for i, x in enumerate(names)}
    assert all(abs(r.target - targets[names[r.s]]) < 1e-6 for r in placed)
    slots = {(p.slot, p.s) for p in pieces}
    assert slots == {(t, s) for t, s, _ in plain_slots(targets, sizes, 10)}
    taken = collections.Counter()
    for p in pieces:
        taken[p.s] += p.n_words
        assert p.n_words <= 10
    assert all(taken[i] == int(targets[x] + 0.5) for i, x in enumerate(names))
    # streams have no gaps: a source's documents follow each other
    for s in range(len(names)):
        at = 0
        for r in sorted((r for r in placed if r.s == s and r.size), key=lambda r: r.start):
            assert r.start == at
            at += r.size
        assert at == sizes[names[s]]
    # the block that a slot takes is that of its rank
    blocks = {(p.slot, p.s): (p.start + p.from_word) // 10 for p in pieces}
    assert blocks == {(t, s): b for t, s, b in plain_slots(targets, sizes, 10)}
    # low discrepancy: after any number of slots every source has its part, but for a few blocks
    order, seen, total = sorted(slots), collections.Counter(), sum(targets.values())
    for n, (_, s) in enumerate(order, 1):
        seen[s] += 1
        assert all(abs(seen[i] - n * sum(1 for _, j in order if j == i) / len(order)) <= 6 for i in range(len(names))), total


def test_texts_of_pieces(spark):
    rows = [(1, "a b\tc  d e", "x"), (2, "f g h", "x"), (3, "i j", "y")]
    _, pieces = mixing.mix(frame(spark, rows), block=2)
    got = collections.Counter(w for r in mixing.piece_texts(frame(spark, rows), pieces).collect() for w in r.text.split(" "))
    assert set(got) <= set("abcdefghij") and sum(got.values()) == 15 and max(got.values()) <= 2


@pytest.mark.parametrize("rows", [[], [(1, None, None)], [(1, "", "a"), (2, " \n", "")], [(1, "one", None), (None, "two words", None), (None, "two words", ""), (1, "one", None)]])
def test_odd_tables(spark, rows):
    placed, pieces = run(spark, rows)
    assert len(placed) == len(rows) and sum(r.size for r in placed) == sum(len(WORD.findall(x or "")) for _, x, _ in rows)
    goal = {r.s: r.target for r in placed}
    assert sum(p.n_words for p in pieces) == sum(int(x + 0.5) for x in goal.values())
    assert run(spark, rows) == (placed, pieces) or sorted(map(tuple, run(spark, rows)[1])) == sorted(map(tuple, pieces))


def test_a_long_text_and_many_copies(spark):
    long = " ".join(["word"] * 300_000)
    placed, pieces = run(spark, [(0, long, "a")] + [(i, "same words here", "b") for i in range(1, 400)])
    taken = collections.Counter()
    for p in pieces:
        taken[(p.s, p.start)] += p.n_words
    assert all(taken[(r.s, r.start)] <= 2 * r.size for r in placed) and sum(taken.values()) == sum(int(x + 0.5) for x in {r.s: r.target for r in placed}.values())


def test_running_sums(spark):
    df = spark.range(1000).selectExpr("id", "id % 7 as x")
    got = {r.id: r.n for r in running(df, ["id"], {"n": "x"}, "t").collect()}
    assert all(got[i] == sum(j % 7 for j in range(i + 1)) for i in range(0, 1000, 37)) and len(got) == 1000
    assert running(df.where("id < 0"), ["id"], {"n": "x"}, "t").count() == 0
