"""Operator 13 against SQL, a trie of dictionaries, and odd tables."""

import collections
import glob
import hashlib
import os
import random
import zlib

import duckdb
import pytest

from quarry.llm import prefixes

DATA = "/root/testdata/sf0.001"
TURN = "conv_id long, turn long, role string, text string, depth long, seq string"


def brute(convs):
    """Nodes of the trie of ``{conv_id: [(role, text), ...]}``."""
    members = collections.defaultdict(list)
    for c, seq in convs.items():
        for d in range(len(seq) + 1):
            members[tuple(seq[:d])].append(c)
    children = collections.defaultdict(list)
    for p in members:
        if p:
            children[p[:-1]].append(p)
    saved, leaves, out = {}, {}, []
    for p in sorted(members, key=len, reverse=True):
        own = (len(members[p]) - 1) * (len(p[-1][1].encode()) if p else 0)
        saved[p] = own + sum(saved[x] for x in children[p])
        leaves[p] = sum(leaves[x] for x in children[p]) if children[p] else 1
        ends = sorted(c for c in members[p] if len(convs[c]) == len(p))
        out.append((min(members[p]), len(p), min(members[p[:-1]]) if p else None, len(members[p]), len(children[p]), leaves[p], saved[p], hashlib.sha256(",".join(map(str, ends)).encode()).hexdigest()))
    return sorted(map(repr, out))


def rebuilt(rows):
    own = collections.defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            own[c].append((turn is not None, turn or 0, hashlib.md5(f"{len((role or '').encode())}:{role or ''}{text or ''}".encode()).hexdigest(), role or "", text or ""))
    own = {c: [x[3:] for x in sorted(v)] for c, v in own.items()}
    out = {}
    for c, seq in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        family = c - (abs(c) % 5 if c >= 0 else -(abs(c) % 5))
        out[c] = own.get(family, [])[:h] + seq[h:]
    return out


def run(spark, rows, chunk=prefixes.CHUNK):
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], TURN)
    got = prefixes.trie(prefixes.with_family_heads(prefixes.sequences(df)), chunk)
    assert got.columns == [x.split()[0] for x in prefixes.NODE.split(", ")]
    return sorted(repr(tuple(r)) for r in got.collect())


def talk(seed, n, kinds=3):
    pick = random.Random(seed)
    return [(c, t, pick.choice(["user", "assistant"]), "é" * pick.randint(0, kinds)) for c in range(n) for t in range(pick.randint(1, 12))]


def test_equals_sql(spark):
    c = duckdb.connect()
    for path in glob.glob(f"{DATA}/*.parquet"):
        c.sql(f"create view {os.path.basename(path)[:-8]} as select * from '{path}'")
    cols = [x.split()[0] for x in prefixes.NODE.split(", ")]
    want = sorted(repr(tuple(r)) for r in c.sql(f"select {', '.join(cols)} from ({prefixes.OP13_SQL})").fetchall())
    assert sorted(repr(tuple(r)) for r in prefixes.op13_prefixes(spark, DATA).select(*cols).collect()) == want


@pytest.mark.parametrize("seed, n, kinds, chunk", [(1, 120, 1, 20), (2, 150, 0, 7), (3, 60, 40, 10**6), (4, 200, 2, 1)])
def test_equals_brute_force(spark, seed, n, kinds, chunk):
    """Few kinds of turns make long common prefixes, small chunks cut them at many places."""
    rows = talk(seed, n, kinds)
    assert run(spark, rows, chunk) == brute(rebuilt(rows))


def test_one_conversation_many_times(spark):
    rows = [(5 * c, t, "user", ["hello", "yes", "no"][t]) for c in range(400) for t in range(3)] + [(5 * c, t, "user", "other" * t) for c in range(400, 420) for t in range(c % 3 + 1)]
    got = run(spark, rows, 5)
    assert got == brute(rebuilt(rows))


def test_odd_rows(spark):
    rows = [(None, 0, "user", "of no conversation"), (10, None, None, None), (10, 0, "user", None), (10, 0, "user", "a"), (10, 0, "user", "a"), (11, None, None, None), (11, 3, "", ""), (-7, 1, "user", "a"), (-5, 1, "user", "b"), (3, 0, "user", "never seen: the head is not there"), (4, 0, "u", "x"), (20, 0, "user", "z" * 300_000)]
    rows += [(c, t, "user", "a") for c in range(30, 36) for t in range(300)]
    want = brute(rebuilt(rows))
    assert any(len(x) == 0 for x in rebuilt(rows).values())
    assert run(spark, rows) == want and run(spark, rows, 3) == want


@pytest.mark.parametrize("rows", [[], [(None, 0, "user", "x")], [(3, 0, "user", "one turn that its family's head replaces")]])
def test_empty_tables(spark, rows):
    assert run(spark, rows) == brute(rebuilt(rows))
