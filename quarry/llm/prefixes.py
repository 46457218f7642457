"""Operator 13: prefix trie of conversations by sparse-table range minima over sorted common prefixes.

Turns become 128-bit digests, a conversation the row of its digests; equal ones are counted and stand once. The distinct
rows are sorted across the cluster and dealt by ranges (chunks of a bounded number of turns). In a chunk the lengths of
the prefixes that neighbours share get a sparse table of minima; every prefix of every row is a candidate whose member
interval is found by two binary searches over that table, to the left and to the right, all candidates independent of
each other. A prefix counts where it is first seen. What lies below a node are neighbouring entries of the chunk, so
sums over subtrees are differences of running sums.

Only prefixes shared across the border of two chunks are open: their parts are added up by digest, sums over open
descendants by one task (no more rows than borders times shared depth), and a second pass over the chunks names the
parents that the sums have settled. No group is ever larger than a chunk, however many conversations share a turn.
The ids that end in a node are hashed as a sorted stream that is never held as a whole; a conversation that many repeat
is one such stream, which one task must read (24 bytes a conversation), as a digest of all ids in order needs.

Turns are sorted by ``turn``, nulls first, equal ones by digest; null roles and texts are empty. Rows without ``conv_id``
are of no conversation and left out. Repeated rows are turns of their own. Conversations without turns are members of
the root. Other columns are not looked at. An empty table gives no node. Turns' texts may be of any length; a
conversation's digests (16 bytes a turn) are one row.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarry.llm.common import partitions, staged, table

FAMILY, HEAD = 5, 9
#: Turns of a chunk, about.
CHUNK = 200_000
NONE = hashlib.sha256(b"").hexdigest()
NODE = "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string"
PIECE = "pid int, at long, depth long, node binary, parent binary, bytes long, conv_id long, n_convs long, n_children long, n_leaves long, saved long, ends string"


def sequences(df: DataFrame) -> DataFrame:
    """``conv_id`` and ``seq``, its turns in order as ``array<struct<d, b>>``: digest (hex) and bytes of the text."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    turns = df.where("conv_id is not null").select("conv_id", "turn", F.md5(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text)).alias("d"), F.octet_length(text).cast("long").alias("b"))
    return turns.groupBy("conv_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("turn", "d", "b"))), lambda x: F.struct(x["d"].alias("d"), x["b"].alias("b"))).alias("seq"))


def with_family_heads(own: DataFrame) -> DataFrame:
    """Each conversation's first turns replaced by those of the first of its family of ``FAMILY`` ids."""
    own = own.withColumn("family", F.expr(f"conv_id - conv_id % {FAMILY}")).withColumn("h", (F.crc32(F.col("conv_id").cast("string")) % HEAD).cast("int"))
    heads = own.where("conv_id = family").select("family", F.slice("seq", 1, HEAD - 1).alias("head"))
    head = F.slice(F.coalesce("head", F.array().cast("array<struct<d:string,b:bigint>>")), F.lit(1), F.col("h"))
    rest = F.slice("seq", F.col("h") + 1, F.greatest(F.size("seq") - F.col("h"), F.lit(0)))
    return own.join(heads.hint("merge"), "family", "left").select("conv_id", F.concat(head, rest).alias("seq"))


def _ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Digest of the ids of each sequence; rows come sorted by sequence and id."""
    now, digest = None, None

    def row(sid, digest):
        return pa.RecordBatch.from_pydict({"sid": pa.array(sid, pa.string()), "ends": pa.array(digest, pa.string())})

    for batch in batches:
        sids, out = [], []
        for sid, conv in zip(batch.column("sid").to_pylist(), batch.column("conv_id").to_pylist()):
            if sid == now:
                digest.update(b",%d" % conv)
                continue
            if now is not None:
                sids.append(now), out.append(digest.hexdigest())
            now, digest = sid, hashlib.sha256(b"%d" % conv)
        if sids:
            yield row(sids, out)
    if now is not None:
        yield row([now], [digest.hexdigest()])


def _shared(a: bytes | None, b: bytes | None) -> int:
    """Turns that two rows have in common from the start; -1 if there is no such row."""
    if a is None or b is None:
        return -1
    n = min(len(a), len(b)) // 16
    differ = (np.frombuffer(a, np.uint64, 2 * n) != np.frombuffer(b, np.uint64, 2 * n)).reshape(n, 2).any(axis=1)
    return int(differ.argmax()) if differ.any() else n


def _sparse(values: np.ndarray) -> list[np.ndarray]:
    """Row j: the least of 2 ** j neighbours."""
    rows = [values]
    while 2 << (len(rows) - 1) <= len(values):
        rows.append(np.minimum(rows[-1][: -(1 << (len(rows) - 1))], rows[-1][1 << (len(rows) - 1) :]))
    return rows


class Chunk:
    """Nodes of the sorted rows of a chunk, one entry per row and depth, as arrays in the order of rows and depths."""

    def __init__(self, rows: pa.Table, before: bytes | None, after: bytes | None):
        rows = sorted(rows.select(["key", "bytes", "n", "conv_id", "ends"]).to_pylist(), key=lambda r: r["key"])
        self.keys, n = [r["key"] for r in rows], len(rows)
        lens = np.array([len(k) // 16 for k in self.keys])
        lcp = np.array([_shared(a, b) for a, b in zip([before, *self.keys], [*self.keys, after])])
        walled = lcp.copy()
        walled[[0, n]] = -1
        least = _sparse(walled)
        off = np.concatenate([[0], np.cumsum(lens + 1)])
        i = np.repeat(np.arange(n), lens + 1)
        d = np.arange(off[-1]) - off[i]
        left, right = i.copy(), i.copy()
        for j in reversed(range(len(least))):  # the longest stretch of common prefixes of d turns or more, each way
            at = right + 1
            more = (at < len(least[j])) & (least[j][np.minimum(at, len(least[j]) - 1)] >= d)
            right[more] += 1 << j
            at = left + 1 - (1 << j)
            more = (at >= 0) & (least[j][np.maximum(at, 0)] >= d)
            left[more] -= 1 << j
        own = left == i
        self.open = own & ((left == 0) & (lcp[0] >= d) | (right == n - 1) & (lcp[n] >= d))
        self.closed = own & ~self.open
        convs = np.concatenate([[0], np.cumsum([r["n"] for r in rows])])
        self.depth, self.n_convs = d, convs[right + 1] - convs[left]
        firsts = _sparse(np.array([r["conv_id"] for r in rows], np.int64))
        level = np.log2(right - left + 1).astype(int)
        self.conv_id = np.array([min(firsts[j][a], firsts[j][b + 1 - (1 << j)]) if s else 0 for j, a, b, s in zip(level, left, right, own)], np.int64)
        self.bytes = np.zeros(len(i), np.int64)
        self.bytes[d > 0] = np.concatenate([np.array(r["bytes"], np.int64) for r in rows])
        self.parent = np.where(d > 0, off[left[np.arange(len(i)) - 1]] + d - 1, -1)
        end = off[right] + lens[right] + 1

        def below(x: np.ndarray) -> np.ndarray:
            sums = np.concatenate([[0], np.cumsum(x)])
            return sums[end] - sums[:-1]

        self.saved = below(np.where(self.closed, (self.n_convs - 1) * self.bytes, 0))
        leaf = np.zeros(len(i), np.int64)
        leaf[off[1:] - 1] = lcp[1:] < lens
        self.n_leaves = below(leaf)
        self.n_children = np.bincount(self.parent[self.closed & (d > 0)], minlength=len(i))
        self.row = left
        self.ends = [r["ends"] for r in rows]
        self.last = d == lens[i]


def _pieces(key: tuple, rows: pa.Table, edges: pa.Table) -> pa.Table:
    """Parts of the open nodes of a chunk."""
    edge, out = edges.to_pylist()[0], []
    c = Chunk(rows, edge["before"], edge["after"])
    known: dict[int, bytes] = {}
    for at in np.nonzero(c.open)[0]:
        row, depth = int(c.row[at]), int(c.depth[at])
        # the digest of a prefix is that of its parent's and its last turn
        parent = known.get(int(c.parent[at]))
        known[int(at)] = hashlib.md5((parent or b"") + c.keys[row][16 * depth - 16 : 16 * depth] if depth else b"").digest()
        ends = c.ends[row] if c.last[at] else None
        out.append((edge["pid"], at, depth, known[int(at)], parent, c.bytes[at], c.conv_id[at], c.n_convs[at], c.n_children[at], c.n_leaves[at], c.saved[at], ends))
    types = [pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.binary(), *[pa.int64()] * 6, pa.string()]
    names = [x.split()[0] for x in PIECE.split(", ")]
    return pa.table([pa.array([None if v is None else v if isinstance(v, (bytes, str)) else int(v) for v in column], kind) for column, kind in zip(list(zip(*out)) or [()] * len(names), types)], names=names)


def _whole(nodes: pd.DataFrame) -> pd.DataFrame:
    """Sums over the open descendants, and the parents' least ids."""
    nodes = nodes.sort_values("depth", ascending=False)
    saved = {x: s + (n - 1) * b for x, s, n, b in zip(nodes["node"], nodes["saved"] * 0, nodes["n_convs"], nodes["bytes"])}
    children: dict[bytes, int] = {}
    for x, parent in zip(nodes["node"], nodes["parent"]):
        if parent is not None:
            saved[parent] += saved[x]
            children[parent] = children.get(parent, 0) + 1
    conv = dict(zip(nodes["node"], nodes["conv_id"]))
    return nodes.assign(
        saved_tokens=[s + saved[x] for x, s in zip(nodes["node"], nodes["saved"])], n_children=[n + children.get(x, 0) for x, n in zip(nodes["node"], nodes["n_children"])],
        parent_conv_id=pd.array([None if p is None else conv[p] for p in nodes["parent"]], "Int64"), ends_sha256=nodes["ends"].fillna(NONE))[["node", *[x.split()[0] for x in NODE.split(", ")]]]


def _nodes(key: tuple, rows: pa.Table, edges: pa.Table) -> pa.Table:
    """The nodes that lie in a chunk as a whole."""
    edge = edges.to_pylist()[0]
    c = Chunk(rows, edge["before"], edge["after"])
    for x in edge["open"] or ():
        c.conv_id[x["at"]] = x["conv_id"]
    at = np.nonzero(c.closed)[0]
    parent = pa.array(c.conv_id[np.maximum(c.parent[at], 0)], mask=c.depth[at] == 0)
    ends = [c.ends[r] if last else NONE for r, last in zip(c.row[at], c.last[at])]
    columns = [c.conv_id[at], c.depth[at], parent, c.n_convs[at], c.n_children[at], c.n_leaves[at], c.saved[at], ends]
    return pa.table([pa.array(x, kind) if not isinstance(x, pa.Array) else x for x, kind in zip(columns, [*[pa.int64()] * 7, pa.string()])], names=[x.split()[0] for x in NODE.split(", ")])


def trie(own: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """Nodes of the prefix trie of ``own`` (``conv_id``, ``seq`` as ``sequences`` gives them)."""
    spark = own.sparkSession
    digests = F.array_join(F.transform("seq", lambda x: x["d"]), "")
    rows = own.select("conv_id", F.unhex(digests).alias("key"), F.transform("seq", lambda x: x["b"]).alias("bytes"), F.md5(digests).alias("sid"))
    rows = staged(rows, "sequences")
    ends = rows.select("sid", "conv_id").repartition(partitions(spark), "sid").sortWithinPartitions("sid", "conv_id").mapInArrow(_ends, "sid string, ends string")
    same = rows.groupBy("sid").agg(F.first("key").alias("key"), F.first("bytes").alias("bytes"), F.count("*").alias("n"), F.min("conv_id").alias("conv_id"))
    same = staged(same.join(staged(ends, "ends").hint("merge"), "sid").drop("sid"), "distinct")
    turns = same.agg(F.sum(F.size("bytes"))).first()[0] or 0
    parts = max(partitions(spark), turns // chunk + 1)
    dealt = staged(same.repartitionByRange(parts, "key").withColumn("pid", F.spark_partition_id()), "chunks")
    w = Window.orderBy("pid")  # a row for each chunk
    edges = dealt.groupBy("pid").agg(F.min("key").alias("lo"), F.max("key").alias("hi")).select("pid", F.lag("hi").over(w).alias("before"), F.lead("lo").over(w).alias("after"))
    edges = staged(edges, "edges")
    parted = staged(dealt.groupBy("pid").cogroup(edges.groupBy("pid")).applyInArrow(_pieces, PIECE), "open_parts")
    nodes = parted.groupBy("node").agg(
        F.max("depth").alias("depth"), F.max("parent").alias("parent"), F.max("bytes").alias("bytes"), F.min("conv_id").alias("conv_id"), F.max("ends").alias("ends"),
        *[F.sum(x).alias(x) for x in ("n_convs", "n_children", "n_leaves", "saved")])
    nodes = staged(nodes.groupBy().applyInPandas(_whole, f"node binary, {NODE}"), "open_nodes")
    named = parted.select("pid", "at", "node").join(nodes.select("node", "conv_id").hint("merge"), "node").groupBy("pid").agg(F.collect_list(F.struct("at", "conv_id")).alias("open"))
    edges = edges.join(named.hint("merge"), "pid", "left")
    closed = dealt.groupBy("pid").cogroup(edges.groupBy("pid")).applyInArrow(_nodes, NODE)
    return closed.unionByName(nodes.drop("node"))


def op13_prefixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie(with_family_heads(sequences(table(spark, sf_dir, "conversations"))))


OP13_SQL = f"""
with recursive turns as (
  select conv_id, {{'r': coalesce(role, ''), 't': coalesce(text, '')}} as x,
         row_number() over (partition by conv_id order by turn nulls first, role, text) as i
  from conversations),
own as (select conv_id, list(x order by i) as seq from turns group by conv_id),
crc as (
  select conv_id, 0 as i, cast(conv_id as varchar) as s, 4294967295 as c from own
  union all
  select conv_id, i + 1, s, list_reduce(
    list_concat([xor(c, ord(s[i + 1]))::bigint], [1::bigint, 2, 3, 4, 5, 6, 7, 8]),
    lambda a, b: xor(a >> 1, 3988292384 * (a & 1)))
  from crc where i < length(s)),
heads as (select conv_id, cast(xor(c, 4294967295) % {HEAD} as integer) as h from crc where i = length(s)),
rebuilt as (
  select o.conv_id, list_concat(coalesce(b.seq, [])[1:h], o.seq[h + 1:]) as seq
  from own o join heads using (conv_id) left join own b on b.conv_id = o.conv_id - o.conv_id % {FAMILY}),
prefixes as (
  select conv_id, d as depth, seq[1:d] as p, seq[1:d - 1] as up, len(seq) = d as ends
  from rebuilt, unnest(generate_series(0, len(seq))) g(d)),
nodes as (
  select depth, p, any_value(up) as up, min(conv_id) as conv_id, count(*) as n_convs,
         case when depth = 0 then 0 else octet_length(encode(p[-1].t)) end as bytes,
         sha256(coalesce(string_agg(conv_id, ',' order by conv_id) filter (ends), '')) as ends_sha256
  from prefixes group by depth, p),
children as (select up as p, depth - 1 as depth, count(*) as n from nodes where depth > 0 group by all),
sums as (
  select a.depth, a.p, sum((b.n_convs - 1) * b.bytes) as saved, count(*) filter (c.n is null) as leaves
  from nodes a join nodes b on b.depth >= a.depth and b.p[1:a.depth] = a.p
  left join children c on c.depth = b.depth and c.p = b.p group by all)
select n.conv_id, n.depth, u.conv_id as parent_conv_id, n.n_convs, coalesce(c.n, 0) as n_children,
       s.leaves as n_leaves, s.saved::bigint as saved_tokens, n.ends_sha256
from nodes n join sums s on s.depth = n.depth and s.p = n.p
left join children c on c.depth = n.depth and c.p = n.p
left join nodes u on u.depth = n.depth - 1 and u.p = n.up and n.depth > 0
"""
