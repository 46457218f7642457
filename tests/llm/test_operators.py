"""The ten operators against brute force, libraries and round trips, with the odd cases of each."""

import collections
import hashlib
import random
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from quarry.llm import bpe, chat, groups, html, leaks, lines, nearest, quality, registry, simhash, substring, warc
from quarry.llm.common import table
from quarry.llm.components import connected_components

DATA = "/root/testdata/sf0.001"
DOC = "doc_id long, text string, lang string, source string, n_chars long, k string, id int"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def docs(spark, texts, sources=None):
    rows = [(i, x, "en", (sources or {}).get(i, f"s{(i or 0) % 3}"), len(x or ""), "extra", i) for i, x in texts]
    return spark.createDataFrame(rows, DOC)


def prose(seed, n):
    pick = random.Random(seed)
    return " ".join("".join(pick.choice("abcdefghij") for _ in range(pick.randint(2, 7))) for _ in range(n))


def sha(x):
    return hashlib.sha256(x.encode()).hexdigest()


ODD = [(1, None), (2, ""), (3, " \n\t "), (4, "word"), (5, "two words"), (None, "no id here"), (7, "same row again"), (7, "same row again"), (8, prose(1, 60_000))]


# --- 1 BPE


def test_bpe_equals_library(spark):
    import tokenizers

    library = tokenizers.Tokenizer.from_file(bpe.default_vocabulary())
    texts = [x for _, x in ODD] + ["Don't we'LL <|endoftext|>x<|startoftext|>", "É Σς İ 漢字 １２ ²³ 😀 á Ᲊ힣", "x" * 3000, "!!!???" * 50]
    got = bpe.encode_decode(docs(spark, list(enumerate(texts))), bpe.default_vocabulary()).collect()
    assert len(got) == len(texts)
    for r in got:
        ids = library.encode(texts[r.doc_id] or "", add_special_tokens=False).ids
        assert r.n_tokens == len(ids) and r.ids == " ".join(map(str, ids)) and r.decoded == library.decode(ids, skip_special_tokens=False)


def test_bpe_random_words():
    import tokenizers

    library, own = tokenizers.Tokenizer.from_file(bpe.default_vocabulary()), bpe._tokenizer(open(bpe.default_vocabulary()).read())
    pick = random.Random(3)
    for _ in range(3000):
        text = "".join(pick.choice("aaabcdeeehinorstt '’.,0é\n") for _ in range(pick.randint(0, 50)))
        ids = own.encode(text)
        assert ids == library.encode(text, add_special_tokens=False).ids and own.decode(ids) == library.decode(ids, skip_special_tokens=False)


def test_automaton_accepts_only_what_bpe_makes():
    """On a small vocabulary, all paths of the automaton are the tokenizations of their own strings."""
    merges = [("a", "b"), ("b", "a"), ("ab", "a"), ("a", "a"), ("aa", "b")]
    vocab = {t: i for i, t in enumerate(["a", "b", *[x + y for x, y in merges]])}
    machine = bpe.Automaton(vocab, merges, "$")

    def plain(word):
        parts = list(word)
        for x, y in merges:
            i, out = 0, []
            while i < len(parts):
                two = i + 1 < len(parts) and parts[i] == x and parts[i + 1] == y
                out.append(x + y if two else parts[i])
                i += 2 if two else 1
            parts = out
        return [vocab[p] for p in parts]

    def walk(path, state, text):
        if text:
            assert plain(text) == path
        for token, i in vocab.items():
            if len(text) + len(token) <= 7 and machine.arc(state, i):
                seen.add(text + token)
                walk([*path, i], machine.target[i], text + token)

    seen = set()
    walk([], 0, "")
    assert len(seen) == sum(2**n for n in range(1, 8))


# --- 2 substring


def removed_by_force(texts, window=substring.WINDOW):
    split = [WORD.findall(x or "") for x in texts]
    seen = collections.Counter(tuple(w[i : i + window]) for w in split for i in range(len(w) - window + 1))
    out = []
    for w in split:
        gone = [False] * len(w)
        for i in range(len(w) - window + 1):
            if seen[tuple(w[i : i + window])] > 1:
                gone[i : i + window] = [True] * window
        out.append((len(w), sum(gone), " ".join(x for x, g in zip(w, gone) if not g)))
    return out


def test_substring_equals_brute_force(spark):
    assert {(a - b) % substring.PERIOD for a in substring.COVER for b in substring.COVER} == set(range(substring.PERIOD))
    shared, other = prose(11, 80), prose(12, 35)
    texts = [x for _, x in ODD if x is None or len(x) < 10_000]
    texts += [prose(i, 30 + i) + " " + shared + " " + prose(i + 50, 20) for i in range(6)] + [f"{prose(77, 9)} {other}", f"{other}\t{prose(78, 50)} {other}", prose(5, 34), prose(5, 34), prose(6, 36), "la " * 200, shared[10:]]
    got = substring.remove_repeats(docs(spark, list(enumerate(texts)))).collect()
    assert {r.doc_id: (r.n_words, r.n_removed, r.kept.decode()) for r in got} == dict(enumerate(removed_by_force(texts)))


def test_substring_whole_table_and_odd_rows(spark):
    rows = table(spark, DATA, "documents").select("doc_id", "text").collect()
    want = {r.doc_id: x for r, x in zip(rows, removed_by_force([r.text for r in rows]))}
    for r in substring.op2_substring(spark, DATA).collect():
        assert (r.n_words, r.n_removed, r.kept_sha256) == (*want[r.doc_id][:2], sha(want[r.doc_id][2]))
    odd = substring.remove_repeats(docs(spark, ODD))
    assert odd.count() == len(ODD) and odd.agg(F.sum("n_removed")).first()[0] == 0
    assert substring.remove_repeats(docs(spark, ODD).limit(0)).count() == 0


# --- 3 lines, 6 WARC, 9 chat: SQL


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_equals_sql(spark, name):
    import glob
    import os

    import duckdb

    c = duckdb.connect()
    for path in glob.glob(f"{DATA}/*.parquet"):
        c.sql(f"create view {os.path.basename(path)[:-8]} as select * from '{path}'")
    want = c.sql(registry.oracle_sql()[name])
    got = registry.queries()[name](spark, DATA).select(*want.columns).collect()
    assert sorted(repr(tuple(r)) for r in got) == sorted(repr(tuple(r)) for r in want.fetchall())


def test_lines_odd_rows(spark):
    text = {i: f"own {i} with quite a few more words\nshared line\n \n{prose(i, 8)}" for i in range(12)}
    rows = docs(spark, [*text.items(), *[(i + 20, x) for i, (_, x) in enumerate(ODD)]], {i: f"site{i}" for i in text}).withColumn("n_lines", F.lit("clash"))
    got = {r.doc_id: r for r in lines.remove_boilerplate(rows, min_sites=10).collect()}
    assert all(got[i].n_removed == 1 and "shared" not in got[i].text and got[i].n_lines == 4 for i in text)
    assert got[20].n_lines == 0 and got[20].text is None and got[21].n_lines == 1
    near = docs(spark, [(i, f"{prose(i, 20)}\nnine sites") for i in range(9)], {i: f"site{i}" for i in range(9)})
    assert lines.remove_boilerplate(near, min_sites=10).agg(F.sum("n_removed")).first()[0] == 0
    copies = docs(spark, [(i, "all of it\nis shared by all") for i in range(12)], {i: f"site{i}" for i in range(12)})
    assert lines.remove_boilerplate(copies, min_sites=10).agg(F.sum("n_removed")).first()[0] == 0
    assert lines.remove_boilerplate(rows.limit(0)).count() == 0
    # the same notice goes from pages of little else, once it stands beside other texts on ten sites
    pages = [*((i, f"{prose(i, 20)}\nall rights reserved by us") for i in range(10)), (50, "all rights reserved by us"), (51, "hi\nall rights reserved by us"), (51, "hi\nall rights reserved by us"), *((60 + i, f"a copied article\nof two lines on many sites\n{'x' * i}") for i in range(12))]
    got = collections.defaultdict(set)
    for r in lines.remove_boilerplate(docs(spark, pages, {i: f"site{i}" for i, _ in pages}), min_sites=10).collect():
        got[r.doc_id].add((r.text, r.n_removed))
    assert all(len(got[i]) == 1 and all(n == 1 for _, n in got[i]) for i in (*range(10), 50, 51)) and got[50] == {("", 1)} and got[51] == {("hi", 1)}
    assert all(n == 0 for i in range(60, 72) for _, n in got[i])


def test_warc_files_and_audit(spark, tmp_path):
    rows = [(i, f"http://x/{i}", f"<p>page é {i}</p>\r\n\r\nWARC/1.0" * (i % 5)) for i in range(60)] + [(60, None, None), (61, "u", "same"), (61, "u", "same")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    warc.write_warc(pages.limit(60), str(tmp_path / "w"), per_file=25)
    back = warc.read_warc(spark, str(tmp_path / "w")).collect()
    assert sorted(r.payload.decode() for r in back) == sorted(x[2] for x in rows[:60])
    good = warc.fixity(pages, per_file=25)
    assert warc.audit(good, good).count() == 0 and good.count() == len(rows)
    bad = warc.fixity(pages.where("page_id <> 24").withColumn("html", F.when(F.col("page_id") == 7, "<p>page é x</p>" * 2).otherwise(F.col("html"))), per_file=25)
    found = {(r.page_id, r.kind) for r in warc.audit(good, bad).collect()}
    assert found == {(7, "content"), (24, "lost")}
    empty = good.limit(0)
    assert warc.audit(empty, empty).count() == 0 and warc.audit(good, empty).count() == len(rows)


@pytest.mark.parametrize("gone, more, want", [
    ([0], [], {(0, "lost")}), ([5], [], {(5, "lost")}), ([5, 6, 39], [], {(5, "lost"), (6, "lost"), (39, "lost")}), ([], [(40, "u", "new")], {(40, "added")}),
    ([5], [(5, "u", "other")], {(5, "content")}), ([], [(5, "u", "again")], {(5, "added")}), ([], [(7, "http://x/7", "page 7")], {(7, "added")}),
    ([3, 5], [(3, "u", "x"), (3, "u", "y"), (None, "u", "z")], {(3, "content"), (3, "added"), (5, "lost"), (None, "added")})])
def test_warc_lost_and_added_records(spark, gone, more, want):
    rows = [(i, f"http://x/{i}", f"page {i}") for i in range(40)]
    one, two = (spark.createDataFrame(x, "page_id long, url string, html string") for x in (rows, [r for r in rows if r[0] not in gone] + more))
    for per_file in (1000, 7):
        found = warc.audit(warc.fixity(one, per_file), warc.fixity(two, per_file)).collect()
        assert {(r.page_id, r.kind) for r in found} == want and len(found) == len(want)
        assert all((r.digest_a is None) == (r.kind == "added") and (r.digest_b is None) == (r.kind == "lost") for r in found)


def test_warc_moved_records(spark):
    """Replicas whose files have another order: swapped neighbours, one record carried to the end, and a lost one besides."""
    def replica(order):
        size, rows = 10, []
        for seq, i in enumerate(order):
            rows.append((0, seq, i, seq * size, seq * size + size, f"d{i}"))
        return spark.createDataFrame(rows, "file long, seq long, page_id long, start long, stop long, digest string")

    same = list(range(40))
    swapped = [0, 1, 2, 4, 3, *range(5, 40)]
    carried = [*range(0, 7), *range(8, 40), 7]
    got = lambda order: {(r.page_id, r.kind) for r in warc.audit(replica(same), replica(order)).collect()}
    assert got(same) == set() and got(swapped) == {(3, "moved"), (4, "moved")} and got(carried) == {(7, "moved")}
    assert got([x for x in carried if x != 20]) == {(7, "moved"), (20, "lost")}


def test_chat_layouts(spark):
    records = {
        1: '{"prompt":"a","response":"b<|im_end|>\\\\p"}', 2: '{"instruction":"i","output":"o"}', 3: '{"system":"s","instruction":"i","output":"o"}', 4: '{"messages":[{"role":"user","content":"x\\ny"},{"role":"assistant","content":null}]}',
        5: '{"conversations":[{"from":"human","value":"q"},{"from":"gpt","value":"r"}]}', 6: '{"strange":1}', 7: "not json", 8: None, 9: '{"prompt":"a","completion":"c"}', 10: '{"messages":[]}'}
    frame = spark.createDataFrame(list(records.items()), "conv_id long, record string").withColumn("layout", F.lit("clash"))
    out = chat.format_chats(frame).withColumn("turns", chat.read_turns(F.col("formatted")))
    got = {r.conv_id: (r.layout, [(t.role, t.text) for t in r.turns], [r.formatted[s.start : s.start + s.length] for s in r.loss_mask]) for r in out.collect()}
    assert got[1] == ("prompt", [("user", "a"), ("assistant", "b<|im_end|>\\p")], ["b\\pim_end|>\\bp"])
    assert got[2][0] == "instruction" and got[3][1][0] == ("system", "s") and got[5][1] == [("user", "q"), ("assistant", "r")] and got[9][0] == "completion"
    assert got[4] == ("messages", [("user", "x\ny"), ("assistant", "")], [""])
    assert got[6] == got[7] == got[8] == ("unknown", [], [])


def test_chat_rows(spark, tmp_path):
    rows = [(1, 2, "assistant", "<|im_start|>user\nhi\\n"), (1, 1, "us\\n\ner<|", None), (2, 1, None, "x" * 100_000), (3, 1, "user", "t"), (3, 1, "user", "t")]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    frame.write.parquet(str(tmp_path / "conversations.parquet"))
    got = {r.conv_id: r for r in chat.op9_chat(spark, str(tmp_path)).collect()}
    assert got[1].turns_sha256 == sha("us\\n\ner<|\n\nassistant\n<|im_start|>user\nhi\\n\n") and got[1].loss_sha256 == sha(rows[0][3]) and got[1].loss_chars == len(rows[0][3])
    assert got[3].n_turns == 2 and got[2].loss_chars == 0 and got[-1].n_turns == 2 and got[-1].loss_chars == len("<|im_end|><|im_start|>assistant ok")


def test_chat_odd_roles_and_orders(spark, tmp_path):
    rows = [(1, 1, "user,assistant", "x"), (2, 1, "user", "b"), (2, None, "assistant", "a"), (2, None, "assistant", "a"), (3, 1, "user,system", "t"), (3, 2, "assistant", "u"), (4, 1, "system,user", "s"), (4, 2, "assistant", "u"), (None, 1, "user", "n")]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(str(tmp_path / "conversations.parquet"))
    got = {r.conv_id: r for r in chat.op9_chat(spark, str(tmp_path)).collect()}
    assert got[1].turns_sha256 == sha("user,assistant\nx\n") and got[1].loss_chars == 0 and got[None].n_turns == 1
    assert got[2].turns_sha256 == sha("assistant\na\nassistant\na\nuser\nb\n") and got[2].loss_chars == 2
    assert got[3].turns_sha256 == sha("user,system\nt\nassistant\nu\n") and got[4].loss_sha256 == sha("u")
    (tmp_path / "none").mkdir()
    spark.createDataFrame([], "conv_id long, turn long, role string, text string").write.parquet(str(tmp_path / "none" / "conversations.parquet"))
    assert [r.conv_id for r in chat.op9_chat(spark, str(tmp_path / "none")).collect()] == [-1]


def test_chat_long_records(spark):
    """Beyond the limits of a JSON value nothing is lost, and what is no JSON stays unknown."""
    text = F.repeat(F.lit('a\\"<|{:"\n'), 2 << 20)
    record = F.to_json(F.struct(F.array(F.struct(F.lit("user").alias("role"), text.alias("content")), F.struct(F.lit("assistant").alias("role"), F.lit("ok").alias("content"))).alias("messages")))
    out = chat.format_chats(spark.range(2).select("id", F.when(F.col("id") == 0, record).otherwise(F.substr(record, F.lit(1), F.char_length(record) - 2)).alias("record")))
    turns = chat.read_turns(F.col("formatted"))
    good, bad = out.orderBy("id").select("layout", F.size(turns).alias("n"), F.char_length(F.get(turns, F.lit(0))["text"]).alias("chars"), F.coalesce(F.get(turns, F.lit(0))["text"] == text, F.lit(False)).alias("same")).collect()
    assert good == ("messages", 2, 9 * (2 << 20), True) and bad[:2] == ("unknown", 0)


# --- 4 leaks


def leaks_by_force(texts, items, similarity=leaks.SIMILARITY):
    def cut(words, size):
        return collections.Counter(tuple(words[i : i + size]) for i in range(len(words) - size + 1))

    low = lambda x: (x or "").encode().lower().split()
    out = {}
    for d, text in texts:
        words = low(text)
        for n in {len(low(x)) for _, x in items} - {0}:
            size = min(5, n)
            for at in range(len(words) - n + 1):
                own = cut(words[at : at + n], size)
                for i, x in items:
                    w = low(x)
                    if w and min(5, len(w)) == size:
                        other = cut(w, size)
                        both = sum((own & other).values())
                        s = both / (own.total() + other.total() - both)
                        if s >= similarity:
                            out[d, i] = max(out.get((d, i), 0), s)
    return out


def test_leaks_equal_brute_force(spark):
    items = [(i, prose(100 + i, 15 + 3 * i)) for i in range(8)] + [(8, None), (9, ""), (10, "three small words"), (11, prose(100, 15))]
    word = items[5][1].split()
    texts = [(1, f"{prose(1, 40)} {items[3][1].upper()} {prose(2, 9)}"), (2, prose(3, 60)), (3, " ".join([*word[:14], "changed", *word[15:]])), (4, items[0][1]), (5, "so three small words here"), (6, " ".join(word[:20])), (7, None), (8, "")]
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    found = leaks.find_leaks(docs(spark, texts).withColumn("leaks", F.lit("clash")), benchmark).collect()
    got = {(r.doc_id, x.item_id): x.similarity for r in found for x in r.leaks}
    want = leaks_by_force(texts, items)
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-12 for k in got) and (1, 3) in got and (4, 11) in got and (5, 10) in got
    assert leaks.find_leaks(docs(spark, ODD), benchmark.limit(0)).where("size(leaks) > 0").count() == 0
    assert leaks.find_leaks(docs(spark, ODD).limit(0), benchmark).count() == 0
    assert leaks.find_leaks(docs(spark, ODD), benchmark).count() == len(ODD)


def test_radius_of_leaks_loses_nothing_to_speak_of():
    pick = np.random.default_rng(4)
    for n in (5, 8, 15, 30, 60, 100):
        whole = pick.integers(0, 2**63, size=(3000, n), dtype=np.uint64) * np.uint64(2) + pick.integers(0, 2, size=(3000, n), dtype=np.uint64)
        part = whole[:, : int(np.ceil(0.8 * n - 1e-9))]
        far = sum(np.unpackbits(leaks.simhash(a) ^ leaks.simhash(np.ascontiguousarray(b))).sum() > leaks.RADIUS for a, b in zip(whole, part))
        assert far <= 1, n


def test_leak_with_insertion_meets_windows_of_a_longer_item(spark):
    items = [(1, prose(300, 100)), (2, prose(301, 108))]
    word = items[0][1].split()
    texts = [(1, " ".join([prose(302, 30), *word[:50], prose(303, 8), *word[50:], prose(304, 30)])), (2, prose(305, 300))]
    found = leaks.find_leaks(docs(spark, texts), spark.createDataFrame(items, "item_id long, text string")).collect()
    got = {(r.doc_id, x.item_id): x.similarity for r in found for x in r.leaks}
    want = leaks_by_force(texts, items)
    assert want.keys() == {(1, 1)} and got.keys() == want.keys() and abs(got[1, 1] - want[1, 1]) < 1e-12


# --- 5 nearest


def test_nearest_recall_and_odd_rows(spark):
    rows = table(spark, DATA, "embeddings").select("vec_id", "embedding").collect()
    extra = [(10_000, None), (10_020, [0.0] * 64), (10_040, [float("nan")] * 64), (10_060, [None] * 64), (None, rows[0].embedding), (10_080, [1.0]), (10_100, rows[1].embedding), (10_101, rows[1].embedding), (10_102, rows[1].embedding)]
    frame = spark.createDataFrame([tuple(r) for r in rows] + extra, "vec_id long, embedding array<float>").withColumn("id", F.lit("clash"))
    got = collections.defaultdict(list)
    for r in nearest.nearest(frame, "vec_id % 20 = 0").orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.vec_id, r.score))
    all_ = {i: np.array(v, float) for i, v in [tuple(r) for r in rows] + extra[6:]}
    ids, x = np.array(list(all_)), np.array(list(all_.values()))
    hit = n = 0
    for q in [i for i in all_ if i % 20 == 0]:
        s = x @ all_[q]
        order = [int(ids[j]) for j in np.lexsort((ids, -s)) if ids[j] != q][:20]
        hit += len({v for v, _ in got[q]} & set(order))
        n += 20
        assert len(got[q]) == 20 and all(abs(sc - float(all_[v] @ all_[q])) < 1e-9 for v, sc in got[q])
    assert set(got) == {i for i in all_ if i % 20 == 0} and hit / n >= 0.9
    assert [v for v, _ in got[10_100]][:3] == [rows[1].vec_id, 10_101, 10_102]
    assert nearest.nearest(frame.limit(0), "vec_id % 20 = 0").count() == 0


def test_nearest_ties_go_to_smaller_ids(spark):
    """Over a hundred distinct vectors with one inner product: the least ids, however the codes fall."""
    pick = np.random.default_rng(5)
    query = [1.0] + [0.0] * 7
    tied = [[0.5, *row] for row in pick.normal(size=(150, 7)).tolist()]
    rows = [(0, query)] + [(i + 1, v) for i, v in enumerate(tied)] + [(1001 + i, [0.25, *row]) for i, row in enumerate(pick.normal(size=(200, 7)).tolist())]
    order = pick.permutation(len(rows)).tolist()
    frame = spark.createDataFrame([rows[i] for i in order], "vec_id long, embedding array<double>")
    got = nearest.nearest(frame, "vec_id = 0").orderBy("rank").collect()
    assert [r.vec_id for r in got] == list(range(1, 21)) and all(r.score == 0.5 for r in got)
    short = spark.createDataFrame([(0, [1.0, 1.0]), (1, [2.0]), (2, [1.0, 2.0]), (3, [3.0]), (20, [1e200, 1e200])], "vec_id long, embedding array<double>")
    got = nearest.nearest(short, "vec_id % 20 = 0").orderBy("query_id", "rank").collect()
    assert [(r.query_id, r.vec_id) for r in got] == [(0, 20), (0, 2), (20, 2), (20, 0)]


@pytest.mark.parametrize("size", ["sf0.01", "sf0.1"])
def test_nearest_recall_of_whole_table(spark, size):
    frame = table(spark, f"/root/testdata/{size}", "embeddings")
    got = nearest.op5_nearest(spark, f"/root/testdata/{size}").toPandas().groupby("query_id").vec_id.agg(set)
    rows = frame.select("vec_id", "embedding").toPandas().sort_values("vec_id")
    ids, x = rows.vec_id.to_numpy(), np.array(rows.embedding.tolist(), float)
    hit = 0
    for q in ids[ids % 20 == 0]:
        s = x @ x[np.searchsorted(ids, q)]
        s[ids == q] = -np.inf
        hit += len(got[q] & set(ids[np.lexsort((ids, -s))[:20]].tolist()))
    assert hit / (20 * len(got)) >= 0.9 and len(got) == (ids % 20 == 0).sum()


def test_nearest_recall_with_outliers(spark):
    """A few rows a thousand times as long as the others: angles alone say little about inner products."""
    pick = np.random.default_rng(1)
    x = pick.normal(size=(5000, 64)) * np.where(pick.random((5000, 1)) < 0.002, 1000, 1)
    frame = spark.createDataFrame(list(enumerate(x.tolist())), "vec_id long, embedding array<double>")
    got = nearest.nearest(frame, "vec_id % 20 = 0").toPandas().groupby("query_id").vec_id.agg(set)
    hit = 0
    for q in range(0, 5000, 20):
        s = x @ x[q]
        s[q] = -np.inf
        hit += len(got[q] & set(np.argsort(-s)[:20].tolist()))
    assert len(got) == 250 and hit / (20 * len(got)) >= 0.9


def test_radius_is_whole():
    """The index returns every code of the ball that it stops at."""
    pick = np.random.default_rng(2)
    block = np.packbits(pick.random((500, 128)) < 0.5, axis=1)
    index = nearest.Index(block)
    for query in np.packbits(pick.random((20, 128)) < 0.5, axis=1):
        d = np.bitwise_count(block ^ query).sum(axis=1)
        rows = index.within(query, 50)
        assert len(rows) >= 50 and set(rows) == set(np.flatnonzero(d <= d[rows].max()))


# --- 7 quality


def test_quality_held_out_and_odd_rows(spark):
    d, y = table(spark, "/root/testdata/sf0.01", "documents"), table(spark, "/root/testdata/sf0.01", "labels")
    classifier = quality.train(d, y.where("doc_id % 3 <> 0"))
    held = quality.score(d.join(y.where("doc_id % 3 = 0"), "doc_id"), classifier).toPandas()
    assert ((held.quality_score >= 0.5) == (held.quality == 1)).mean() >= 0.95 and ((held.toxic_score >= 0.5) == (held.toxic == 1)).mean() >= 0.9
    odd = docs(spark, ODD).withColumn("quality_score", F.lit("clash")).withColumn("source", F.lit(None).cast("string"))
    got = quality.score(odd, classifier)
    assert got.count() == len(ODD) and got.where("quality_score between 0 and 1 and toxic_score between 0 and 1").count() == len(ODD)
    nothing = quality.train(docs(spark, ODD), y.limit(0))
    assert quality.score(docs(spark, ODD), nothing).where(quality.accepted()).count() == len(ODD)
    assert quality.score(docs(spark, ODD).limit(0), classifier).count() == 0


# --- 8 SimHash


def print_by_force(text):
    words = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    cut = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] if len(words) > 3 else [" ".join(words)] if words else []
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in cut]
    return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h))


def classes_by_force(prints):
    ids = [i for i, _ in prints]
    root = {i: i for i in ids}
    moved = True
    while moved:
        moved = False
        for i, a in prints:
            for j, b in prints:
                if (a ^ b).bit_count() <= 3 and root[i] != root[j]:
                    root[i] = root[j] = min(root[i], root[j])
                    moved = True
    return root


def test_simhash_equals_brute_force(spark):
    base = prose(40, 300).split()
    texts = [(10 + i, " ".join([*base[:i], "x", *base[i + 1 :]])) for i in range(12)] + [(40, None), (41, ""), (42, "A b"), (43, "a B"), (44, "É a b c"), (45, prose(41, 60_000)), (46, "one two three"), (47, "one two three four")]
    got = {r.doc_id: r for r in simhash.components(simhash.fingerprints(docs(spark, texts))).collect()}
    prints = [(i, print_by_force(x)) for i, x in texts if i != 45]
    assert all(got[i].fp & (1 << 64) - 1 == p for i, p in prints)
    prints.append((45, got[45].fp & (1 << 64) - 1))
    assert {i: r.component_id for i, r in got.items()} == classes_by_force(prints)
    odd = simhash.components(simhash.fingerprints(docs(spark, ODD)))
    assert odd.count() == len(ODD) and odd.where("doc_id = 1").first().component_id == 1
    assert simhash.components(simhash.fingerprints(docs(spark, ODD).limit(0))).count() == 0


def test_pigeonhole_is_whole(spark):
    """Planted chains of fingerprints at one to three bits are joined, others are not, whatever the plan."""
    pick = random.Random(9)
    prints = []
    for _ in range(40):
        at = pick.getrandbits(64)
        for _ in range(pick.randint(1, 5)):
            prints.append(at)
            for b in pick.sample(range(64), pick.randint(1, 3)):
                at ^= 1 << b
    rows = [(i, p - (1 << 64) if p >= 1 << 63 else p) for i, p in enumerate(prints)]
    got = simhash.components(spark.createDataFrame(rows, "doc_id long, fp long")).collect()
    assert {r.doc_id: r.component_id for r in got} == classes_by_force(list(enumerate(prints)))
    groups_, thresholds = simhash.plan_thresholds(10**7, np.full((64, 64), 25e5) + np.eye(64) * 25e5, 3)
    assert sum(t + 1 for t in thresholds) == 4 and sorted(b for g in groups_ for b in g) == list(range(64))


def test_long_lists_are_compared_in_parts(spark):
    """With lists of four at most nearly every list is split; classes stay those of brute force."""
    pick = random.Random(31)
    prints = []
    for _ in range(3):
        at = pick.getrandbits(64)
        for _ in range(25):
            prints.append(at)
            for b in pick.sample(range(64), pick.randint(1, 4)):
                at ^= 1 << b
    rows = [(p - (1 << 64) if p >= 1 << 63 else p,) for p in prints]
    fps = spark.createDataFrame(rows, "fp long").distinct()
    got = {r.node: r.root for r in connected_components(simhash.near_links(fps, 3, longest=4)).collect()}
    classes = classes_by_force(list(enumerate(prints)))
    by_root = collections.defaultdict(set)
    for i, (p,) in enumerate(rows):
        by_root[classes[i]].add(p)
    assert {frozenset(x) for x in by_root.values()} == {
        frozenset(x) for x in [*({n for n, r in got.items() if r == root} for root in set(got.values())), *({p} for (p,) in rows if p not in got)]}
    lists = spark.createDataFrame([(0, 1, i) for i in range(50)] + [(0, 2, 99)], "g int, v long, fp long")
    split = simhash.split_lists(lists, 10).collect()
    together = collections.defaultdict(set)
    for r in split:
        together[r.v, r.u].add(r.fp)
    assert all(any({a, b} <= x for (v, _), x in together.items() if v == 1) for a in range(50) for b in range(50)) and max(map(len, together.values())) < 25


def test_correlated_bits_are_seen(spark):
    """Eight bits that go together agree in half of all pairs, whatever their single counts say."""
    pick = random.Random(32)
    rows = [((255 if pick.random() < 0.5 else 0) | pick.getrandbits(20) << 8,) for _ in range(4000)]
    shares = simhash.seen_differences(spark.createDataFrame(rows, "fp long"), [255, simhash.as_mask(list(range(8, 16))), simhash.as_mask([63])])
    assert abs(shares[0][0] - 0.5) < 0.05 and shares[0][1:8].sum() == 0 and shares[1][0] < 0.02 and shares[2][0] == 1


def test_components(spark):
    links = [(i, i + 1) for i in range(1, 40)] + [(100, 103), (103, 101), (7, 7)] + [(200, 200 + i) for i in range(1, 30)]
    got = {r.node: r.root for r in connected_components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert all(got[i] == 1 for i in range(1, 41)) and got[103] == got[101] == 100 and all(got[200 + i] == 200 for i in range(30))


# --- 10 HTML


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style><script>var t="</p>";</script></head><body><nav><ul><li>a</li><li>b</li></ul></nav>
<div class="cookie-notice">we use cookies</div><header>Site</header><{tag}><h1>Head {n}</h1><p><b>One&nbsp;&amp; {n}<br><p>Two
 words</p><aside>side</aside><form>go</form><section class="comments"><p>reader</p></section></{tag}><div class="ad">buy</div><footer>&copy; x</footer></body></html>"""


def test_html_extraction(spark):
    pages = [(i, f"https://h.example.com/{i}", PAGE.format(tag="article", n=i)) for i in range(5)] + [(5, None, None), (6, "x", ""), (7, "https://h2/1", PAGE.format(tag="div", n=7)), (8, "https://h3/1", "plain <b>text</b> &lt;3 &copy")]
    frame = spark.createDataFrame(pages, "page_id long, url string, html string").withColumn("host", F.lit("clash"))
    got = {r.page_id: r.text for r in html.extract(frame).collect()}
    assert all(got[i] == f"Head {i}\nOne & {i}\nTwo words" for i in range(5)) and got[5] == got[6] == ""
    assert got[7] == "Head 7\nOne & 7\nTwo words" and got[8] == "plain text <3 ©"
    assert html.extract(frame.limit(0)).count() == 0


def pages_of(spark, host, texts):
    return spark.createDataFrame([(i, f"http://{host}/{i}", x) for i, x in enumerate(texts)], "page_id long, url string, html string")


def extracted(spark, texts):
    return [r.text for r in html.extract(pages_of(spark, "a.example", texts)).orderBy("page_id").collect()]


@pytest.mark.parametrize(
    "page, text",
    [
        ("<article><h1>T</h1><p class='ad'>buy<p>Real text one<p>Real two</article>", "T\nReal text one\nReal two"),
        ("<article><ul><li class='promo'>x<li>kept</ul><p>after</p></article>", "kept\nafter"),
        ("<main><p>intro</p><article><p>body</p></article></main><p>out</p>", "intro\nbody"),
        ("<article><table><tr><td>a<td>b<tr class='x'><td>c</table><dl><dt>t<dd>d</dl></article>", "a b\nc\nt\nd"),
        ("<div><article><p>one</div><p style='overflow:hidden'>two</article><p>no</p></div>", "one\ntwo"),
        ("<article class='post has-sidebar'><h2 id='the-menu'>Menu</h2><p class='menu-of-the-day'>Soup</p><p hidden>h</p></article>", "Menu\nSoup"),
        ("<article><p>x<math><mi>y</mi></math> <b>z<p>&nbsp; a&#x41;&amp;lt;\n b<br>c</article>", "xy z\naA&lt; b c"),
        ("<article>one<aside>no</aside>two <span class='ad'>no</span> three<!-- c -->four</article>", "one\ntwo threefour"),
        ("<body><p>text <p>more" + "<div>" * 3000 + "deep", "text\nmore\ndeep"),
        ("<section class='comments'><article>reader</article></section><div>kept</div>", "kept"),
    ],
)
def test_html_pages(page, text):
    assert html.main_text(page) == text


def test_wrapper_expression(spark):
    a = "<div><b>Title</b><ul><li>x</li><li>y</li></ul><p>same</p></div>"
    b = "<div><b>Other</b><table><td>new</table><ul><li>z</li></ul><p>same</p></div>"
    c = "<div><b>Third</b><ul><li>z</li></ul><p>same</p><h2>h</h2><p>same</p><h2>i</h2></div>"
    items = html.wrappers(pages_of(spark, "a", [a, b, c]).withColumn("host", F.lit("a"))).collect()
    assert html.expression(items) == "<div>#(<table><td>=</></>)?<ul>(<li>#</>)+</>((<p>=</>)?(<h2>#</>)?)+</>"


def test_wrapper_decides(spark):
    """The same page gives another text when its host's other pages show what never changes."""
    page = "<body><div>House style</div><div class='x'><a>a</a> <a>b</a> <a>c</a></div><div class='text'><h1>Head {n}</h1><p>Words {n} of a text</p><div class='related'><p>About {n}</p></div><div class='related'><a>More {n}</a></div></div><p>Printed by us</p></body>"
    own = "Head {n}\nWords {n} of a text\nAbout {n}\nMore {n}"
    alone = extracted(spark, [page.format(n=0)])
    assert alone == ["House style\n" + own.format(n=0) + "\nPrinted by us"]
    assert extracted(spark, [page.format(n=i) for i in range(4)]) == [own.format(n=i) for i in range(4)]
    assert extracted(spark, [page.format(n=1)] * 4) == ["House style\n" + own.format(n=1) + "\nPrinted by us"] * 4
    card = "<article class='card'><p>Join us</p></article>"
    story = "<article><h1>Story {n}</h1><p>Same line</p><div class='search'><p>How to {n}</p></div></article>"
    pages = [card + story.format(n=i) for i in range(3)] + [card]
    assert extracted(spark, pages) == [f"Story {i}\nSame line\nHow to {i}" for i in range(3)] + ["Join us"]


def test_html_whole_table_equals_markup(spark):
    """The table's pages put the text into one article: what a plain reading of the tags gives."""
    import html as library

    frame = table(spark, DATA, "pages")
    got = {r.page_id: r.text for r in html.extract(frame).collect()}
    for r in frame.collect():
        inner = re.search(r"<article>(.*?)(?:</article>|$)", r.html or "", re.S)
        parts = re.split(r"</?(?:p|h1|ul|li|div)\b[^>]*>", inner[1]) if inner else []
        parts = [" ".join(library.unescape(re.sub(r"<[^>]*>", "", re.sub("<br>", " ", x))).split()) for x in parts]
        assert got[r.page_id] == "\n".join(x for x in parts if x)


# --- groups


def test_near_duplicate_groups(spark):
    base = prose(60, 120).split()
    texts = [(5, " ".join(base)), (3, " ".join([*base[:60], "new", *base[61:]])), (9, " ".join(base[:118])), (11, prose(61, 120)), (12, prose(61, 120).upper()), (20, " ".join(base[:40]) + " " + prose(62, 80)), *[(30 + i, x) for i, (_, x) in enumerate(ODD)]]
    frame = docs(spark, texts)
    kept = sorted(r.doc_id for r in groups.keep_one(frame).collect())
    assert kept == sorted([3, 11, 20, *[30 + i for i in range(len(ODD)) if i != 7]])
    again = docs(spark, [(1, "a b c d e f"), (1, "a b c d e f"), (None, "g h i j k l m")])
    assert groups.keep_one(again).count() == 2 and groups.keep_one(again.limit(0)).count() == 0


def edited(words, seed, n):
    pick = random.Random(seed)
    out, at = list(words), pick.sample(range(5, len(words) - 5, 6), n)
    for i in at:
        out[i] = f"edit{seed}x{i}"
    return " ".join(out)


def test_star_of_independently_edited_copies(spark):
    base = prose(400, 204).split()
    star = [(1000 - i, edited(base, i, 4)) for i in range(80)]
    a, b, c = (frozenset(tuple(w[j : j + 5]) for j in range(200)) for w in (base, star[0][1].split(), star[1][1].split()))
    assert len(a & b) >= groups.SIMILARITY * len(a | b) and len(b & c) < groups.SIMILARITY * len(b | c)
    short = prose(401, 9).split()
    texts = [*star, (500, " ".join(base)), *[(2000 + i, " ".join([*short, f"end{i}"])) for i in range(3)], (2010, " ".join(short))]
    assert sorted(r.doc_id for r in groups.keep_one(docs(spark, texts)).collect()) == [500, 2000]


def test_long_lists_of_unlike_texts_equal_brute_force(spark):
    common, other = prose(410, 12), [prose(411 + i, 60) for i in range(150)]
    texts = [(i, f"{common} {x}") for i, x in enumerate(other)]
    texts += [(200 + i, edited(texts[i][1].split(), 900 + i, 1)) for i in range(0, 150, 10)]
    assert sorted(r.doc_id for r in groups.keep_one(docs(spark, texts)).collect()) == list(range(150))
    key = spark.range(1).select(F.lit(1).cast("long").alias("key"))
    members = spark.createDataFrame([(i, [i * 100 + j for j in range(9)] + [-1]) for i in range(100)] + [(100, [j for j in range(9)] + [-2])], "node long, has array<long>")
    links = groups.verified_links(members.crossJoin(key).select("key", "node", F.lit(10).alias("n"), F.lit(101).alias("c")), members, groups.SIMILARITY).collect()
    assert {x for r in links for x in (r.a, r.b)} == {0, 100}


def test_compared_pairs_of_edited_copies_grow_with_the_texts(spark, monkeypatch):
    base, compared, write = prose(420, 150).split(), [], groups.staged
    texts = []
    for i in range(320):
        pick, out = random.Random(i), list(base)
        for at in pick.sample(range(5, 145), 1 + i % 8):
            out[at] = f"other{pick.randrange(20)}"
        texts.append((i, " ".join(out)))

    def counted(df, name):
        out = write(df, name)
        compared.extend([out.count()] if name == "pairs" else [])
        return out

    monkeypatch.setattr(groups, "staged", counted)
    kept = sorted(r.doc_id for r in groups.keep_one(docs(spark, texts)).collect())
    sets, root = {i: {tuple(w[j : j + 5]) for j in range(146)} for i, x in texts for w in [x.split()]}, list(range(len(texts)))
    for b in sets:
        for a in range(b):
            shared = len(sets[a] & sets[b])
            if root[a] != root[b] and shared >= groups.SIMILARITY * (len(sets[a]) + len(sets[b]) - shared) - 1e-9:
                root = [min(root[a], root[b]) if x in (root[a], root[b]) else x for x in root]
    assert kept == [i for i in sets if root[i] == i] and sum(compared) <= 10 * len(texts)
