"""The corpus pipeline's stages on whole small tables."""

import collections

import corpus_pipeline as P
from quarry.llm import groups, quality
from quarry.llm.common import staged, table

DATA = "/root/testdata/sf0.01"


def kept_by_force(texts, similarity=groups.SIMILARITY):
    sets = {i: frozenset(tuple(w[j : j + 5]) for j in range(max(1, len(w) - 4))) for i, x in texts.items() for w in [x.encode().lower().split()]}
    holders, root = collections.defaultdict(list), {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in sorted(sets):
        shared = collections.Counter(o for s in sets[i] for o in holders[s])
        for o, n in shared.items():
            if n >= similarity * (len(sets[i]) + len(sets[o]) - n) - 1e-9:
                a, b = find(i), find(o)
                root[max(a, b)] = min(a, b)
        for s in sets[i]:
            holders[s].append(i)
    return {i for i in sets if find(i) == i}


def test_stages(spark):
    before = table(spark, DATA, "documents")
    for name, stage in P.STAGES:
        after = staged(stage(spark, before, DATA), name)
        ids, was = {r.doc_id for r in after.select("doc_id").collect()}, {r.doc_id for r in before.select("doc_id").collect()}
        assert ids <= was and after.count() == len(ids)
        if name != P.STAGES[-1][0]:
            assert set(after.columns) == set(P.COLUMNS)
        if name == "quality_classifier":
            labels = table(spark, DATA, "labels").toPandas()
            clean = labels[(labels.quality == 1) & (labels.toxic == 0)].doc_id
            poor = labels[(labels.quality == 0) | (labels.toxic == 1)].doc_id
            assert clean.isin(ids).mean() >= 0.98 and poor.isin(ids).mean() <= 0.05 and quality.SAMPLE >= len(labels)
        if name in ("line_dedup", "bpe"):
            assert ids == was
        if name == "simhash_near_dedup":
            assert ids == kept_by_force({r.doc_id: r.text for r in before.select("doc_id", "text").collect()})
        before = after


def test_run(spark, tmp_path):
    for name in ("documents", "labels", "benchmark"):
        table(spark, "/root/testdata/sf0.001", name).limit(0).write.parquet(str(tmp_path / f"{name}.parquet"))
    assert P.run(spark, str(tmp_path)).count() == 0
    out = P.run(spark, "/root/testdata/sf0.001")
    assert out.count() > 0 and {"doc_id", "n_tokens"} <= set(out.columns)
