"""Operator 7: quality and toxicity scores by co-training of a text view and a metadata view.

The text view sees word presence and character statistics of the whole text; the metadata view sees source, language
and length as the page reports them. Both start from labelled documents. In each round a view labels all unlabelled
documents, and those that it is sure of train the *other* view, all together with no more weight than the labelled
ones of the class have. The views are then calibrated and combined on labelled documents held out from training (other
ones than those that calibrate the exchange); the combination scores every document.

Labelled documents are the one bounded sample: ``train``'s ``sample``, picked by a hash of the id. Unlabelled ones are
read whole in each step as packed features, and only sums over them (a few thousand numbers) reach the driver.

With few labels or one class only, the class share is the score of every document; without labels every document is
taken for good. Null and empty texts have no words, null metadata is a value of its own, null ids are unlabelled. Of
several labels of a document the worst counts; rows that share a labelled id are all labelled by it. Repeated rows get
equal scores. Very long texts are read whole, one at a time. Columns named as the scores are replaced, others stay.
Empty tables give empty results.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm.common import staged, table

#: Labelled documents that are used at most.
SAMPLE = 20_000
#: Words per target that the text view knows, and the least number of sampled documents with such a word.
WORDS, LEAST = 256, 3
#: Rounds of exchange and steps of the fit in each; how sure a view must be of what it teaches.
ROUNDS, STEPS, SURE = 3, 3, 0.98
#: Words that a worker counts before it hands them on.
COUNTED = 20_000
SOURCES, LANGS = 32, 16
TARGETS = ("quality", "toxic")
_WORD = re.compile(r"[^\W\d_]+")
_MARKS = set("#$%&*|!<>{}=@^~\\")
N_STATS, N_META, BLOCK = 9, SOURCES + LANGS + 3, 2048
STEM = 5


def terms(found: list[str]) -> set[str]:
    """Distinct words, and their first ``STEM`` letters marked by ``^``."""
    distinct = set(found)
    return distinct | {"^" + w[:STEM] for w in distinct if len(w) > STEM}


def statistics(text: str, found: list[str], distinct: int) -> list[float]:
    """Character and repetition statistics of a text."""
    n, words, raw = max(1, len(text)), max(1, len(found)), text.split()
    marks = sum(map(text.count, _MARKS))
    upper = sum(1 for w in raw if len(w) > 1 and w.isupper())
    digits = sum(map(text.count, "0123456789"))
    letters = sum(map(len, found))
    repeats = sum(map(str.__eq__, raw[1:], raw))
    return [
        min(1.0, 20 * marks / n), upper / max(1, len(raw)), min(1.0, 10 * digits / n), distinct / words,
        distinct / words**0.85, letters / n, min(20, letters / words) / 10, repeats / max(1, len(raw)), np.log1p(len(raw)) / 10]


def text_features(text: str | None, words: dict[str, int]) -> tuple[list[float], list[int]]:
    found = _WORD.findall((text or "").lower())
    distinct = set(found)
    return statistics(text or "", found, len(distinct)), sorted(words[w] for w in terms(found) & words.keys())


def metadata_features(source: str | None, lang: str | None, chars: int | None) -> list[float]:
    out = [0.0] * (SOURCES + LANGS)
    out[xxhash.xxh64_intdigest(source or "") % SOURCES] = 1.0
    out[SOURCES + xxhash.xxh64_intdigest(lang or "") % LANGS] = 1.0
    length = np.log1p(max(0, chars or 0)) / 10
    return [*out, float(chars is None), length, length * length]


def derivatives(x: np.ndarray, y: np.ndarray, w: np.ndarray, ridge: float) -> tuple[np.ndarray, np.ndarray]:
    """Slope and curve of a ridge-penalised logistic regression at ``w``; rows are read in blocks."""
    penalty = np.full(len(w), ridge)
    penalty[-1] = 1e-6
    slope, curve = -penalty * w, np.diag(penalty)
    for at in range(0, len(x), BLOCK):
        part = np.asarray(x[at : at + BLOCK], float)
        part = np.hstack([part, np.ones((len(part), 1))])
        p = chance(part @ w)
        slope += part.T @ (y[at : at + BLOCK] - p)
        curve += (part * (p * (1 - p) + 1e-9)[:, None]).T @ part
    return slope, curve


def fit(x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    """Weights and bias of a ridge-penalised logistic regression, by Newton's method."""
    w = np.zeros(x.shape[1] + 1)
    for _ in range(25):
        slope, curve = derivatives(x, y, w, ridge)
        step = np.linalg.solve(curve, slope)
        w += step
        if np.abs(step).max() < 1e-6:
            break
    return w


def logits(x: np.ndarray, w: np.ndarray) -> np.ndarray:
    return np.asarray(x, float) @ w[:-1] + w[-1]


def chance(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


@dataclass
class Model:
    """One target's text weights, metadata weights and their combination; ``share`` alone where nothing was fitted."""

    share: float = 0.5
    text: np.ndarray | None = None
    meta: np.ndarray | None = None
    both: np.ndarray | None = None

    def score(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        if self.text is None:
            return np.full(len(a), self.share)
        return chance(logits(np.column_stack([logits(a, self.text), logits(b, self.meta)]), self.both))


@dataclass
class Classifier:
    words: dict[str, int] = field(default_factory=dict)
    models: dict[str, Model] = field(default_factory=dict)

    def features(self, texts, sources, langs, chars) -> tuple[np.ndarray, np.ndarray]:
        a = np.zeros((len(texts), N_STATS + len(self.words)))
        for i, text in enumerate(texts):
            stats, present = text_features(text, self.words)
            a[i, :N_STATS] = stats
            a[i, [N_STATS + j for j in present]] = 1.0
        return a, np.array([metadata_features(*m) for m in zip(sources, langs, chars)]).reshape(len(texts), N_META)


class TextRows:
    """Rows of the text view: statistics and a bit a word; bits are opened for the rows that are made an array."""

    def __init__(self, stats: np.ndarray, bits: np.ndarray, words: int):
        self.stats, self.bits, self.words = stats, bits, words
        self.shape = len(stats), stats.shape[1] + words

    @classmethod
    def packed(cls, stats: np.ndarray, present: pa.ListArray, words: int) -> TextRows:
        bits = [np.zeros((0, -(-words // 8)), np.uint8)]
        for at in range(0, len(present), BLOCK):
            part = present.slice(at, BLOCK)
            marks = np.zeros((len(part), words), bool)
            marks[np.repeat(np.arange(len(part)), np.diff(np.asarray(part.offsets))), np.asarray(part.flatten())] = True
            bits.append(np.packbits(marks, axis=1))
        return cls(stats, np.concatenate(bits), words)

    def __len__(self) -> int:
        return len(self.stats)

    def __getitem__(self, rows) -> TextRows:
        return TextRows(self.stats[rows], self.bits[rows], self.words)

    def __array__(self, dtype=None, copy=None) -> np.ndarray:
        return np.hstack([self.stats, np.unpackbits(self.bits, axis=1, count=self.words)], dtype=dtype)


class CoTraining:
    """One target's views while they learn: labelled rows, weights, and what the views teach each other."""

    def __init__(self, a: TextRows, b: np.ndarray, y: np.ndarray):
        fold = np.arange(len(y)) % 10
        self.y, self.views, self.own = y.astype(float), (a, b), (fold != 4) & (fold != 9)
        self.exchange, self.last = fold == 4, fold == 9
        self.weights = [fit(v[self.own], self.y[self.own]) for v in self.views]
        self.counts = np.array([self.y[self.own].sum(), (1 - self.y[self.own]).sum()])

    @staticmethod
    def possible(y: np.ndarray) -> bool:
        parts = [y[np.arange(len(y)) % 10 == i] for i in (4, 9)] + [y]
        return len(y) >= 40 and all(0 < p.sum() < len(p) for p in parts)

    def teaching(self) -> list[tuple[np.ndarray, np.ndarray]]:
        """Each view's weights and calibration; a weak view is sure of nothing and teaches nothing."""
        held = self.exchange
        return [(w, fit(logits(v[held], w)[:, None], self.y[held], 0.1)) for v, w in zip(self.views, self.weights)]

    def learn(self, view: int, n: np.ndarray, slopes: np.ndarray) -> None:
        """A step of ``view`` given the numbers and gradient sums of the other view's sure rows, by class."""
        w, x, y = self.weights[view], self.views[view][self.own], self.y[self.own]
        weight = np.minimum(1, self.counts / np.maximum(n, 1))
        slope, curve = derivatives(x, y, w, 1.0)
        # what is taught is bent less than what is labelled, so the curve is not underrated
        self.weights[view] = w + np.linalg.solve(curve * (1 + (weight * n).sum() / len(y)), slope + weight @ slopes)

    def finished(self) -> Model:
        z = np.column_stack([logits(v[self.last], w) for v, w in zip(self.views, self.weights)])
        return Model(float(self.y.mean()), *self.weights, fit(z, self.y[self.last], 0.1))


def taught(pool: DataFrame, learners: list[CoTraining], teaching: list, n_words: int) -> list[list[tuple[np.ndarray, np.ndarray]]]:
    """For every learner and view: sure rows of the other view by class, in number and as gradient sums; all rows."""
    weights = [x.weights for x in learners]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = None
        for batch in batches:
            dense = np.asarray(batch.column(0).flatten(), dtype=float).reshape(batch.num_rows, -1)
            lengths = np.diff(np.asarray(batch.column(1).offsets))
            words, row = np.asarray(batch.column(1).flatten()), np.repeat(np.arange(batch.num_rows), lengths)

            def logit(view: int, w: np.ndarray) -> np.ndarray:
                if view:
                    return dense[:, N_STATS:] @ w[:-1] + w[-1]
                return dense[:, :N_STATS] @ w[:N_STATS] + np.bincount(row, w[N_STATS + words], batch.num_rows) + w[-1]

            def weighed(view: int, r: np.ndarray) -> np.ndarray:
                if view:
                    return np.r_[r @ dense[:, N_STATS:], r.sum()]
                return np.r_[r @ dense[:, :N_STATS], np.bincount(words, r[row], n_words), r.sum()]

            part = []
            for own, teachers in zip(weights, teaching):
                for view in (0, 1):
                    w, calibration = teachers[1 - view]
                    sure = chance(logit(1 - view, w) * calibration[0] + calibration[1])
                    said = chance(logit(view, own[view]))
                    for hit, y in ((sure >= SURE, 1.0), (sure <= 1 - SURE, 0.0)):
                        part += [[hit.sum()], weighed(view, np.where(hit, y - said, 0.0))]
            part = np.concatenate(part)
            sums = part if sums is None else sums + part
        if sums is not None:
            yield pa.RecordBatch.from_arrays([pa.array([sums.tolist()], pa.list_(pa.float64()))], ["sums"])

    flat = pool.mapInArrow(run, "sums array<double>").select(F.posexplode("sums").alias("i", "x")).groupBy("i").agg(F.sum("x").alias("x"))
    found = {r.i: r.x for r in flat.collect()}
    out, at = [], 0
    for own in weights:
        views = []
        for w in own:
            block = np.array([found.get(i, 0.0) for i in range(at, at + 2 * (len(w) + 1))]).reshape(2, -1)
            views.append((block[:, 0], block[:, 1:]))
            at += block.size
        out.append(views)
    return out


def word_counts(batches: Iterator[pa.RecordBatch], most: int = COUNTED) -> Iterator[pa.RecordBatch]:
    """``word``, ``n``, ``quality``, ``toxic``: documents with each term, in parts; a part is given out beyond ``most`` terms."""
    counts: dict[str, list[int]] = {}

    def part() -> pa.RecordBatch:
        columns = zip(*counts.values()) if counts else [[]] * 3
        return pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), *[pa.array(c, pa.int64()) for c in columns]], ["word", "n", *TARGETS])

    for batch in batches:
        for row in range(batch.num_rows):
            text, *flags = (c[row].as_py() for c in batch.columns)
            for word in terms(_WORD.findall((text or "").lower())):
                entry = counts.setdefault(word, [0, 0, 0])
                entry[0] += 1
                entry[1] += flags[0]
                entry[2] += flags[1]
            if len(counts) > most:
                yield part()
                counts.clear()
    yield part()


def train(documents: DataFrame, labels: DataFrame, sample: int = SAMPLE, rounds: int = ROUNDS) -> Classifier:
    """Fit from ``labels`` (doc_id, quality, toxic), the ``documents`` they name, and all other ``documents``."""
    labels = labels.where("doc_id is not null").groupBy("doc_id").agg(F.min("quality").alias("quality"), F.max("toxic").alias("toxic"))
    labels = staged(labels.where("quality is not null and toxic is not null"), "labels")
    picked = labels.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    docs = documents.select("doc_id", "text", "source", "lang", "n_chars")
    known = staged(docs.join(F.broadcast(picked), "doc_id").orderBy(F.xxhash64("doc_id", "text"), "doc_id").limit(sample), "labelled")  # ``sample`` ids at most

    words = known.select("text", *TARGETS).mapInArrow(word_counts, "word string, n long, quality long, toxic long")
    words = words.groupBy("word").agg(*[F.sum(c).alias(c) for c in ("n", *TARGETS)]).where(F.col("n") >= LEAST)
    words = staged(words, "words")
    total = known.agg(F.count("*").alias("n"), *[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in TARGETS]).first()
    vocabulary: set[str] = set()
    for target in TARGETS if total.n else ():
        share = total[target] / total.n
        # distance of the class share among documents with the word from the overall share, in standard errors
        z = (F.col(target) - F.col("n") * share) / F.sqrt(F.col("n") * F.lit(max(share * (1 - share), 1e-9)))
        vocabulary |= {r.word for r in words.orderBy(F.desc(F.abs(z)), "word").limit(WORDS).collect()}
    out = Classifier({w: i for i, w in enumerate(sorted(vocabulary))})

    def given(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                text, source, lang, chars = (part.column(i) for i in range(4))
                both = [text_features(t.as_py(), out.words) for t in text]
                dense = [[*x[0], *metadata_features(*m)] for x, m in zip(both, zip(source.to_pylist(), lang.to_pylist(), chars.to_pylist()))]
                packed = [pa.array(dense, pa.list_(pa.float32())), pa.array([x[1] for x in both], pa.list_(pa.int32()))]
                yield pa.RecordBatch.from_arrays([*packed, *part.columns[4:]], ["dense", "present", *part.schema.names[4:]])

    def features(df: DataFrame, kept: str, *columns: str) -> DataFrame:
        return df.select("text", "source", "lang", "n_chars", *columns).mapInArrow(given, f"dense array<float>, present array<int>, {kept}")

    flags = [F.col(t).cast("int").alias(t) for t in TARGETS]
    rows = features(known.withColumns(dict(zip(TARGETS, flags))), "quality int, toxic int", *TARGETS)
    rows = rows.orderBy(F.xxhash64("dense"), "dense", "present", *TARGETS).toArrow()  # a few hundred bytes a row
    dense = np.asarray(rows["dense"].combine_chunks().flatten()).reshape(rows.num_rows, N_STATS + N_META)
    a = TextRows.packed(dense[:, :N_STATS], rows["present"].combine_chunks(), len(out.words))
    learners: dict[str, CoTraining] = {}
    for target in TARGETS:
        y = rows[target].to_numpy().astype(int)
        out.models[target] = Model(float(y.mean()) if len(y) else float(target == "quality"))
        if CoTraining.possible(y):
            learners[target] = CoTraining(a, dense[:, N_STATS:], y)
    if learners:
        pool = staged(features(docs, f"doc_id {documents.schema['doc_id'].dataType.simpleString()}", "doc_id"), "features")
        pool = staged(pool.join(labels.select("doc_id").hint("merge"), "doc_id", "left_anti").select("dense", "present"), "pool")
        for _ in range(rounds):
            teaching = [x.teaching() for x in learners.values()]
            for _ in range(STEPS):
                for learner, views in zip(learners.values(), taught(pool, list(learners.values()), teaching, len(out.words))):
                    for view, (n, slopes) in enumerate(views):
                        learner.learn(view, n, slopes)
        out.models |= {t: x.finished() for t, x in learners.items()}
    return out


def score(df: DataFrame, classifier: Classifier) -> DataFrame:
    """``df`` with ``quality_score`` and ``toxic_score`` between 0 and 1; columns of these names are replaced."""
    df = df.drop("quality_score", "toxic_score")
    names = df.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                a, b = classifier.features(*(part.column(c).to_pylist() for c in ("text", "source", "lang", "n_chars")))
                found = [pa.array(classifier.models[t].score(a, b)) for t in TARGETS]
                yield pa.RecordBatch.from_arrays([*part.columns, *found], [*names, "quality_score", "toxic_score"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)
    return df.mapInArrow(run, f"{fields}, quality_score double, toxic_score double")


def accepted(quality: float = 0.5, toxic: float = 0.5):
    return (F.col("quality_score") >= quality) & (F.col("toxic_score") < toxic)


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source", "n_chars")
    scored = score(documents, train(documents, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", "quality_score", "toxic_score", accepted().alias("keep"))
