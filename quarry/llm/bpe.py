"""Operator 1: BPE encoding and decoding by a tokenization automaton.

The automaton reads *tokens*. It starts as one state that loops on every base symbol. Each merge ``a + b``, taken
in rank order, is applied by one merge gadget: the state ``s`` that ``a`` leads to is copied without its arc ``b``,
all arcs ``a`` into ``s`` are redirected to the copy, and every state with an arc ``a`` gets an arc ``ab`` to where
``b`` led. What it then accepts are exactly the token sequences that BPE produces, and each word spells one path.
See Berglund, Martens and van der Merwe, "Constructing a BPE Tokenization DFA" (2024).

Copies share structure: a state keeps its parent, the arc taken away and the merge at which it was taken; an arc
added later for a longer token exists where its left part still existed at that time. An arc's target depends on
its label alone, so targets are one table.

Null and empty texts have no tokens. Repeated rows give equal rows. Very long texts are encoded whole, one at a time.
Empty tables give none. Only ``doc_id`` and ``text`` are read, so other columns' names cannot clash.
"""

from __future__ import annotations

import json
import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import regex
import tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm.common import SLICE_BYTES, table

#: A merge number that no merge has.
NEVER = 1 << 60
#: Words kept with their encoding in each Python worker; the memory is dropped and built anew beyond this.
CACHED_WORDS = 200_000

# The characters that byte-level BPE shows for bytes 0-255. Printable bytes stand for themselves.
_PRINTABLE = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
_SPACE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_WORD = regex.compile(rf"\p{{L}}+|'(?:s|t|re|ve|m|ll|d)|\p{{N}}|[^{_SPACE}\p{{L}}\p{{N}}]+")
# The same for texts within Latin-1, whose letters and numerals can be listed; ``re`` is several times faster.
_LETTERS, _NUMERALS = r"A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\xff", r"0-9\xb2\xb3\xb9\xbc-\xbe"
_LATIN_WORD = re.compile(rf"[{_LETTERS}]+|'(?:s|t|re|ve|m|ll|d)|[{_NUMERALS}]|[^\t-\r \x85\xa0{_LETTERS}{_NUMERALS}]+")
_BEYOND_LATIN = re.compile(r"[^\x00-\xff]")

#: Outside these ranges Unicode versions differ in what is a letter.
_RARE = regex.compile(r"[^\x00-\u0557\u05d0-\u06ff\u0900-\u0b00\u1e00-\u1eff\u2000-\u208e\u20a0-\u20bf\u2100-\u2bff\u3000-\u9fef\uac00-\ud7a3\uff00-\uff9f\U0001f300-\U0001f64f]")


def byte_characters() -> list[str]:
    free = iter(range(0x100, 0x200))
    return [chr(b) if b in set(_PRINTABLE) else chr(next(free)) for b in range(256)]


class Automaton:
    """Deterministic automaton over the tokens of a vocabulary; ``arc`` is its transition test, ``target`` its table."""

    def __init__(self, vocab: dict[str, int], merges: list[tuple[str, str]], suffix: str):
        self.vocab, self.suffix = vocab, suffix
        size = max(vocab.values(), default=-1) + 1
        self.label = [""] * size
        for token, i in vocab.items():
            self.label[i] = token
        self.left, self.made = [-1] * size, [-1] * size
        self.target = [0] * size
        self.parent, self.cut, self.at = [-1], [-1], [-1]
        self.dead: set[int] = set()
        self._cuts: dict[int, dict[int, int]] = {0: {}}
        self._arcs: dict[int, bool] = {}
        for rank, (a, b) in enumerate(merges):
            self._gadget(rank, vocab[a], vocab[b], vocab[a + b])
        self._arcs.clear()
        self._cuts = {0: {}}
        #: The longest token by its first three characters.
        self.reach: dict[str, int] = {}
        for token in vocab:
            bare = token.removesuffix(suffix)
            self.reach[bare[:3]] = max(self.reach.get(bare[:3], 0), len(bare))

    def _gadget(self, rank: int, a: int, b: int, ab: int) -> None:
        s = self.target[a]
        if a in self.dead or b in self.dead or not self.arc(s, b):  # an earlier merge always takes one of the parts
            self.dead.add(ab)
            return
        self.left[ab], self.made[ab], self.target[ab] = a, rank, self.target[b]
        self.parent.append(s)
        self.cut.append(b)
        self.at.append(rank)
        self.target[a] = len(self.parent) - 1

    def _cuts_of(self, state: int) -> dict[int, int]:
        """Arcs taken away on the way to this state, with the merge that took each."""
        found = self._cuts.get(state)
        if found is None:
            found, s = {}, state
            while s:
                found[self.cut[s]] = self.at[s]
                s = self.parent[s]
            if len(self._cuts) > 20_000:
                self._cuts = {0: {}}
            self._cuts[state] = found
        return found

    def arc(self, state: int, token: int) -> bool:
        """Whether ``state`` has an arc for ``token``."""
        key = state << 20 | token
        known = self._arcs.get(key)
        if known is None:
            cuts, part, born, known = self._cuts_of(state), token, NEVER, token not in self.dead
            while part >= 0:
                if cuts.get(part, NEVER) <= born and part in cuts:
                    known = False
                    break
                born, part = self.made[part], self.left[part]
            if len(self._arcs) > 1_000_000:
                self._arcs.clear()
            self._arcs[key] = known
        return known

    def encode_word(self, word: str) -> list[int]:
        """Tokens of one pre-split word in byte characters: the one path from the start state that spells it."""
        n, get, target, arc, suffix, reach = len(word), self.vocab.get, self.target, self.arc, self.suffix, self.reach.get
        whole = get(word + suffix)
        if whole is not None and whole not in self.dead:
            return [whole]
        # Longest arc first. A prefix has one path too, so a place from which no arc goes on is never tried again.
        ids, starts, dead = [], [], set()
        start, end = 0, min(n, reach(word[:3], 2))
        while start < n:
            here = target[ids[-1]] if ids else 0
            while end > start:
                if end not in dead:
                    token = get(word[start:end] + suffix if end == n else word[start:end])
                    if token is not None and arc(here, token):
                        break
                end -= 1
            else:
                if not ids:
                    raise ValueError(f"no path spells {word[:80]!r}")
                dead.add(start)
                ids.pop()
                start, end = starts.pop(), start - 1
                continue
            ids.append(token)
            starts.append(start)
            start, end = end, min(n, end + reach(word[end : end + 3], 2))
        return ids


class Tokenizer:
    """Normalizing, splitting and encoding of whole texts; decoding emits the labels of the arcs taken."""

    def __init__(self, spec: str):
        rules = json.loads(spec)
        model = rules["model"]
        self.added = {x["content"]: x["id"] for x in rules["added_tokens"]}
        self.automaton = Automaton(model["vocab"], [tuple(m) for m in model["merges"]], model["end_of_word_suffix"])
        self.label = dict(enumerate(self.automaton.label)) | {i: t for t, i in self.added.items()}
        self.split = regex.compile("(" + "|".join(map(regex.escape, self.added)) + ")") if self.added else None
        self.shown = byte_characters()
        self.byte = {c: b for b, c in enumerate(self.shown)}
        self.library = tokenizers.Tokenizer.from_str(spec)
        self.words: dict[str, tuple[int, str, str]] = {}

    def _word(self, word: str) -> tuple[int, str, str]:
        shown = word if word.isascii() and word.isprintable() else "".join(map(self.shown.__getitem__, word.encode()))
        ids = self.automaton.encode_word(shown)
        if len(self.words) >= CACHED_WORDS:
            self.words.clear()
        entry = self.words[word] = len(ids), " ".join(map(str, ids)), " ".join(map(self.label.__getitem__, ids))
        return entry

    def pieces(self, text: str) -> list[tuple[int, str, str]]:
        """(tokens, decimal ids, labels) of each word in order; ids and labels are joined by one space."""
        words, fresh, out = self.words, self._word, []
        for k, part in enumerate([text] if self.split is None else self.split.split(text)):
            if k % 2:
                out.append((1, str(self.added[part]), part))
            else:
                out += [words.get(word) or fresh(word) for word in self._split(part)]
        return out

    def _split(self, part: str) -> list[str]:
        if not part.isascii():
            if _RARE.search(part):  # letters that Unicode versions class differently: the library's own tables decide
                found = self.library.pre_tokenizer.pre_tokenize_str(self.library.normalizer.normalize_str(part))
                return [bytes(map(self.byte.__getitem__, word)).decode() for word, _ in found]
            part = unicodedata.normalize("NFC", part).replace("Σ", "σ")
            if _BEYOND_LATIN.search(part):
                return _WORD.findall(part.lower())
        return _LATIN_WORD.findall(part.lower())

    def encode(self, text: str) -> list[int]:
        return [int(i) for _, ids, _ in self.pieces(text) for i in ids.split(" ")]

    def decode(self, ids: list[int]) -> str:
        """Labels of the arcs; the vocabulary names no decoder, so labels stay apart by one space."""
        return " ".join(self.label[i] for i in ids)


@lru_cache(maxsize=2)
def _tokenizer(spec: str) -> Tokenizer:
    return Tokenizer(spec)


def encode_decode(df: DataFrame, vocabulary: str, text: str = "text", key: str = "doc_id") -> DataFrame:
    """``key``, ``n_tokens``, ``ids`` (decimal, joined by a space) and ``decoded`` for every row of ``df``.

    ``vocabulary``: path of a tokenizer file that the driver reads; executors get it as a broadcast of its (fixed) size.
    """
    spec = df.sparkSession.sparkContext.broadcast(open(vocabulary, encoding="utf-8").read())  # noqa: SIM115
    kind = pa.schema([("k", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.string()), ("decoded", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = _tokenizer(spec.value)
        rows: list[tuple] = []
        size = 0
        for batch in batches:
            keys = batch.column(0).to_pylist()
            for i, value in enumerate(batch.column(1)):
                found = tokenizer.pieces(value.as_py() or "")
                ids, decoded = " ".join([x[1] for x in found]), " ".join([x[2] for x in found])
                rows.append((keys[i], sum([x[0] for x in found]), ids, decoded))
                size += len(ids) + len(decoded)
                if size > SLICE_BYTES:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows), kind)], schema=kind)
                    rows, size = [], 0
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows), kind)], schema=kind)

    out = df.select(F.col(key).cast("long").alias("k"), F.col(text).cast("string").alias("t"))
    return out.mapInArrow(run, "k long, n_tokens long, ids string, decoded string").withColumnRenamed("k", key)


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = encode_decode(table(spark, sf_dir, "documents"), default_vocabulary())
    return coded.select(
        "doc_id",
        "n_tokens",
        F.sha2(F.encode("ids", "UTF-8"), 256).alias("ids_sha256"),
        F.sha2(F.encode("decoded", "UTF-8"), 256).alias("decoded_sha256"),
    )
