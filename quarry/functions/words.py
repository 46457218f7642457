"""Texts as arrays of words: small Column helpers that rules on names and headlines are made of."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

EDGES = ".,;:!?'\"“”‘’()[]"


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is worked out once a row, however often ``use`` names it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def words_of(c: Column) -> Column:
    return F.filter(F.split(F.trim(c), r"\s+"), lambda w: w != "")


def bare(w: Column) -> Column:
    """A word in lower case without punctuation around it."""
    return F.lower(F.btrim(w, F.lit(EDGES)))


def bares(words: Column) -> Column:
    return F.transform(words, bare)


def at(words: Column, place: int | Column) -> Column:
    """The word at a place from 1; negative places count from the end; null outside."""
    place = F.lit(place) if isinstance(place, int) else place
    return F.get(words, F.when(place < 0, F.size(words) + place).otherwise(place - 1))


def first(words: Column, test: Callable[[Column, Column], Column]) -> Column:
    """Place, from 1, of the first word for which ``test(word, place)`` holds; null if there is none."""
    return F.nullif(F.array_position(F.transform(words, lambda w, i: test(w, i + 1)), F.lit(True)).cast("int"), F.lit(0))


def any_of(words: Column, listed: tuple[str, ...]) -> Column:
    return F.exists(words, lambda w: w.isin(*listed))


def phrase(words: Column, *steps: tuple[str, ...]) -> Column:
    """Place of the first run of words that are, one after another, among ``steps``; null if there is none."""

    def here(w: Column, place: Column) -> Column:
        hit = w.isin(*steps[0])
        for n, step in enumerate(steps[1:]):
            hit &= F.coalesce(F.get(words, place + n).isin(*step), F.lit(False))
        return hit

    return first(words, here)


def upto(words: Column, n: Column | int) -> Column:
    return F.slice(words, 1, n)


def after(words: Column, n: Column | int) -> Column:
    return F.slice(words, n + 1 if isinstance(n, Column) else F.lit(n + 1), F.size(words))


def said(words: Column) -> Column:
    return F.array_join(words, " ")


def contains_one(low: Column, listed: tuple[str, ...]) -> Column:
    """Whether a text holds one of ``listed``; the list is one constant, so the plan stays small."""
    return F.exists(F.array(*map(F.lit, listed)), lambda w: F.contains(low, w))
