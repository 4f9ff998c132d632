"""Many word lists counted in one pass over a text, by an Aho-Corasick automaton."""

from __future__ import annotations

from collections.abc import Callable

import ahocorasick
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def counter(families: list[tuple[str, ...]], whole: list[tuple[str, ...]] | None = None) -> Callable[[str], list[int]]:
    """A function from a text to how often the words of each family stand in it, inside longer words too.

    Occurrences of one word do not overlap each other (from the left, as replace() finds them); those of
    different words may. A word that is in several families counts in each, one that a family names twice counts
    twice there. Words of the families in whole count only where no letter, digit or underscore adjoins them. The
    numbers of families come first, then those of whole, then how many words apart by ASCII white space there are.
    """
    whole = whole or []
    places: dict[str, tuple[list[int], list[int]]] = {}
    for i, words in enumerate([*families, *whole]):
        for word in words:
            if word:
                places.setdefault(word, ([], []))[i >= len(families)].append(i)
    automaton = ahocorasick.Automaton()
    for word, (inside, bounded) in places.items():
        automaton.add_word(word, (word, len(word), inside, bounded))
    if len(automaton):
        automaton.make_automaton()

    def count(text: str) -> list[int]:
        out, free = [0] * (len(families) + len(whole)), {}
        for end, (word, length, inside, bounded) in automaton.iter(text) if len(automaton) else ():
            start = end - length + 1
            if start >= free.get(word, 0):
                free[word] = end + 1
                for i in inside:
                    out[i] += 1
            if bounded and not (start and joins(text[start - 1]) or end + 1 < len(text) and joins(text[end + 1])):
                for i in bounded:
                    out[i] += 1
        return [*out, len(text.encode(errors="replace").split())]

    return count


def joins(c: str) -> bool:
    """Whether a character belongs to the word beside it."""
    return c.isalnum() or c == "_"


def family_counts(text: Column, families: list[tuple[str, ...]], whole: list[tuple[str, ...]] | None = None) -> Column:
    """counter() as a column: array<bigint>, its numbers; nothing occurs in a null text.

    The automaton is built once for each task; it has a node for each character of the word lists, which are
    fixed values of a few hundred words.
    """
    held: list[Callable[[str], list[int]]] = []

    def run(texts: pd.Series) -> pd.Series:
        if not held:
            held.append(counter(families, whole))
        return texts.map(lambda t: held[0](t or ""))

    return F.pandas_udf(run, "array<bigint>")(text)
