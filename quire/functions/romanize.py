"""Latin readings of Han text by whole runs: a reading may depend on the characters beside it."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterable, Mapping

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

#: What a rule of the transliteration looks like: text in braces is read when what follows it stands there (a blank
#: between them is optional), a class or a character anywhere.
_BESIDE = re.compile(r"^\{(.+)\}(?:' '\?)?(.+) > (.+);$")
_ALONE = re.compile(r"^(\[.+\]|.) > (.+);$", re.S)


def plain(reading: str) -> str:
    """A reading without tone marks, in lower case."""
    return "".join(c for c in unicodedata.normalize("NFD", reading.lower()) if not unicodedata.combining(c)).strip()


def readings(spark: SparkSession) -> dict[str, str]:
    """Readings from the rules of the Unicode library that Spark ships, filled once a call.

    A key of one character is read so anywhere; a longer key, beginning at its first character, gives the readings of
    as many characters as its value has words. What the rules read first counts.
    """
    rules = spark._jvm.com.ibm.icu.text.Transliterator.getInstance("Han-Latin").toRules(False)
    out: dict[str, str] = {}
    for line in rules.split("\n"):
        if m := _BESIDE.match(line):
            out.setdefault(m[1] + m[2], plain(m[3]))
        elif m := _ALONE.match(line):
            for c in _members(m[1]):
                out.setdefault(c, plain(m[2]))
    return out


def _members(named: str) -> Iterable[str]:
    """Characters of a class like ``[ab-d]``, or the one character."""
    inside = named[1:-1] if len(named) > 1 else named
    i = 0
    while i < len(inside):
        if inside[i + 1 : i + 2] == "-" and i + 2 < len(inside):
            yield from map(chr, range(ord(inside[i]), ord(inside[i + 2]) + 1))
            i += 3
        else:
            yield inside[i]
            i += 1


class Reader:
    """Reads runs by a longest match of ``known`` (see :func:`readings`) at each place."""

    def __init__(self, known: Mapping[str, str]):
        self.known, self.longest = known, max(map(len, known), default=0)

    def __call__(self, run: str) -> list[str] | None:
        """One syllable a character; null if the run is empty or a character of it has no reading."""
        out: list[str] = []
        while len(out) < len(run):
            at = len(out)
            said = next((self.known[k] for n in range(min(self.longest, len(run) - at), 0, -1) if (k := run[at : at + n]) in self.known), None)
            if not said:
                return None
            out += said.split(" ")
        return out if out and len(out) == len(run) else None

    def column(self, runs: pa.Array) -> pa.Array:
        """The readings of a batch's runs, each different run read once; null for empty and null ones."""
        held = runs.dictionary_encode()
        return pa.array([self(x) if x else None for x in held.dictionary.to_pylist()], pa.list_(pa.string())).take(held.indices)


def romanized(c: Column, known: Mapping[str, str]) -> Column:
    """A text's syllables as an array, over Arrow batches; null where :class:`Reader` gives none."""
    read = Reader(known)

    @F.arrow_udf("array<string>")
    def run(s: pa.Array) -> pa.Array:
        return read.column(s)

    return run(c)


def not_spelled(names: Column, known: Mapping[str, str]) -> Column:
    """An array of (source, rendering, basis) without those whose rendering only spells the source out."""
    read = Reader(known)

    def kept(n: dict) -> bool:
        said = read(n["source"])
        return not said or "".join(said) != "".join(x for x in n["rendering"].lower() if x.isalpha())

    @F.pandas_udf("array<struct<source:string,rendering:string,basis:string>>")
    def run(s: pd.Series) -> pd.Series:
        return pd.Series([None if x is None else [dict(n) for n in x if kept(n)] for x in s], dtype=object)

    return run(names)
