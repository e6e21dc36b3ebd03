"""Symbolic shape words (SAX): letters, and the patterns that search them."""

from __future__ import annotations

import re
from statistics import NormalDist

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

ALPHABET = "abcde"
FLAT = 1e-9

# The pieces that the kinds and shapes are searched by.
KINDS = {"rise": "[ab]+.*[de]+", "fall": "[de]+.*[ab]+", "stable": r"(.)\1{3,}"}
SHAPES = {
    "plateau": r"(.)\1{5,}",
    "depression": "[ab]{5,}",
    "spike": "[a-c]+[de][a-c]+",
    "valley": "[c-e]+[ab][c-e]+",
    "step_up": "[ab]{3,}.*[de]{3,}",
    "step_down": "[de]{3,}.*[ab]{3,}",
}


def breakpoints(size: int = len(ALPHABET)) -> list[float]:
    """The quantiles that cut a normal distribution into ``size`` equally likely parts."""
    return [NormalDist().inv_cdf(i / size) for i in range(1, size)]


def letter(value: Column, mean: Column, std: Column, alphabet: str = ALPHABET) -> Column:
    """The letter of a bin mean within its window; the middle one if the window is flat."""
    z = (value - mean) / F.when(std >= FLAT, std)
    above = sum((F.when(z > b, 1).otherwise(0) for b in breakpoints(len(alphabet))), F.lit(0))
    return F.when((std < FLAT) | std.isNull(), alphabet[len(alphabet) // 2]).otherwise(F.substring(F.lit(alphabet), above + 1, F.lit(1)))


def kind_pattern(kinds: Column) -> Column:
    """The pattern of an array of kinds, in order."""
    piece = lambda k: F.coalesce(*(F.when(k == name, F.lit(p)) for name, p in KINDS.items()), F.lit(""))
    return F.array_join(F.transform(kinds, piece), ".*")


def shape_pattern(shape: Column) -> Column:
    return F.coalesce(*(F.when(shape == name, F.lit(p)) for name, p in SHAPES.items()))


def matches(sax: Column, pattern: Column | str) -> Column:
    """Whether the word holds the pattern anywhere; a null word or pattern doesn't.

    A pattern given as a string may be invalid: then no word holds it. Of a column's, ``checked`` makes the
    invalid ones null first.
    """
    if isinstance(pattern, str):
        try:
            re.compile(pattern)
        except re.error:
            return F.lit(False)
        pattern = F.lit(pattern)
    return F.coalesce(F.regexp(sax, pattern), F.lit(False))




def checked(pattern: Column) -> Column:
    """``pattern`` where it is a valid expression, else null; looked at once for each distinct one of a batch."""

    @F.pandas_udf("string")
    def valid(patterns: pd.Series) -> pd.Series:
        def sound(p: str) -> bool:
            try:
                re.compile(p)
            except re.error:
                return False
            return True

        known = {p: p if sound(p) else None for p in patterns.dropna().unique()}
        return pd.Series([known.get(p) for p in patterns], dtype=object)

    return valid(pattern)
