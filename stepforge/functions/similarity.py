"""Distances of vectors, similarity of two strings by their longest common subsequence of characters or by matching blocks,
and whether a state matches a target."""

from __future__ import annotations

from collections import Counter
from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DoubleType

from stepforge.functions import text as tx


def l2(left: Column, right: Column) -> Column:
    """Euclidean distance of two arrays, in doubles; null where one is missing or empty, or their lengths differ."""
    squares = F.aggregate(F.zip_with(left, right, lambda a, b: (a.cast("double") - b.cast("double")) * (a.cast("double") - b.cast("double"))), F.lit(0.0), lambda s, x: s + x)
    return F.when((F.size(left) > 0) & (F.size(left) == F.size(right)), F.sqrt(squares))


def common_subsequence(a: str, b: str) -> int:
    """Length of the longest common subsequence; a row of the table is one integer's bits."""
    places: dict[str, int] = {}
    for i, c in enumerate(a):
        places[c] = places.get(c, 0) | 1 << i
    full = (1 << len(a)) - 1
    row = full
    for c in b:
        met = row & places.get(c, 0)
        row = (row + met | row - met) & full
    return len(a) - row.bit_count()


@F.pandas_udf(DoubleType())
def sequence_ratio(left: pd.Series, right: pd.Series) -> pd.Series:
    """Twice the common subsequence over both lengths; 1 for two empty strings, null where either is null."""
    return pd.Series([None if a is None or b is None else 2 * common_subsequence(a, b) / (len(a) + len(b)) if a or b else 1.0 for a, b in zip(left, right)], dtype="float64")


def matching_ratio(a: str, b: str) -> float:
    """Twice the characters in matching blocks over both lengths: the longest block, then those left and right of it. From
    200 characters on, those of ``b`` that are more than a hundredth of it begin no block."""
    return 1.0 if a == b else SequenceMatcher(None, a, b).ratio()


def _may_match(a: str, b: str, least: float) -> bool:
    """Whether lengths and then counts of characters leave room for a ratio of ``least``."""
    whole = len(a) + len(b)
    if 2 * min(len(a), len(b)) < least * whole:
        return False
    return 2 * (Counter(a) & Counter(b)).total() >= least * whole


def _stripped(observation: Column) -> Column:
    """Without element ids; null as empty."""
    return tx.without_ids(F.coalesce(observation, F.lit("")))


@F.pandas_udf(DoubleType())
def _matching(left: pd.Series, right: pd.Series) -> pd.Series:
    return pd.Series([matching_ratio(a, b) for a, b in zip(left, right)], dtype="float64")


def state_similarity(current: Column, target: Column) -> Column:
    """Matching-block ratio of two observations without element ids; a null one is empty."""
    return _matching(_stripped(current), _stripped(target))


def state_match(current: Column, target: Column, url: Column, target_url: Column, least: float = 0.95) -> Column:
    """Whether an observation matches a target by ``least``, or the whole url is the target's; an empty or null target url
    tells nothing.

    Blocks are looked for only where lengths and counts of characters leave room for ``least``. Of two texts of n characters
    that takes about n squared steps at worst, a hundredth of that from 200 characters on."""

    @F.pandas_udf(BooleanType())
    def matched(left: pd.Series, right: pd.Series) -> pd.Series:
        return pd.Series([_may_match(a, b, least) and matching_ratio(a, b) >= least for a, b in zip(left, right)], dtype="bool")

    same = F.coalesce((target_url != "") & (url == target_url), F.lit(False))
    return matched(_stripped(current), _stripped(target)) | same
