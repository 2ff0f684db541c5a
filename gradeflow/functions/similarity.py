"""String similarities that SQL lacks, as Arrow functions over distinct pairs."""

from __future__ import annotations

from difflib import SequenceMatcher

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType

from .automata import SuffixAutomaton
from .text import clean_name


#: Pairs whose names make one automaton.
PAIRS = 2048


def common_substring(a: str, b: str) -> int:
    """Length of the longest common substring."""
    return next((n for _, n in SuffixAutomaton([b]).common(a, 1)), 0)


@F.pandas_udf(IntegerType())
def common_substring_length(a: pd.Series, b: pd.Series) -> pd.Series:
    """Of pairs of a text and a name: one automaton for the names of some thousand pairs, and one walk for each text."""
    out = np.zeros(len(a), np.int32)
    for at in range(0, len(a), PAIRS):
        rows: dict[str, list[int]] = {}
        texts, names = a.iloc[at : at + PAIRS].fillna("").tolist(), b.iloc[at : at + PAIRS].fillna("").tolist()
        for i, text in enumerate(texts):
            rows.setdefault(text, []).append(i)
        number = {name: k for k, name in enumerate(dict.fromkeys(names))}
        automaton = SuffixAutomaton(list(number))
        for text, own in rows.items():
            asked = {number[names[i]] for i in own}
            size = dict(automaton.common(text, sum(1 << k for k in asked)))
            for i in own:
                out[at + i] = size.get(number[names[i]], 0)
    return pd.Series(out)


@F.pandas_udf(DoubleType())
def ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """2 * matching characters / all characters; 0 if one side is empty and 1 if both are equal."""
    return pd.Series([1.0 if x == y else SequenceMatcher(None, x, y).ratio() if x and y else 0.0 for x, y in zip(a.fillna(""), b.fillna(""))])


def name_similarity(a: Column, b: Column) -> Column:
    """1 for equal names, 0.95 for equal clean names, else the longest common substring over the longer length."""
    longer = F.greatest(F.length(a), F.length(b))
    return F.when(a == b, 1.0).when(clean_name(a) == clean_name(b), 0.95).when(longer > 0, common_substring_length(a, b) / longer).otherwise(0.0)
