"""Text keys: column names, pair lists, budget labels, arrays printed into a cell."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# The characters a column name keeps, and the text of an empty pair list.
NAME_CHARACTERS = "[^A-Za-z0-9_]+"
EMPTY_PAIRS = "empty"


def clean_name(name: str) -> str:
    return re.sub(NAME_CHARACTERS, "", name)


def pairs_key(pairs: str | Column) -> Column:
    """array<array<string>> -> `A+B-C+D`; `empty` when there are no pairs."""
    col = F.col(pairs) if isinstance(pairs, str) else pairs
    text = F.array_join(F.transform(col, lambda p: F.array_join(p, "+")), "-")
    return F.when(F.size(col) == 0, EMPTY_PAIRS).otherwise(text)


def pairs_key_text(pairs: Sequence[Sequence[str]]) -> str:
    """The same key for a driver-side list."""
    return "-".join("+".join(p) for p in pairs) or EMPTY_PAIRS


def epsilon_label(eps: str | Column) -> Column:
    """0.1 -> `01`, 1.0 -> `10`. For labels only; stored budgets stay doubles."""
    col = F.col(eps) if isinstance(eps, str) else eps
    return F.replace(col.cast("double").cast("string"), F.lit("."), F.lit(""))


def epsilon_from_label(label: str | Column) -> Column:
    """`01` -> 0.1; the first digit is the whole part."""
    col = F.col(label) if isinstance(label, str) else label
    return F.concat(F.substring(col, 1, 1), F.lit("."), F.substr(col, F.lit(2))).cast("double")


def run_key(dataset: str | Column, eps: str | Column, query: str | Column) -> Column:
    """`dataset_01e_query`."""
    cols = [F.col(c) if isinstance(c, str) else c for c in (dataset, query)]
    return F.concat_ws("_", cols[0], F.concat(epsilon_label(eps), F.lit("e")), cols[1])


def parse_number_list(text: str | Column) -> Column:
    """`[1.0 2.5  3]` or `[1.0, 2.5]` printed into a cell -> array<double>."""
    col = F.col(text) if isinstance(text, str) else text
    inner = F.trim(F.regexp_replace(F.regexp_replace(col, r"[\[\]()]", " "), r"[\s,]+", " "))
    return F.when(inner == "", F.array().cast("array<double>")).otherwise(
        F.transform(F.split(inner, " "), lambda x: x.try_cast("double")))


def parse_pair_list(text: str | Column) -> Column:
    """`[('A', 'B'), ('C', 'D')]` printed into a cell -> array<array<string>>."""
    col = F.col(text) if isinstance(text, str) else text
    groups = F.regexp_extract_all(col, F.lit(r"\(([^()]*)\)"), F.lit(1))
    return F.transform(groups, lambda g: F.regexp_extract_all(g, F.lit(r"'([^']*)'"), F.lit(1)))
