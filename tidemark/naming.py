"""Column-name contract of wide entity rows.

``{group}_{subgroup}_{factor}_..._{suffix}``: the prefix gives the role of a column, the third
token its factor, the suffix the way it is cleaned.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Sequence

from pyspark.sql import types as T

from tidemark.functions.letters import fold

# Prefixes of columns that are never features.
NON_FEATURE_PREFIXES = ("key", "from", "outcome", "index")

# Round codes and round types, in their order of output.
ROUND_CODES = ("a", "b", "c", "d", "e", "f", "g", "h")
ROUND_TYPES = (
    "angel", "convertible_note", "debt_financing", "equity_crowdfunding", "grant",
    "non_equity_assistance", "post_ipo_debt", "post_ipo_equity", "private_equity",
    "product_crowdfunding", "secondary_market", "seed", "undisclosed", "venture",
)


def is_feature(name: str) -> bool:
    return not name.startswith(NON_FEATURE_PREFIXES)


def factor_of(name: str) -> str | None:
    tokens = name.split("_")
    return tokens[2] if len(tokens) > 2 else None


def cleaning_of(name: str) -> str:
    """Which cleaner a raw column goes to, decided by its suffix."""
    base = name.split(":")[0]
    if base.endswith(("bool", "date", "duration")):
        return "keep"
    if base.endswith("date_pair"):
        return "pair_dates"
    if base.endswith("pair"):
        return "pair_sum"
    if base.endswith("types_list"):
        return "types"
    if base.endswith("codes_list"):
        return "codes"
    if base.endswith("list"):
        return "top_list"
    if base.endswith("number"):
        return "number"
    if base.startswith("keys"):
        return "keep"
    return "drop"


def plain_name(name: str) -> str:
    """A column name in ASCII as far as its letters are known, without outer blanks, with ``-`` for inner blanks."""
    return fold(unicodedata.normalize("NFKC", name)).strip().replace(" ", "-")


def by_plain_name(values: Sequence[str]) -> dict[str, list[str]]:
    """Column name → the values that fold to it, in order."""
    found: dict[str, list[str]] = {}
    for v in dict.fromkeys(values):
        found.setdefault(plain_name(v.lower()), []).append(v)
    return found


def numeric_fields(schema: T.StructType) -> list[str]:
    return [f.name for f in schema.fields if isinstance(f.dataType, T.NumericType)]


def feature_names(schema: T.StructType) -> list[str]:
    """Sorted numeric columns whose name has no key or outcome role."""
    return sorted(n for n in numeric_fields(schema) if is_feature(n))
