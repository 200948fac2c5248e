"""Nested documents to relations, by a mapping compiled once into column expressions."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T



def _targets(leaf) -> list[tuple[str, str]]:
    return [tuple(x.split(".", 1)) for x in ([leaf] if isinstance(leaf, str) else leaf)]


class _Spot:
    """A place in the documents: its SQL, its type and the lists that are unfolded on the way."""

    def __init__(self, sql: str, kind: T.DataType, lists: tuple[str, ...] = ()):
        self.sql, self.kind, self.lists = sql, kind, lists

    def unfolded(self) -> "_Spot":
        """The element if the place is a list (of lists), which makes a row of each."""
        spot = self
        while isinstance(spot.kind, T.ArrayType):
            spot = _Spot(f"item{len(spot.lists)}", spot.kind.elementType, (*spot.lists, spot.sql))
        return spot

    def below(self, path: str) -> "_Spot":
        """The place at a dotted path; lists on the way are unfolded, open maps are looked up by key."""
        spot = self
        for part in path.split("."):
            spot = spot.unfolded()
            if isinstance(spot.kind, T.StructType) and part in spot.kind.fieldNames():
                spot = _Spot(f"{spot.sql}.`{part}`", spot.kind[part].dataType, spot.lists)
            elif isinstance(spot.kind, T.MapType):
                spot = _Spot(f"try_element_at({spot.sql}, '{part}')", spot.kind.valueType, spot.lists)
            else:
                raise KeyError(f"the documents have no path {path!r} below {self.sql}: {spot.kind.simpleString()[:200]}")
        return spot.unfolded()


class _Plan:
    """For each relation and the lists it is unfolded from: the spot of each attribute."""

    def __init__(self):
        self.columns: dict[tuple[str, tuple[str, ...]], dict[str, _Spot]] = {}

    def add(self, relation: str, attribute: str, spot: _Spot) -> None:
        self.columns.setdefault((relation, spot.lists), {})[attribute] = spot

    def common_types(self) -> dict[tuple[str, str], T.DataType]:
        """One type for an attribute of a relation that comes from several places: its own, double for numbers, or string."""
        found: dict[tuple[str, str], set] = {}
        for (relation, _), columns in self.columns.items():
            for attribute, spot in columns.items():
                found.setdefault((relation, attribute), set()).add(spot.kind)
        return {k: _common(kinds) for k, kinds in found.items()}


def _common(kinds: set) -> T.DataType:
    if len(kinds) == 1:
        return next(iter(kinds))
    if all(isinstance(k, T.NumericType) for k in kinds):
        whole = all(isinstance(k, T.IntegralType) for k in kinds)
        return T.LongType() if whole else T.DoubleType()
    return T.StringType()


def _as(spot: _Spot, kind: T.DataType) -> str:
    if isinstance(kind, T.StringType) and isinstance(spot.kind, (T.StructType, T.MapType)):
        return f"to_json({spot.sql})"
    return spot.sql if spot.kind == kind else f"CAST({spot.sql} AS {kind.simpleString()})"


def _compile(tree: Mapping, at: _Spot, plan: _Plan, strict: bool) -> None:
    for key, below in tree.items():
        if key is True or key is False:
            for relation, attribute in _targets(below):
                plan.add(relation, attribute, _Spot(str(key).lower(), T.BooleanType(), at.lists))
            continue
        try:
            spot = at.below(key)
        except KeyError as unknown:
            if strict:
                raise ValueError(unknown.args[0]) from None
            continue
        if isinstance(below, Mapping):
            _compile(below, spot, plan, strict)
        else:
            for relation, attribute in _targets(below):
                plan.add(relation, attribute, spot)


def normalize_documents(
    df: DataFrame, document: str, mapping: Mapping, keys: Mapping[str, Sequence[str]], min_attributes: int = 2, typed: bool = False,
    strict: bool | None = None,
) -> dict[str, DataFrame]:
    """Relations of a column of nested documents.

    ``mapping`` mirrors the documents: a leaf names the ``relation.attribute`` (or several) that take
    the value, a ``True`` key sets a constant flag, dotted keys step down, lists become one row per
    element wherever they stand on a path. A path that the documents do not have raises ValueError if ``strict``
    (by default for typed relations) and is left out otherwise.
    ``keys`` maps the document's key fields, best first, to the ``relation.attribute`` targets
    that carry it in every row; a key field may be missing. Records with fewer than ``min_attributes`` values are dropped.
    ``typed`` keeps the documents' types (the common one where an attribute has several); otherwise all values are text.
    """
    at = _Spot(f"`{document}`", df.schema[document].dataType)
    if isinstance(at.kind, T.StructType) and "data" in at.kind.fieldNames():
        df = df.select(F.col(f"{document}.data").alias(document))
        at = _Spot(at.sql, at.kind["data"].dataType)
    plan = _Plan()
    _compile(mapping, at, plan, typed if strict is None else strict)
    types = plan.common_types() if typed else {}
    fields = at.kind.fieldNames() if isinstance(at.kind, T.StructType) else []
    present = [at.below(k) for k in keys if k.split(".")[0] in fields]
    if not present:
        raise ValueError(f"the documents have none of the key fields {list(keys)}")
    key_type = _common({k.kind for k in present}) if typed else T.StringType()
    key_sql = "coalesce(" + ", ".join(_as(k, key_type) for k in present) + ")"
    key_columns: dict[str, list[str]] = {}
    for k in keys:
        for relation, attribute in _targets(keys[k]):
            if attribute not in key_columns.setdefault(relation, []):
                key_columns[relation].append(attribute)

    out: dict[str, DataFrame] = {}
    for (relation, lists), columns in plan.columns.items():
        rows = df.select(document)
        for depth, path in enumerate(lists):
            rows = rows.selectExpr("*", f"explode({path}) AS item{depth}")
        own = [f"{key_sql} AS `{a}`" for a in key_columns.get(relation, [])]
        values = [f"{_as(spot, types.get((relation, a), T.StringType()))} AS `{a}`" for a, spot in columns.items()]
        records = drop_sparse(rows.selectExpr(*own, *values), min_attributes)
        out[relation] = records if relation not in out else out[relation].unionByName(records, allowMissingColumns=True)
    return out


def drop_sparse(df: DataFrame, min_attributes: int = 2) -> DataFrame:
    """Records with at least ``min_attributes`` values."""
    return df.where(" + ".join(f"CAST(`{c}` IS NOT NULL AS INT)" for c in df.columns) + f" >= {min_attributes}")


def unpack_properties(df: DataFrame, keys: Sequence[str], json: str) -> DataFrame:
    """An open map of properties, in long form: one row per key, values as text."""
    return df.selectExpr(*keys, f"explode(from_json({json}, 'map<string,string>')) AS (key, value)")


def record_counts(relations: Mapping[str, DataFrame]) -> DataFrame:
    """Records per relation."""
    rows = None
    for name, df in relations.items():
        one = df.select(F.lit(name).alias("relation"))
        rows = one if rows is None else rows.unionByName(one)
    return rows.groupBy("relation").agg(F.count("*").alias("records"))
