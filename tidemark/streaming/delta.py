"""Tables of deltas with a commit file each, so that writers, readers and compaction agree on what is live.

A table is a folder with ``data/`` (one folder of Parquet for each delta) and ``commits/`` (one JSON row for each
committed delta: its name, its folder, and the names that it replaces). A delta exists once its commit does; what a
stopped writer left in ``data/`` is not read. A delta that another one replaces is no longer read, but its files stay,
so readers that began before are not disturbed. No commit is ever rewritten, and two writers never write the same one.

Only the commits come to the driver: a row for each delta since the table began.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterable, Sequence

from pyspark.sql import DataFrame, SparkSession

from tidemark.sources.files import path_exists

SCHEMA = "name string, folder string, replaces array<string>"


def commits(spark: SparkSession, table: str) -> dict[str, tuple[str, list[str]]]:
    """name → (folder, names replaced) of all commits; none of a table that does not exist yet."""
    if not path_exists(spark, f"{table}/commits"):
        return {}
    rows = spark.read.schema(SCHEMA).json(f"{table}/commits/*").collect()
    return {r["name"]: (r["folder"], list(r["replaces"] or ())) for r in rows if r["name"] is not None}


def live(spark: SparkSession, table: str) -> dict[str, str]:
    """name → folder of the deltas that make up the table now."""
    known = commits(spark, table)
    gone = {name for _, replaced in known.values() for name in replaced}
    return {name: folder for name, (folder, _) in known.items() if name not in gone}


def add(df: DataFrame, table: str, name: str, replaces: Sequence[str] = ()) -> bool:
    """Write ``df`` as the delta ``name`` and commit it. False, and nothing done, if ``name`` is committed already.

    A batch that is run again after a failure is thus stored once, also after a compaction has replaced it.
    """
    spark = df.sparkSession
    if path_exists(spark, f"{table}/commits/{name}/_SUCCESS"):
        return False
    folder = f"{name}-{uuid.uuid4().hex}"
    df.write.parquet(f"{table}/data/{folder}")
    entry = spark.createDataFrame([(name, folder, list(replaces))], SCHEMA).coalesce(1)
    entry.write.mode("overwrite").json(f"{table}/commits/{name}")
    return True


def read_folders(spark: SparkSession, table: str, folders: Iterable[str]) -> DataFrame:
    """The rows of the given deltas, columns merged. No deltas are an error, as there are no columns."""
    paths = [f"{table}/data/{f}" for f in sorted(folders)]
    if not paths:
        raise ValueError(f"no committed delta in {table}")
    return spark.read.option("mergeSchema", "true").parquet(*paths)


def read(spark: SparkSession, table: str) -> DataFrame:
    """The live rows of a table."""
    return read_folders(spark, table, live(spark, table).values())


def replace_live(df: DataFrame, table: str, seen: Sequence[str]) -> str:
    """Commit ``df`` in place of the deltas ``seen``. Deltas committed meanwhile stay beside it.

    One compaction of a table is to run at a time: one that finds its deltas replaced by another one raises.
    """
    missing = set(seen) - set(live(df.sparkSession, table))
    if missing:
        raise RuntimeError(f"{table} was compacted meanwhile: {len(missing)} of {len(seen)} deltas are replaced already")
    name = f"compacted-{uuid.uuid4().hex}"
    add(df, table, name, seen)
    return name
