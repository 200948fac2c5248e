"""Files, snapshots, database readers and the slice store."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# How the CSV dumps are written.
CSV_OPTIONS = {
    "header": "true", "sep": ",", "quote": '"', "escape": '"', "multiLine": "true",
    "ignoreLeadingWhiteSpace": "true", "mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record",
}


def loaded_schema(schema: T.StructType) -> T.StructType:
    """Types of a loaded relation: every column nullable, booleans widened to integers."""
    return T.StructType([
        T.StructField(f.name, T.IntegerType() if isinstance(f.dataType, T.BooleanType) else f.dataType, True)
        for f in schema.fields])


def read_csv(spark: SparkSession, path: str, schema: T.StructType | None = None, keep_corrupt: bool = False, **options: str) -> DataFrame:
    """A CSV relation. Give the schema where it is known: inference reads the data twice.

    Ragged or mistyped rows keep what could be read; ``keep_corrupt`` adds their raw text. Texts may hold
    line breaks; pass ``multiLine="false"`` where they do not, so that large files are split over tasks.
    """
    reader = spark.read.options(**{**CSV_OPTIONS, **options})
    if schema is None:
        df = reader.option("inferSchema", "true").csv(path)
    else:
        fields = list(schema.fields)
        if keep_corrupt:
            fields.append(T.StructField("_corrupt_record", T.StringType(), True))
        df = reader.schema(T.StructType(fields)).csv(path)
    flags = {c: F.col(c).cast("int") for c, t in df.dtypes if t == "boolean"}
    return df.withColumns(flags) if flags else df


def read_snapshot(spark: SparkSession, directory: str, relations: Mapping[str, T.StructType | None], fmt: str = "csv") -> dict[str, DataFrame]:
    """Named relations of a dump directory, ``{directory}/{name}.{fmt}``."""
    out = {}
    for name, schema in relations.items():
        path = f"{directory.rstrip('/')}/{name}.{fmt}"
        out[name] = read_csv(spark, path, schema) if fmt == "csv" else spark.read.format(fmt).load(path)
    return out


def write_csv(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    df.write.options(header="true", quoteAll="true", escape='"', timestampNTZFormat="yyyy-MM-dd HH:mm:ss.SSSSSS").mode(mode).csv(path)


def write_snapshot(snapshot: Mapping[str, DataFrame], directory: str, fmt: str = "parquet", mode: str = "errorifexists") -> None:
    for name, df in snapshot.items():
        path = f"{directory.rstrip('/')}/{name}.{fmt}"
        if fmt == "csv":
            write_csv(df, path, mode)
        else:
            df.write.mode(mode).format(fmt).save(path)


def read_limited(df: DataFrame, order: list[str], n: int | None = None) -> DataFrame:
    """The first ``n`` rows in a total order; a fixed choice, unlike ``limit`` alone."""
    return df if n is None else df.orderBy(*order).limit(n)


def read_json_documents(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """A directory of JSON files with one document each; the schema is given, never inferred."""
    return spark.read.schema(schema).option("multiLine", "true").json(path)


def jdbc_options(url: str, table: str, partition_column: str | None = None, bounds: tuple | None = None, partitions: int = 1) -> dict[str, str]:
    """Reader options of a database table; reads in ranges of ``partition_column`` when it is given."""
    options = {"url": url, "dbtable": table, "fetchsize": "10000"}
    if partition_column is not None:
        if bounds is None:
            raise ValueError("a partitioned read needs the lower and upper bound of its column")
        options |= {"partitionColumn": partition_column, "lowerBound": str(bounds[0]), "upperBound": str(bounds[1]),
                    "numPartitions": str(partitions)}
    return options


def read_jdbc(spark: SparkSession, url: str, table: str, **how) -> DataFrame:
    return spark.read.format("jdbc").options(**jdbc_options(url, table, **how)).load()


def register_snapshot(snapshot: Mapping[str, DataFrame], prefix: str = "") -> list[str]:
    """Temporary views of a snapshot's relations; the names are returned in order."""
    for name, df in snapshot.items():
        df.createOrReplaceTempView(f"{prefix}{name}")
    return sorted(f"{prefix}{n}" for n in snapshot)


def list_relations(spark: SparkSession) -> list[str]:
    return sorted(t.name for t in spark.catalog.listTables())


def path_exists(spark: SparkSession, path: str) -> bool:
    jvm_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    return jvm_path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(jvm_path)


class SliceStore:
    """Materialised slices, one parquet table per role and slice date, built once and then reused."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark = spark
        self.root = root.rstrip("/")

    def path(self, role: str, when: date) -> str:
        return f"{self.root}/{role}/slice_date={when.isoformat()}"

    def get(self, role: str, when: date, build: Callable[[], DataFrame], reuse: bool = True) -> DataFrame:
        path = self.path(role, when)
        # A write that was cut off leaves no success marker and is done again.
        if not (reuse and path_exists(self.spark, f"{path}/_SUCCESS")):
            build().write.mode("overwrite").parquet(path)
        return self.spark.read.parquet(path)
