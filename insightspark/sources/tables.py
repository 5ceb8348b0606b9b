"""Readers, writers and table metadata."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

SUFFIXES = {".csv": "csv", ".parquet": "parquet", ".json": "json", ".jsonl": "json"}


class TableNotFound(ValueError):
    """No such table; the message names the ones there are."""


def _hadoop_path(spark: SparkSession, path: str):
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    return jpath, jpath.getFileSystem(spark._jsc.hadoopConfiguration())


def is_file(spark: SparkSession, path: str) -> bool:
    """True when the path is one file rather than a folder."""
    jpath, fs = _hadoop_path(spark, path)
    return fs.exists(jpath) and fs.getFileStatus(jpath).isFile()


def _suffix(path: str) -> str:
    name = path.rstrip("/").rsplit("/", 1)[-1]
    return f".{name.rsplit('.', 1)[-1].lower()}" if "." in name else ""


def table_names(spark: SparkSession, folder: str) -> list[str]:
    """Names of the tables in a folder of any Hadoop file system (metadata only)."""
    jpath, fs = _hadoop_path(spark, folder)
    if not fs.exists(jpath):
        return []
    names = [s.getPath().getName() for s in fs.listStatus(jpath)]
    return sorted({n.rsplit(".", 1)[0] for n in names if _suffix(n) in SUFFIXES})


def list_tables(spark: SparkSession, folder: str | None = None) -> DataFrame:
    """Sorted table names of a folder, or of the session catalog."""
    if folder is None:
        return spark.sql("SHOW TABLES").select(F.col("tableName").alias("table_name")).orderBy("table_name")
    rows = [(n,) for n in table_names(spark, folder)]
    return spark.createDataFrame(rows, "table_name string")


def read_source(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    """Read CSV, Parquet or JSON by suffix."""
    kind = SUFFIXES.get(_suffix(path))
    if kind is None:
        raise ValueError(f"unsupported file type: {path} (use one of {', '.join(SUFFIXES)})")
    reader = spark.read.schema(schema) if schema is not None else spark.read
    if kind == "csv":
        reader = reader.option("header", True)
        if schema is None:
            reader = reader.option("inferSchema", True)
    return reader.format(kind).load(path)


def read_table(spark: SparkSession, name: str, folder: str, schema: T.StructType | None = None) -> DataFrame:
    """Header CSV by table name; the error lists what is available."""
    jpath, fs = _hadoop_path(spark, f"{folder.rstrip('/')}/{name}.csv")
    if not fs.exists(jpath):
        raise TableNotFound(f"table '{name}' not found; available: {', '.join(table_names(spark, folder))}")
    return read_source(spark, f"{folder.rstrip('/')}/{name}.csv", schema)


def read_jdbc(spark: SparkSession, url: str, table: str, partition_column: str | None = None,
              lower=None, upper=None, partitions: int = 64, fetch_size: int = 10000, **options) -> DataFrame:
    """Table or ``(query) alias`` over JDBC; bounds split the read over tasks."""
    reader = spark.read.format("jdbc").option("url", url).option("dbtable", table).option("fetchsize", fetch_size)
    if partition_column is not None:
        if lower is None or upper is None:
            raise ValueError("a partitioned read needs lower and upper bounds")
        reader = (reader.option("partitionColumn", partition_column).option("lowerBound", lower)
                        .option("upperBound", upper).option("numPartitions", partitions))
    for key, value in options.items():
        reader = reader.option(key, value)
    return reader.load()


def describe(df: DataFrame) -> DataFrame:
    """(position, column, type, nullable) from the schema."""
    rows = [(i, f.name, f.dataType.simpleString(), f.nullable) for i, f in enumerate(df.schema.fields)]
    return df.sparkSession.createDataFrame(
        rows, "position int, column_name string, data_type string, nullable boolean")


def first_available(sources: list[tuple[str, object]]) -> tuple[str, DataFrame]:
    """Try the (label, thunk) sources in order and return the first that resolves."""
    failures = []
    for label, thunk in sources:
        try:
            frame = thunk()
            frame.schema  # analysis happens here, no data is read
            return label, frame
        except Exception as exc:  # noqa: BLE001 - any failure means "try the next"
            failures.append(f"{label}: {type(exc).__name__}")
    raise TableNotFound("no source answered: " + "; ".join(failures))


def with_fallback(sources: list[tuple[str, object]]) -> DataFrame:
    """Data of the first answering source with a ``source`` column."""
    label, frame = first_available(sources)
    return frame.withColumn("source", F.lit(label))


def read_log(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """JSON lines; malformed lines are dropped."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)


def append_log(df: DataFrame, path: str) -> None:
    """Append rows to a JSON-lines log folder."""
    df.write.mode("append").json(path)


def write_table(df: DataFrame, path: str, fmt: str = "parquet", partition_by: tuple = (), mode: str = "overwrite"):
    """Write a result; ``partition_by`` lays it out for partition pruning."""
    writer = df.write.mode(mode).format(fmt)
    if fmt == "csv":
        writer = writer.option("header", True)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.save(path)


def preview(df: DataFrame, n: int = 500, max_chars: int = 100_000) -> DataFrame:
    """First ``n`` rows with a truncation flag; a quarter of them when their text is longer than ``max_chars`` (``shortened`` says so).

    The rows are read once, so the flags speak of the rows shown.
    """
    row = F.struct(*[F.col(f"`{c}`") for c in df.columns])
    one = df.limit(n + 1).select(row.alias("r")).agg(F.collect_list("r").alias("r"), F.sum(F.length(F.to_json("r"))).alias("chars"))  # n + 1 rows at most
    shortened = F.coalesce(F.col("chars") > max_chars, F.lit(False))
    keep = F.when(shortened, n // 4).otherwise(n)
    shown = one.select(F.slice("r", F.lit(1), keep).alias("s"), (F.size("r") > keep).alias("truncated"), shortened.alias("shortened"))
    return shown.select(F.explode("s").alias("s"), "truncated", "shortened").select("s.*", "truncated", "shortened")


def result_estimate(df: DataFrame) -> DataFrame:
    """Row count before pulling a result."""
    return df.agg(F.count(F.lit(1)).alias("n_rows"))
