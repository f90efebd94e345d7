"""Reading, checking and writing tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F
from pyspark.sql.types import DoubleType, FloatType, StructType

from mirador.sources.workspace import scratch


def scan(spark: SparkSession, path: str, cols: list[str] | None = None) -> DataFrame:
    """Parquet scan of the named columns only."""
    df = spark.read.parquet(path)
    return df.select(*cols) if cols else df


def nan_to_null(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    floats = [
        f.name
        for f in df.schema.fields
        if isinstance(f.dataType, (DoubleType, FloatType)) and (cols is None or f.name in cols)
    ]
    return df.withColumns({c: F.when(~F.isnan(c), F.col(c)) for c in floats}) if floats else df


def unit_spine(df: DataFrame, id: str) -> DataFrame:
    """All unit ids once: the left side of every later join."""
    return df.select(id).distinct()


def validate_schema(df: DataFrame, schema: StructType) -> DataFrame:
    """Input-table contract: the schema's columns must be there with the same types."""
    have = {f.name: f.dataType for f in df.schema.fields}
    wrong = [
        f"{f.name}: want {f.dataType.simpleString()}, have "
        f"{have[f.name].simpleString() if f.name in have else 'no column'}"
        for f in schema.fields
        if have.get(f.name) != f.dataType
    ]
    if wrong:
        raise ValueError("; ".join(wrong))
    return df.select(*[f.name for f in schema.fields])


def write_table(df: DataFrame, path: str, partition_by: list[str] | None = None) -> None:
    df.write.mode("overwrite").partitionBy(*(partition_by or [])).parquet(path)


def write_sorted(df: DataFrame, path: str, by: list[Column | str], files: int | None = None) -> None:
    """Write so that the files, in the order of their names, hold the rows in order.

    Rows are dealt out by ranges of ``by``, whose last column should be an id: it cuts long ties.
    """
    dealt = df.repartitionByRange(files, *by) if files else df.repartitionByRange(*by)
    dealt.sortWithinPartitions(*by).write.mode("overwrite").parquet(path)


def read_positions(spark: SparkSession, path: str, name: str = "position") -> DataFrame:
    """Sorted output with the place of each row, from 1: rows of the files before, and the row in its file."""
    rows = spark.read.parquet(path).select("*", F.col("_metadata.file_name").alias("_file"), F.col("_metadata.row_index").alias("_row"))
    files = rows.groupBy("_file").agg(F.count(F.lit(1)).alias("_rows"))
    before = Window.orderBy("_file").rowsBetween(Window.unboundedPreceding, -1)  # one row per file
    files = files.select("_file", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_before"))
    placed = rows.join(files, "_file").withColumn(name, F.col("_before") + F.col("_row") + 1)
    return placed.drop("_file", "_row", "_before")


CSV_OPTIONS = {
    "header": True,
    "escape": '"',
    "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS",
    "nullValue": "\\N",
}


def write_csv(df: DataFrame, path: str) -> None:
    """Text hand-off: full timestamps, quoted text, empty text kept apart from null."""
    df.write.mode("overwrite").options(**CSV_OPTIONS).csv(path)


def read_csv(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """Read with a declared schema; nothing is inferred, and a bad line is an error."""
    return spark.read.options(**CSV_OPTIONS, mode="FAILFAST").csv(path, schema=schema)


def stage(df: DataFrame, name: str = "table") -> DataFrame:
    """Write to the current workspace in the shared folder and read back.

    Cuts the lineage: a lost executor re-reads files instead of recomputing, and every
    later use sees the same values even where they came from floating-point sums.
    """
    spark = df.sparkSession
    path = scratch(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
