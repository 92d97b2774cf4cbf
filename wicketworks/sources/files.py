"""CSV and parquet scans with declared types."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wicketworks.schema import DELIVERIES, MATCHES


#: Holds the line of a row that has more or fewer values than the header.
_LINE = "_line"


def _typed(field: T.StructField) -> Column:
    text = F.col(f"`{field.name}`")
    if isinstance(field.dataType, T.StringType):
        # Spark reads a blank as null and NA as text; here blank is '' and NA is null.
        return F.when(text == "NA", F.lit(None)).otherwise(F.coalesce(text, F.lit(""))).alias(field.name)
    number = text.try_cast(field.dataType)
    if isinstance(field.dataType, T.IntegralType):
        # Whole numbers may be written with decimals or an exponent.
        wide = text.try_cast("double")
        number = F.coalesce(number, F.when(wide == F.floor(wide), wide.try_cast(field.dataType)))
    return number.alias(field.name)


def _refused(field: T.StructField) -> Column:
    """What stands in a number column and is no number; null if all is well."""
    text = F.col(f"`{field.name}`")
    wrong = text.isNotNull() & (F.trim(text) != "") & (text != "NA") & _typed(field).isNull()
    return F.when(wrong, F.struct(F.lit(field.name).alias("column"), text.alias("text")))


def read_csv(
    spark: SparkSession,
    path: str | list[str],
    schema: T.StructType,
    *,
    multi_line: bool = False,
    row_order: str | None = None,
    rejects: str | None = None,
) -> DataFrame:
    """The columns of ``schema`` from CSV files with a header, found by name.

    Other columns are not parsed. In a text column a blank is an empty string and ``NA`` is null;
    in a number column a blank, ``NA`` or any text that is no number is null; an integer may be written
    ``2008.0`` or ``1e3``. All files must have
    the header of the first. ``multi_line`` allows line breaks inside quotes, at the price of one
    task per file. ``row_order`` names a column to hold the place of the row in the files.

    ``rejects`` names a column to hold what could not be read, as (column, text) pairs: texts that are no numbers, and, with no
    column, the whole line if it has more or fewer values than the header. The rows themselves stay. ``reject_count``
    counts them in the pass that uses the table, ``rejected`` lists them.
    """
    reader = spark.read.option("header", True).option("escape", '"').option("multiLine", multi_line)
    names = reader.csv(path).columns
    text = T.StructType([T.StructField(name, T.StringType()) for name in names])
    if rejects:
        # Lines are only compared with the header where all their values are parsed.
        reader = reader.option("columnPruning", False).option("columnNameOfCorruptRecord", _LINE)
        text = text.add(_LINE, T.StringType())
    rows = reader.option("enforceSchema", False).schema(text).csv(path)
    columns = [_typed(field) for field in schema.fields]
    if rejects:
        line = F.when(F.col(_LINE).isNotNull(), F.struct(F.lit(None).cast("string").alias("column"), F.col(_LINE).alias("text")))
        numbers = [_refused(f) for f in schema.fields if not isinstance(f.dataType, T.StringType)]
        columns.append(F.array_compact(F.array(line, *numbers)).alias(rejects))
    if row_order:
        columns.append(file_order().alias(row_order))
    return rows.select(*columns)


def reject_count(column: str = "rejects") -> Column:
    """Aggregate: how many values of a table read with ``rejects`` could not be read."""
    return F.coalesce(F.sum(F.size(column)), F.lit(0))


def rejected(rows: DataFrame, column: str = "rejects") -> DataFrame:
    """One row for each value that could not be read: its column, its text, and the row that it stands in as ``row``."""
    others = F.struct(*(c for c in rows.columns if c != column)).alias("row")
    return rows.where(F.size(column) > 0).select(F.explode(column).alias("found"), others).select("found.*", "row")


def file_order() -> Column:
    """Sortable place of a row in a file scan: file, block in the file, row in the block."""
    return F.struct(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("row"),
    )


def _read(
    spark: SparkSession, path: str | list[str], schema: T.StructType, format: str, **options
) -> DataFrame:
    if format == "csv":
        named = [p for p in ([path] if isinstance(path, str) else path) if p.rstrip("/").endswith(".parquet")]
        if named:
            raise ValueError(f"{named[0]} is named as parquet; say format='parquet'")
        return read_csv(spark, path, schema, **options)
    if format == "parquet":
        if options:
            raise ValueError(f"options of CSV: {', '.join(options)}")
        paths = [path] if isinstance(path, str) else path
        return spark.read.parquet(*paths).select(*(F.col(f.name).cast(f.dataType) for f in schema.fields))
    raise ValueError(f"format {format!r} is neither 'csv' nor 'parquet'")


def read_deliveries(spark: SparkSession, path: str | list[str], format: str = "csv", **options) -> DataFrame:
    """One row per ball, from files of one format, ``csv`` or ``parquet``, under any name."""
    return _read(spark, path, DELIVERIES, format, **options)


def read_matches(spark: SparkSession, path: str | list[str], format: str = "csv", **options) -> DataFrame:
    """One row per match, from files of one format, ``csv`` or ``parquet``, under any name."""
    return _read(spark, path, MATCHES, format, **options)
