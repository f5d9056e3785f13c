"""Sales files with bad rows: one scan gives every row with the reasons that speak against it."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfcast.schema import DATE_FORMATS, REQUIRED_COLUMNS, require_columns
from shelfcast.sources.sales import coerce_sales, resolve_columns

#: Columns of a scanned table beside those of the file.
RECORD, REASONS = "record", "reasons"
# Options by which fields become a line again without being trimmed or quoted anew.
AS_READ = {"ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false", "emptyValue": ""}
#: What a value of a required column has to be.
WANTED = {"date": "a date", "store": "a whole number", "item": "a whole number", "sales": "a number"}


def scan_sales(
    spark: SparkSession,
    path: str,
    date_formats=DATE_FORMATS,
    columns: Sequence[str] | None = None,
    needed: Sequence[str] = ("date", "store", "item"),
    multi_line: bool = False,
) -> tuple[DataFrame, list[str]]:
    """All rows of sales CSVs, and one warning per renamed column.

    The rows have the canonical columns with their types, further columns as text, ``record`` (the line as it
    stands in the file where its number of fields is wrong, else its fields as CSV) and ``reasons``, an empty
    array for good rows. A row is bad if it has fewer or more fields than the header, if a value of a required
    column does not convert, or if one of the ``needed`` columns has none. A missing number of sales is no fault: cleaning
    fills it.

    ``columns`` names the fields of files without a header. Files with one must agree with the first file's.
    ``multi_line`` allows line breaks in quoted fields. Nothing but the first line is read before the result is used.
    """
    reader = spark.read.option("header", columns is None).option("multiLine", multi_line)
    names = list(columns) if columns is not None else reader.csv(path).columns
    if not names:
        raise ValueError(f"{path} is empty: a sales file has a header and at least one row")
    taken = {n.lower() for n in names}
    if clash := {RECORD, REASONS} & taken:
        raise ValueError(f"columns of the file must not be called {sorted(clash)}")
    line, fields, bad = (_unused(stem, taken) for stem in ("_line", "_fields", "_bad"))
    schema = ", ".join(f"`{n.replace('`', '``')}` string" for n in [*names, line])
    # Without enforceSchema a file whose header differs fails instead of being read by position.
    # All fields are parsed whatever columns are used, as their number tells whether a line is whole.
    modes = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": line, "columnPruning": False}
    raw = reader.schema(schema).options(enforceSchema=columns is not None, **modes).csv(path)
    renames = resolve_columns(names)
    warnings = [f"Mapped `{found}` → `{wanted}`" for found, wanted in renames.items()]
    return _judged(raw, names, renames, (line, fields, bad), date_formats, needed), warnings


def _unused(stem: str, taken: set[str]) -> str:
    while stem in taken:
        stem = f"_{stem}"
    return stem


def _judged(raw, names, renames, helpers, date_formats, needed):
    unknown = set(needed) - set(REQUIRED_COLUMNS)
    if unknown:
        raise ValueError(f"needed columns are some of {list(REQUIRED_COLUMNS)}, got {sorted(unknown)}")
    line, fields, bad = helpers
    whole = F.struct(*[F.col(f"`{n}`") for n in names])
    kept = raw.withColumns({RECORD: F.coalesce(F.col(line), F.to_csv(whole, AS_READ)), fields: whole, bad: F.col(line)}).drop(line)
    coerced = coerce_sales(kept.withColumnsRenamed(renames), date_formats)
    origin = {wanted: found for found, wanted in renames.items()}
    short, long = F.lit("too few fields"), F.lit("too many fields")
    n_fields = _number_of_fields(F.col(bad))
    reasons = [F.when(n_fields < len(names), short).when(n_fields > len(names), long).when(F.col(bad).isNotNull(), F.lit("malformed line"))]
    for name, wanted in WANTED.items():
        given = F.trim(F.col(fields)[origin.get(name, name)])
        absent = F.lit(f"{name} is missing") if name in needed else F.lit(None).cast("string")
        judged = F.when(F.coalesce(given, F.lit("")) == "", absent).otherwise(F.lit(f"{name} is not {wanted}"))
        # a field that a short line lacks is no fault of its own
        reasons.append(F.when(F.col(name).isNull() & F.col(bad).isNull(), judged))
    return coerced.withColumn(REASONS, F.array_compact(F.array(*reasons))).drop(fields, bad)


def _number_of_fields(line: Column) -> Column:
    """Fields of a CSV line: separators outside quotes, and one. Null for null."""
    unquoted = F.regexp_replace(line, '"[^"]*"', "")
    return F.length(unquoted) - F.length(F.replace(unquoted, F.lit(","), F.lit(""))) + 1


def accepted_rows(scanned: DataFrame) -> DataFrame:
    """Rows without a fault, as a sales table."""
    require_columns(scanned, [RECORD, REASONS], "Scanned table must contain columns")
    return scanned.where(F.size(REASONS) == 0).drop(RECORD, REASONS)


def rejected_rows(scanned: DataFrame) -> DataFrame:
    """``record`` and ``reasons`` of the others."""
    require_columns(scanned, [RECORD, REASONS], "Scanned table must contain columns")
    return scanned.where(F.size(REASONS) > 0).select(RECORD, REASONS)


def reason_counts(scanned: DataFrame) -> DataFrame:
    """How many rows each ``reason`` speaks against; a row with two counts for both."""
    return scanned.select(F.explode(REASONS).alias("reason")).groupBy("reason").agg(F.count("*").alias("n_rows"))


def write_quarantine(scanned: DataFrame, path: str, mode: str = "errorifexists") -> tuple[DataFrame, DataFrame]:
    """Writes a scanned table once, as Parquet split into accepted and rejected rows, and returns both as read back.

    The file is scanned a single time for both; each result then reads its own partition only.
    """
    scanned.withColumn("rejected", F.size(REASONS) > 0).write.mode(mode).partitionBy("rejected").parquet(path)
    schema = scanned.schema.add("rejected", "boolean")
    back = scanned.sparkSession.read.schema(schema).parquet(path)
    good, bad = back.where(~F.col("rejected")), back.where(F.col("rejected"))
    return good.drop("rejected", RECORD, REASONS), bad.select(RECORD, REASONS)
