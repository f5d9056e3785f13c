"""Reading and validating sales tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shelfcast.functions.dates import parse_date
from shelfcast.schema import COLUMN_ALIASES, DATE_FORMATS, REQUIRED_COLUMNS, SALES_SCHEMA, require_columns


def read_sales(spark: SparkSession, path: str, fmt: str = "csv") -> DataFrame:
    """A sales table whose headers are already canonical; malformed values fail the query.

    No inference pass: CSV columns are read as text and cast.
    """
    if fmt == "csv":
        raw = spark.read.option("header", True).csv(path)
    else:
        raw = spark.read.format(fmt).load(path)
    require_columns(raw, REQUIRED_COLUMNS, "Sales table must contain columns")
    return raw.withColumns({f.name: F.col(f.name).cast(f.dataType) for f in SALES_SCHEMA})


def read_and_validate_sales(
    spark: SparkSession, path: str, date_formats=DATE_FORMATS, strict: bool = False
) -> tuple[DataFrame, list[str]]:
    """Read a sales CSV with any accepted headers; returns the coerced table and one warning per
    renamed column.

    Raises ValueError when the file cannot be read, has no rows, or lacks a required column.
    ``strict`` also fails rows whose number of fields differs from the header's.
    """
    reader = spark.read.option("header", True).option("mode", "FAILFAST" if strict else "PERMISSIVE")
    try:
        raw = reader.csv(path)
        empty = not raw.columns or raw.isEmpty()
    except Exception as error:
        raise ValueError(f"{path} cannot be read as CSV: {error}") from error
    if empty:
        raise ValueError(f"{path} is empty: a sales file has a header and at least one row")
    return validate_sales(raw, date_formats)


def validate_sales(
    raw: DataFrame, date_formats=DATE_FORMATS, observation: Observation | None = None
) -> tuple[DataFrame, list[str]]:
    """Canonical names and types for any table with accepted headers; works on the schema alone. ``observation``
    as in ``coerce_sales``."""
    renames = resolve_columns(raw.columns)
    warnings = [f"Mapped `{found}` → `{wanted}`" for found, wanted in renames.items()]
    return coerce_sales(raw.withColumnsRenamed(renames), date_formats, observation), warnings


def resolve_columns(columns: list[str]) -> dict[str, str]:
    """Found name → canonical name, for the required columns that need renaming.

    Each canonical column takes its first alias present exactly or ignoring case. Canonical names
    already present are left alone.
    """
    by_lower = {c.lower(): c for c in columns}
    renames, unmapped = {}, []
    for wanted, aliases in COLUMN_ALIASES.items():
        if wanted in columns:
            continue
        found = next(
            (a if a in columns else by_lower[a.lower()] for a in aliases if a in columns or a.lower() in by_lower),
            None,
        )
        if found is None:
            unmapped.append(wanted)
        else:
            renames[found] = wanted
    if unmapped:
        raise ValueError(
            f"no column stands for {unmapped}: the table has {list(columns)}, needed are {list(REQUIRED_COLUMNS)}"
        )
    return renames


def coerce_sales(df: DataFrame, date_formats=DATE_FORMATS, observation: Observation | None = None) -> DataFrame:
    """Types of the four required columns; values that do not convert become null, extras pass.

    ``observation`` receives the counts of ``coercion_report`` when the result is first computed as a whole, in the
    same pass over the data. They are exact for a job that reads all rows and loses no stage; a stage that is
    run again counts twice, and a limit or a skipped partition is not counted.
    """
    coerced = {
        "date": _to_date(df, "date", date_formats),
        "store": _to_whole_number(df, "store"),
        "item": _to_whole_number(df, "item"),
        "sales": _to_number(df, "sales"),
    }
    if observation is None:
        return df.withColumns(coerced)
    return _beside_raw(df, coerced).observe(observation, *_coercion_counts()).drop(*_RAW.values())


# The values before the coercion, while they are counted.
_RAW = {c: f"_raw_{c}" for c in REQUIRED_COLUMNS}


def _beside_raw(df, coerced):
    return df.withColumns({_RAW[c]: F.col(c) for c in REQUIRED_COLUMNS}).withColumns(coerced)


def _coercion_counts():
    rejected = [
        F.count_if(F.col(raw).isNotNull() & F.col(c).isNull()).alias(f"{c}_rejected") for c, raw in _RAW.items()
    ]
    return [F.count(F.lit(1)).alias("n_rows"), *rejected]


def coercion_report(raw: DataFrame, date_formats=DATE_FORMATS) -> DataFrame:
    """One row: per required column, how many non-null values become null in the coercion."""
    beside = raw.withColumns({name: F.col(c) for c, name in _RAW.items()})
    return coerce_sales(beside, date_formats).agg(*_coercion_counts())


def extra_columns(df: DataFrame) -> list[str]:
    return [c for c in df.columns if c not in REQUIRED_COLUMNS]


def _to_date(df, name, date_formats):
    value = F.col(name)
    if isinstance(df.schema[name].dataType, T.StringType):
        return parse_date(F.trim(value), date_formats)
    if isinstance(df.schema[name].dataType, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        return value.cast("date")
    return parse_date(value.cast("string"), date_formats)


def _to_number(df, name):
    number = F.col(name).try_cast("double")
    return F.when(~F.isnan(number), number)


def _to_whole_number(df, name):
    if isinstance(df.schema[name].dataType, T.IntegralType):
        return F.col(name).cast("bigint")
    number = F.col(name).try_cast("double")
    return F.when(number == F.floor(number), number.try_cast("bigint"))
