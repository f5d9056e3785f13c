import datetime as dt

import pytest

from shelfcast.operators.selection import filter_series, preview, required_columns
from shelfcast.sources.items import items_from_text, read_items
from shelfcast.sources.sales import (
    coerce_sales,
    coercion_report,
    extra_columns,
    read_and_validate_sales,
    read_sales,
    resolve_columns,
    validate_sales,
)
from shelfcast.sources.sinks import write_csv, write_parquet


def csv_file(folder, text, name="sales.csv"):
    path = folder / name
    path.write_text(text) if isinstance(text, str) else path.write_bytes(text)
    return str(path)


def test_canonical_headers_need_no_renames(spark, tmp_path):
    path = csv_file(tmp_path, "date,store,item,sales\n2023-01-01,1,2,5\n")
    df, warnings = read_and_validate_sales(spark, path)
    assert warnings == []
    assert [f.dataType.simpleString() for f in df.schema] == ["date", "bigint", "bigint", "double"]
    assert df.collect() == [(dt.date(2023, 1, 1), 1, 2, 5.0)]


def test_alias_headers_are_renamed_with_one_warning_each(spark, tmp_path):
    path = csv_file(tmp_path, "Date,Store,item_id,qty,note\n2023-01-01,1,2,5,x\n")
    df, warnings = read_and_validate_sales(spark, path)
    assert df.columns == ["date", "store", "item", "sales", "note"]
    assert len(warnings) == 4 and "Mapped `qty` → `sales`" in warnings
    assert extra_columns(df) == ["note"]
    assert required_columns(df).columns == ["date", "store", "item", "sales"]


def test_only_wrong_headers_are_renamed():
    assert resolve_columns(["date", "store", "item_id", "qty"]) == {"item_id": "item", "qty": "sales"}
    assert resolve_columns(["DATETIME", "SHOP", "sKu", "UNITS"]) == {
        "DATETIME": "date",
        "SHOP": "store",
        "sKu": "item",
        "UNITS": "sales",
    }


def test_unknown_headers_are_rejected(spark, tmp_path):
    path = csv_file(tmp_path, "col_a,col_b,col_c,col_d\n1,2,3,4\n")
    with pytest.raises(ValueError, match="no column stands for"):
        read_and_validate_sales(spark, path)


@pytest.mark.parametrize("content", ["date,store,item,sales\n", "", b"\x89PNG\r\n\x1a\n\x00\x00\x00\rIHDR"])
def test_empty_and_binary_files_are_rejected(spark, tmp_path, content):
    with pytest.raises(ValueError):
        read_and_validate_sales(spark, csv_file(tmp_path, content))


def test_missing_file_is_a_parse_error(spark, tmp_path):
    with pytest.raises(ValueError, match="cannot be read"):
        read_and_validate_sales(spark, str(tmp_path / "absent.csv"))


def test_values_that_do_not_convert_become_null_and_are_counted(spark):
    raw = spark.createDataFrame(
        [("2023-01-01", "7", "42", "99.5"), ("not-a-date", "7.0", "x", "n/a"), ("2023-02-30", "1.5", "3", "NaN")],
        "date string, store string, item string, sales string",
    )
    rows = coerce_sales(raw).collect()
    assert rows[0] == (dt.date(2023, 1, 1), 7, 42, 99.5)
    assert rows[1] == (None, 7, None, None)
    assert rows[2] == (None, None, 3, None)
    assert coercion_report(raw).first().asDict() == {
        "n_rows": 3,
        "date_rejected": 2,
        "store_rejected": 1,
        "item_rejected": 1,
        "sales_rejected": 2,
    }
    assert raw.schema["sales"].dataType.simpleString() == "string"


def test_mixed_date_styles(spark):
    texts = ["2020-01-15", "15/01/2020", "01/15/2020", "15-Jan-2020", "January 15, 2020", "20200115", "2020-01-15 13:45:00"]
    raw = spark.createDataFrame([(t, "1", "1", "1") for t in texts], "date string, store string, item string, sales string")
    assert {r.date for r in coerce_sales(raw).collect()} == {dt.date(2020, 1, 15)}
    ambiguous = raw.limit(0).union(spark.createDataFrame([("03/04/2020", "1", "1", "1")], raw.schema))
    assert coerce_sales(ambiguous).first().date == dt.date(2020, 4, 3)
    assert coerce_sales(ambiguous, ["MM/dd/yyyy"]).first().date == dt.date(2020, 3, 4)


def test_csv_and_parquet_round_trip(spark, tmp_path, make_series):
    df = make_series({1: [1, 2, 3], 2: [4]})
    write_csv(df, str(tmp_path / "csv"))
    write_parquet(df, str(tmp_path / "parquet"), partition_by=["store"])
    assert sorted(read_sales(spark, str(tmp_path / "csv")).select(df.columns).collect()) == sorted(df.collect())
    assert sorted(read_sales(spark, str(tmp_path / "parquet"), "parquet").select(df.columns).collect()) == sorted(df.collect())
    header = next((tmp_path / "csv").glob("part-*.csv")).read_text(encoding="utf-8").splitlines()[0]
    assert header == "date,store,item,sales"


def test_item_tables(spark, tmp_path):
    text = "item_id,unit_cost,annual_demand\nSKU001,12.50,1200\nSKU002,3.00,8000\n"
    expected = [("SKU001", 12.5, 1200.0), ("SKU002", 3.0, 8000.0)]
    assert sorted(items_from_text(spark, text).collect()) == expected
    assert sorted(read_items(spark, csv_file(tmp_path, text)).collect()) == expected
    with pytest.raises(ValueError, match="unit_cost"):
        items_from_text(spark, "item_id,cost\nA,1\n")
    with pytest.raises(ValueError):
        items_from_text(spark, "item_id,unit_cost,annual_demand\n")


def test_series_selection_and_preview(make_series):
    df = make_series({1: [3, 2], 2: [1]}).unionByName(make_series({1: [9]}, store=2))
    assert filter_series(df, 1, 1).count() == 2
    assert [r.sales for r in preview(df, 3).collect()] == [3.0, 2.0, 1.0]


def test_valid_tables_of_any_size_pass(spark):
    for n in (1, 7, 30):
        raw = spark.createDataFrame([("2023-01-01", "1", "1", str(i)) for i in range(n)], "date string, store string, item string, qty string")
        df, warnings = validate_sales(raw)
        assert df.count() == n and len(warnings) == 1
