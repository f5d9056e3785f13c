"""One archive, one row or one document id that holds most of a table."""

from collections import Counter

from pyspark.sql import functions as F

from shelfcast.llm import fixity, simhash, suffix_dedup


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]


def test_offsets_of_one_large_archive(spark):
    rows = [(i % 700, f"u{i % 700}", "x" * (i % 13)) for i in range(3000)] + [(None, None, None)] * 1500 + [(9, "same", "row")] * 1500
    pages = spark.createDataFrame(rows, "id long, archive string, digest string").repartition(5)
    archive = F.when(F.col("id") == 9, 1).when(F.col("id").isNull(), None).otherwise(0)
    records = fixity.archive_records(pages, F.col("id"), F.col("archive"), F.col("digest"), archive).collect()
    assert len(records) == 6000
    by_archive = {}
    for r in records:
        by_archive.setdefault(r.archive, []).append(r)
    assert {k: len(v) for k, v in by_archive.items()} == {None: 1500, 1: 1505, 0: 2995}
    for own in by_archive.values():
        at, last = 0, None
        for r in sorted(own, key=lambda r: r.offset):
            assert r.offset == at
            key = (r.record_id is not None, r.record_id or 0, r.digest)
            assert last is None or last <= key  # by id, then digest
            at, last = at + r.length, key


def test_very_long_payloads(spark):
    pages = spark.createDataFrame([(1, "u", "é" * 3_000_000), (2, "u", "b"), (3, "u", "c" * 5_000_000)], "id long, url string, html string")
    left = fixity.archive_records(pages, F.col("id"), F.col("url"), F.col("html"), F.lit(0))
    changed = F.when(F.col("id") == 3, F.concat("html", F.lit("!"))).otherwise(F.col("html"))
    right = fixity.archive_records(pages, F.col("id"), F.col("url"), changed, F.lit(0))
    found = fixity.audit(left, right).collect()
    assert [(r.record_id, r.status) for r in found] == [(3, "changed")]


def test_copies_are_dropped_before_texts_move(spark, make_docs):
    hot = "one row that a third of the table repeats over and over again"
    docs = make_docs([(1, hot)] * 400 + [(i, f"text number {i} with words of its own {i * 7} {i * 13}") for i in range(2, 500)]).repartition(6)
    kept = simhash.one_of_each(docs)
    rows = kept.collect()
    assert Counter(r.doc_id for r in rows)[1] == 1 and len({r.doc_id for r in rows}) == len(rows)
    # the choice of one among copies runs in each task before the exchange, and nothing is joined in front of it
    plan = plan_of(kept)
    exchange = plan.index("Exchange hashpartitioning(_own_id")
    below = plan[exchange:]
    assert "SortAggregate" in below[: below.index("Scan ")] or "ObjectHashAggregate" in below[: below.index("Scan ")]


def test_rows_cut_by_several_tasks_count_once():
    """A hot row may be dealt to several tasks; a stretch that each of them cuts is no repeat of itself."""
    import pyarrow as pa

    row = {"gram": 1, "stretch": 5, "lead": 0, "spread": 20, "n": 1, "kinds": 2, "bytes": bytes(range(80))}
    other = row | {"stretch": 6, "bytes": bytes(range(100, 180))}
    batches = [pa.RecordBatch.from_pylist([row, row]), pa.RecordBatch.from_pylist([row, other])]
    found = [r for b in suffix_dedup._sort_blocks(60, 10_000)(iter(batches)) for r in b.to_pylist()]
    assert found == []
    alike = other | {"bytes": bytes(range(10, 90))}
    found = [r for b in suffix_dedup._sort_blocks(60, 10_000)(iter([pa.RecordBatch.from_pylist([row, row, alike])])) for r in b.to_pylist()]
    assert [(r["stretch"], r["begins"]) for r in found] == [(5, [{"first": 10, "last": 20}]), (6, [{"first": 0, "last": 10}])]
