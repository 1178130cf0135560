"""Source and sink helpers on tiny files written below the checkpoint folder."""

from __future__ import annotations

from tessera.session import local_path, scratch_path
from tessera.sources import io as IO


def test_table_schemas_cover_the_eleven_tables():
    s = IO.table_schemas()
    assert list(IO.SYNTHEA_LOAD_ORDER) == list(s)
    assert len(s) == 11 and len(IO.SYNTHEA_FOREIGN_KEYS) == 18
    assert s["patients"]["birthdate"].dataType.simpleString() == "date"
    assert s["encounters"]["total_claim_cost"].dataType.simpleString() == "double"
    for (child, col), (parent, pcol) in IO.SYNTHEA_FOREIGN_KEYS.items():
        assert col in s[child].names and pcol in s[parent].names


def _write(spark, name, text):
    import os

    path = scratch_path(spark, name)
    os.makedirs(local_path(path))
    with open(os.path.join(local_path(path), "f.csv"), "w", encoding="utf-8") as fh:
        fh.write(text)
    return path


def test_tolerant_scan_skips_only_lines_with_too_many_fields(spark):
    path = _write(spark, "bom", "\ufeffID,Score,Note\n1,0.5,a\nnot-a-number,0.7,b\n2,0.8,c,extra\n3\n4,0.9,\"x, \"\"y\"\"\"\n")
    df = IO.scan_csv_tolerant(spark, path, "id int, score double, note string")
    want = [(1, 0.5, "a"), (None, 0.7, "b"), (3, None, None), (4, 0.9, 'x, "y"')]
    assert sorted(map(tuple, df.collect()), key=str) == sorted(want, key=str)
    assert df.select("id").count() == 4 and df.select("note").where("note = 'b'").count() == 1
    raw = IO.scan_csv(spark, path)
    assert raw.columns == ["id", "score", "note"]
    assert IO.scan_csv_tolerant(spark, path).columns == ["id", "score", "note"]


def test_quoted_fields_and_header_check(spark):
    import pytest

    path = _write(spark, "quoted", 'ID,Note\n1,"line one\nline ""two"", end"\n2,plain\n')
    rows = IO.scan_csv(spark, path, "id int, note string").collect()
    assert sorted(map(tuple, rows)) == [(1, 'line one\nline "two", end'), (2, "plain")]
    with pytest.raises(Exception, match="(?i)header"):
        IO.scan_csv(spark, path, "note string, id int").collect()


def test_run_summary_counts_rows_without_label(spark):
    df = spark.createDataFrame([(1,), (None,), (1,)], "y int")
    assert IO.run_summary(df, "y").first().asDict() == {"n_rows": 3, "class_counts": {"1": 2, "null": 1}}


def test_skip_if_done_rebuilds_partial_output(spark):
    path = scratch_path(spark, "partial")
    spark.range(3).write.parquet(path)
    import os

    os.remove(os.path.join(local_path(path), "_SUCCESS"))
    out = IO.skip_if_done(spark, path, lambda: spark.range(5))
    assert out.count() == 5
