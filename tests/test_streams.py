"""Streams over tables that are one file or a folder of files."""

import pytest

from fieldloom.workloads import QUERIES

ROWS = [(1, "the and her"), (2, "der und"), (3, "the and her"), (4, None), (5, "los el ")]


@pytest.mark.parametrize("name", ["stream_queue", "stream_dedup", "stream_classify"])
def test_a_table_in_a_folder_of_its_own(spark, tmp_path, name):
    docs = spark.createDataFrame(ROWS, "doc_id bigint, text string")
    docs.repartition(3, "doc_id").write.parquet(f"{tmp_path}/many/documents.parquet")
    docs.coalesce(1).write.parquet(f"{tmp_path}/staged")
    (tmp_path / "one").mkdir()
    next((tmp_path / "staged").glob("part-*")).rename(tmp_path / "one" / "documents.parquet")
    many, one = (QUERIES[name](spark, f"{tmp_path}/{part}") for part in ("many", "one"))
    assert one.count() > 0
    assert sorted(map(repr, many.collect())) == sorted(map(repr, one.collect()))
