"""Rows named by file and place."""

from sextant.llm import common


def test_rows_of_files_keep_their_numbers(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "t")
    spark.range(1000).selectExpr("id", "'x' AS row", "'y' AS file").repartition(4).write.parquet(path)
    docs = spark.read.parquet(path)
    numbered, row = common.with_rows(docs)
    assert row == "_row" and set(numbered.columns) == {"id", "row", "file", "_row"}
    first = {r["id"]: r["_row"] for r in numbered.collect()}
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2000")
    again = {r["id"]: r["_row"] for r in common.with_rows(spark.read.parquet(path))[0].collect()}
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert first == again and len(set(first.values())) == 1000
    monkeypatch.setattr(common, "MOST_FILES", 2)
    for table in (docs, spark.range(10).withColumnRenamed("id", "ROW")):
        found, row = common.with_rows(table)
        assert row == "_row" and found.select("_row").distinct().count() == table.count()
    assert common.with_rows(docs.limit(0))[0].count() == 0
