"""Pairs counted by numbers of files are those counted by their paths; shuffles are dealt
out finely, whatever few partitions a session names."""

from sextant.operators import history as H
from sextant.plans.catalog import QUERIES
from sextant.session import TASK_CONF, unbound_tasks

COMMITS = [["b", "a", "c"], ["a", "b"], ["c", "a", "a"], ["z"], ["b", "c", "a"]]
NUMBERS = {"a": 9, "b": 2, "c": 5, "z": 1}  # in another order than the paths


def test_pairs_by_number_are_pairs_by_path(spark):
    rows = [(at, path, NUMBERS[path]) for at, paths in enumerate(COMMITS) for path in paths]
    touches = spark.createDataFrame(rows, "commit_id long, path string, path_id long")
    counts = touches.groupBy("path", "path_id").count().withColumnRenamed("count", "commits")

    def found(key):
        pairs = H.co_change_pairs(touches, key=key)
        return sorted(tuple(r) for r in H.couplings(pairs, counts, 2, key).collect())

    assert found("path_id") == found("path")
    assert [row[:3] for row in found("path_id")] == [("a", "b", 3), ("a", "c", 4), ("b", "c", 2)]


def test_numbers_are_one_for_each_path(spark, tmp_path):
    from sextant.sources.bindings import Tables

    part = [(1, "x", "t"), (1, "x", "t"), (1, "y", "t"), (None, None, "t"), (2, "x", "t")]
    spark.createDataFrame(part, "p_partkey int, p_brand string, p_type string").write.parquet(
        str(tmp_path / "part.parquet")
    )
    keys = Tables(spark, str(tmp_path)).numbered_keys()
    assert keys.count() == len(part)
    assert keys.select("path").distinct().count() == keys.select("path_id").distinct().count() == 4


def test_tasks_are_bounded_for_the_analytics_only(spark, tmp_path):
    initial = "spark.sql.adaptive.coalescePartitions.initialPartitionNum"
    spark.createDataFrame([(1, 2)], "l_partkey int, l_suppkey int").write.parquet(
        str(tmp_path / "lineitem.parquet")
    )
    spark.createDataFrame(
        [(1, "x", "t"), (2, "x", "t")], "p_partkey int, p_brand string, p_type string"
    ).write.parquet(str(tmp_path / "part.parquet"))
    assert QUERIES["edges"](spark, str(tmp_path)).collect() == [("x/t/part_1", "x/t/part_2")]
    assert int(spark.conf.get(initial)) >= int(TASK_CONF[initial])
    unbound_tasks(spark)
    assert spark.conf.get(initial, None) is None


def test_history_by_number_is_history_by_path(spark):
    """Files go by their numbers until few of their rows are left."""
    rows = [
        (at, path, NUMBERS[path], f"author_{at % 2}", 100 + at, at > 1, at == 3, at % 2 == 0, False)
        for at, paths in enumerate(COMMITS)
        for path in paths
    ]
    touches = spark.createDataFrame(
        rows,
        "commit_id long, path string, path_id long, author string, date_rank long, recent boolean, "
        "bot boolean, bugfix boolean, revert boolean",
    )
    paths = spark.createDataFrame([(n, p) for p, n in NUMBERS.items()], "path_id long, path string")
    by_path = H.file_history(touches.drop("path_id"), min_co_changes=2)
    by_number = H.file_history(touches.drop("path"), min_co_changes=2, paths=paths)
    assert by_number.columns == by_path.columns
    assert sorted(map(str, by_number.collect())) == sorted(map(str, by_path.collect()))
    assert by_number.count() == len(NUMBERS)


def test_partitions_follow_the_tables(spark, tmp_path, monkeypatch):
    """A shuffle gets more partitions the larger the tables are."""
    from sextant import session

    spark.range(10).write.parquet(str(tmp_path / "lineitem.parquet"))
    initial = "spark.sql.adaptive.coalescePartitions.initialPartitionNum"
    monkeypatch.setattr(session, "PARTITION_BYTES", 1)
    session.bound_tasks(spark, str(tmp_path))
    try:
        assert int(spark.conf.get(initial)) == session.folder_bytes(spark, str(tmp_path)) > 200
    finally:
        unbound_tasks(spark)
