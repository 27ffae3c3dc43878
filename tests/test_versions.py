import pytest
from pyspark.sql import functions as F

from gradus.operators.joins import upsert
from gradus.sources import versions as T

DDL = "dataname string, id bigint, v string, ordinal bigint"


def table(spark, n=2_000):
    return spark.range(0, n, 1, 40).select(
        F.lit("d").alias("dataname"), "id", F.concat(F.lit("old "), "id").alias("v"), F.col("id").alias("ordinal")
    )


def rows(df):
    return sorted(tuple(r) for r in df.select("dataname", "id", "v", "ordinal").collect())


def test_ten_rows_rewrite_at_most_ten_files(spark, tmp_path):
    path = str(tmp_path / "t")
    T.create_table(table(spark), path)
    before = set(T.files_of(spark, path))
    repairs = spark.createDataFrame([("d", i * 7, f"new {i}", i) for i in range(10)], DDL)
    done = T.merge_table(spark, path, repairs)
    after = set(T.files_of(spark, path))
    assert done.version == 2 and done.rewritten <= 10 and done.kept == len(before) - done.rewritten
    assert len(before & after) == done.kept >= 30
    assert rows(T.read_table(spark, path)) == rows(upsert(table(spark), repairs))
    # Earlier versions stay readable until they are removed.
    assert rows(T.read_table(spark, path, 1)) == rows(table(spark))
    assert T.vacuum(spark, path) == done.rewritten
    assert rows(T.read_table(spark, path)) == rows(upsert(table(spark), repairs))
    with pytest.raises(ValueError, match="no version 1"):
        T.read_table(spark, path, 1)


@pytest.mark.parametrize("broadcast", [1_000_000, 0])
def test_copies_nulls_and_unmatched_records(spark, tmp_path, monkeypatch, broadcast):
    monkeypatch.setattr(T, "BROADCAST_PLACES", broadcast)
    path = str(tmp_path / "t")
    old = [("d", 1, "a", 0), ("d", 1, "b", 1), (None, 2, "c", 2), ("d", None, "d", 3), ("e", 1, None, 4)]
    target = spark.createDataFrame(old, DDL).repartition(5, "ordinal")
    T.create_table(target, path)
    new = [("d", 1, "x", 0), ("d", 1, "y", 1), (None, 2, "n", 2), ("d", None, "n", 3), ("z", 9, "n", 4), ("e", 1, None, 5)]
    repairs = spark.createDataFrame(new, DDL).withColumn("_name", F.lit("extra"))
    T.merge_table(spark, path, repairs)
    found = {r.ordinal: r.v for r in T.read_table(spark, path).collect()}
    assert found == {0: "y", 1: "b", 2: "c", 3: "d", 4: None}
    # Nothing matches: no version is made.  The same repair again changes nothing.
    assert T.merge_table(spark, path, repairs.where("id = 9")).version == 2
    assert T.merge_table(spark, path, repairs.limit(0)) == T.Merge(2, 0, len(T.files_of(spark, path)))
    T.merge_table(spark, path, repairs)
    assert {r.ordinal: r.v for r in T.read_table(spark, path).collect()} == found


def test_a_repair_that_dies_leaves_the_old_version(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "t")
    T.create_table(table(spark, 100), path)
    repairs = spark.createDataFrame([("d", 5, "new", 0)], DDL)
    with monkeypatch.context() as m:
        m.setattr(T, "move", lambda *a: (_ for _ in ()).throw(OSError("killed before the commit")))
        with pytest.raises(OSError):
            T.merge_table(spark, path, repairs)
    assert T.versions(spark, path) == [1] and rows(T.read_table(spark, path)) == rows(table(spark, 100))
    assert T.merge_table(spark, path, repairs).version == 2
    # What the dead attempt left is removed with the old version, and nothing else.
    def files():
        return {f"{f.parent.name}/{f.name}" for f in (tmp_path / "t" / "data").rglob("*.parquet")}

    needed, there = set(T.files_of(spark, path)), files()
    assert T.vacuum(spark, path) == len(there - needed) > 1 and files() == needed
    assert rows(T.read_table(spark, path)) == rows(upsert(table(spark, 100), repairs))


def test_empty_and_missing_tables(spark, tmp_path):
    empty = str(tmp_path / "empty")
    T.create_table(table(spark, 10).limit(0), empty)
    assert T.merge_table(spark, empty, table(spark, 10)).rewritten == 0
    assert T.read_table(spark, empty).count() == 0
    with pytest.raises(ValueError, match="already"):
        T.create_table(table(spark, 10), empty)
    with pytest.raises(ValueError, match="no version"):
        T.read_table(spark, str(tmp_path / "none"))
