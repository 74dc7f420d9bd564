"""Numbers of rows that hold however the files are split."""

import pytest
from pyspark.sql import functions as F

from fragloom.llm import _shared, block_naming
from fragloom.llm._shared import stored, table, with_row_id, without_rows


@pytest.fixture
def docs(spark, tmp_path):
    path = f"{tmp_path}/a dir%20/docs.parquet"
    rows = spark.range(4000).select(F.col("id").alias("doc_id"), F.concat(F.lit("text "), (F.col("id") % 1500).cast("string"), F.repeat(F.lit(" x"), 200)).alias("text"), F.lit("own").alias("_rid"))
    rows.repartition(3).write.option("parquet.block.size", 4096).parquet(path)
    return spark.read.parquet(path)


def split(spark, size):
    spark.conf.set("spark.sql.files.maxPartitionBytes", size)
    spark.conf.set("spark.sql.files.openCostInBytes", "1k")


@pytest.fixture(autouse=True)
def reset(spark):
    yield
    for key in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes"):
        spark.conf.unset(key)


def test_numbers_do_not_follow_the_splits(spark, docs):
    seen = []
    for size in ("128m", "8k", "3k"):
        split(spark, size)
        rows = with_row_id(docs.select("doc_id", "text").where("doc_id % 2 = 0"), "n")
        parts = rows.rdd.getNumPartitions()
        got = {r["doc_id"]: r["n"] for r in rows.collect()}
        assert len(got) == len(set(got.values())) == 2000
        seen.append((parts, got))
    assert len({n for n, _ in seen}) > 1
    assert all(got == seen[0][1] for _, got in seen)


def test_rows_gone_are_those_meant_after_other_splits(spark, docs):
    split(spark, "128m")
    judged = block_naming.exact_duplicates(docs).where(~F.col("kept"))
    gone = {r["doc_id"] for r in judged.collect()}
    judged = table(judged, "judged")
    split(spark, "3k")
    left = without_rows(docs, judged)
    assert left.columns == docs.columns
    assert {r["doc_id"] for r in left.collect()} == set(range(4000)) - gone and len(gone) == 2500


def test_what_is_no_scan_is_written_first(spark, docs):
    for odd in (spark.range(5).withColumn("text", F.lit("a")), docs.crossJoin(spark.range(2)), docs.select("doc_id", F.explode(F.array(F.lit(1), F.lit(2)))), docs.where(F.rand(1) < 0.5), docs.union(docs)):
        with pytest.raises(ValueError):
            with_row_id(odd, "n")
        rows = with_row_id(stored(odd), "n")
        assert rows.select("n").distinct().count() == rows.count() > 0
    assert stored(docs) is docs


@pytest.mark.parametrize("limits", [(400_000, 16384), (10, 16384), (10, 0)])
def test_rows_go_whatever_their_number(spark, tmp_path, monkeypatch, limits):
    """By numbers, by bitmaps and by a join that shuffles."""
    monkeypatch.setattr(_shared, "BROADCAST_KEYS", limits[0])
    monkeypatch.setattr(_shared, "BITMAPS", limits[1])
    path = str(tmp_path / "rows")
    spark.range(120_000).selectExpr("id", "id % 7 AS _rid", "'x' AS _bits").repartition(2).write.parquet(path)
    docs = spark.read.parquet(path)
    gone = _shared.with_row_id(docs, "n").where("id % 3 = 0 or id between 40000 and 90000").select(F.col("n").alias("_rid"))
    left = _shared.without_rows(docs, gone)
    assert left.columns == docs.columns
    assert sorted(r["id"] for r in left.select("id").collect()) == [i for i in range(120_000) if not (i % 3 == 0 or 40_000 <= i <= 90_000)]
