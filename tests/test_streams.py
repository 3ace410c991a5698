"""Streams over one file, over a folder of part files, and over several batches with copies out of order."""

from pyspark.sql import functions as F

from billquarry.plans import load_all
from billquarry.plans.registry import QUERIES
from billquarry.streaming import jobs


def batches(spark, folder, name, parts):
    """A table as a folder of files, one batch each."""
    for n, rows in enumerate(parts):
        rows.coalesce(1).write.mode("append").parquet(f"{folder}/{name}.parquet")
    return jobs.parquet_stream(spark, str(folder), name, files_per_batch=1)


def test_streams_read_folders(spark, data, tmp_path):
    load_all()
    for name in ("documents", "orders", "events"):
        spark.read.parquet(f"{data}/{name}.parquet").repartition(3).write.parquet(f"{tmp_path}/{name}.parquet")
    for name in ("st_ingest_docs", "st_dedup_content", "st_monthly_amounts", "st_current_state"):
        one, many = QUERIES[name](spark, data), QUERIES[name](spark, str(tmp_path))
        assert one.exceptAll(many).count() == many.exceptAll(one).count() == 0 and one.count() > 0


ROWS = ["id", "'text ' || id % 50 AS content", "make_date(2024, CAST(1 + id % 3 AS INT), 1) AS day", "id * 10 AS cents", "id % 7 AS user", "(id * 37) % 90 AS ts"]


def test_jobs_go_on_and_read_only_what_is_new(spark, tmp_path):
    """Three batches, then two more in a second run; copies, months and keys come back out of order."""
    rows = spark.range(90).selectExpr(*ROWS)
    more = spark.range(90, 130).selectExpr(*ROWS).withColumn("content", F.concat(F.col("content"), F.when(F.col("id") > 100, "!").otherwise("")))
    parts = [rows.where(f"id % 3 = {n}") for n in (2, 0, 1)], [more.where(f"id % 2 = {n}") for n in (1, 0)]
    seen = None
    for number, arriving in enumerate(parts):
        stream = batches(spark, tmp_path, "rows", arriving)
        seen = rows if seen is None else seen.unionByName(more)
        new = seen.count() if number == 0 else more.count()
        found = jobs.new_contents(stream.select("content"), job="test-contents")
        assert found.rows_read == new
        want = {r.content for r in seen.select("content").distinct().collect()}
        assert found.rows().count() == found.rows().select("digest").distinct().count() == len(want)
        monthly = jobs.monthly_amounts(stream, "day", job="test-monthly")
        totals = seen.groupBy(F.date_format("day", "yyyy-MM").alias("month")).agg(F.sum("cents").alias("cents"), F.count("*").alias("count"))
        assert monthly.rows_read == new and monthly.latest(["month"]).exceptAll(totals).count() == 0 and monthly.latest(["month"]).count() == 3
        state = jobs.current_state(stream, "user", ["ts", "id"], ["id"], "test-state")
        assert state.rows_read == new
        assert {(r.user, r.id) for r in state.latest(["user"]).collect()} == {(r.user, r.id) for r in seen.groupBy("user").agg(F.max_by("id", F.struct("ts", "id")).alias("id")).collect()}
    assert jobs.new_contents(batches(spark, tmp_path, "rows", []).select("content"), job="test-contents").rows_read == 0


def test_new_contents_open_no_bucket(spark, tmp_path):
    first = [spark.range(n * 200, (n + 1) * 200).selectExpr("'c' || id AS content") for n in range(3)]
    found = jobs.new_contents(batches(spark, tmp_path, "rows", first), job="test-buckets")
    assert found.opened == [0, 0, 0] and found.rows().count() == 600
    again = jobs.new_contents(batches(spark, tmp_path, "rows", [spark.range(5).selectExpr("'c' || id AS content")]), job="test-buckets")
    assert 1 <= sum(again.opened) <= 5 and again.rows().count() == 600


def test_no_batch_gives_no_rows(spark, tmp_path):
    spark.range(0).selectExpr("'x' AS content").write.parquet(f"{tmp_path}/rows.parquet")
    assert jobs.new_contents(jobs.parquet_stream(spark, str(tmp_path), "rows")).rows().count() == 0


def test_files_become_texts(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.pdf").write_text("première page")
    (tmp_path / "in" / "b.exe").write_text("no")
    got = jobs.run_to_end(jobs.ingest_texts(jobs.file_stream(spark, str(tmp_path / "in")))).rows()
    assert [r.text for r in got.collect()] == ["première page"]
