"""Streaming jobs run to the end of the shared tables; results equal the batch ones. A second call goes on where the first ended."""

from __future__ import annotations

from pyspark.sql import functions as F

from billquarry.plans import bindings as B
from billquarry.plans.registry import SQL, query
from billquarry.plans import source_plans  # noqa: F401  (registers the batch check reused below)
from billquarry.streaming import jobs


@query("st_ingest_docs", SQL["src_upload_admission"])
def st_ingest_docs(spark, d):
    key = F.col("doc_id")
    suffix = F.when(key % 4 == 0, ".PDF").when(key % 4 == 1, ".png").when(key % 4 == 2, ".exe").otherwise("")
    arriving = jobs.parquet_stream(spark, d, "documents").select(
        "doc_id", F.concat(F.lit("in/"), F.col("source"), F.lit("_"), key.cast("string"), suffix).alias("path"), (F.col("n_chars") * 500).alias("size")
    )
    return jobs.run_to_end(jobs.ingest(arriving), jobs.job_of("ingest", d)).rows().drop("batch")


@query("st_dedup_content", "SELECT DISTINCT sha256(text) AS digest, CAST(octet_length(encode(text)) AS BIGINT) AS size FROM documents")
def st_dedup_content(spark, d):
    arriving = jobs.parquet_stream(spark, d, "documents").select(F.col("text").alias("content"))
    return jobs.new_contents(arriving, job=jobs.job_of("contents", d)).rows().select("digest", "size")


@query("st_monthly_amounts", """SELECT strftime(o_orderdate, '%Y-%m') AS month, CAST(sum(CAST(round(o_totalprice * 100) AS BIGINT)) AS BIGINT) AS cents, count(*) AS count FROM orders GROUP BY 1""")
def st_monthly_amounts(spark, d):
    arriving = jobs.parquet_stream(spark, d, "orders").select("o_orderdate", F.round(F.col("o_totalprice") * 100).cast("long").alias("cents"))
    return jobs.monthly_amounts(arriving, "o_orderdate", job=jobs.job_of("monthly", d)).latest(["month"])


@query("st_current_state", """SELECT user_id, arg_max(event_id, (ts, event_id)) AS event_id, arg_max(event_type, (ts, event_id)) AS event_type FROM events GROUP BY user_id""")
def st_current_state(spark, d):
    arriving = jobs.parquet_stream(spark, d, "events").select("user_id", "ts", "event_id", "event_type")
    state = jobs.current_state(arriving, "user_id", ["ts", "event_id"], ["event_id", "event_type"], jobs.job_of("state", d))
    return state.latest(["user_id"]).select("user_id", "event_id", "event_type")
