"""Request log, its statistics, and the streaming sinks."""

import datetime as dt
import tempfile
from decimal import Decimal

from docutally.operators import requestlog
from docutally.operators.clients import layout_reader
from docutally.operators.extract import Model
from docutally.schemas import REQUEST_LOG
from docutally.sources.requestlog import append_outcomes, open_request_log
from docutally.streaming import stream

DAY = dt.datetime(2024, 1, 1)


def record(job, minute=0, model="m", success=True, latency=1.0, invoice='{"vendor_name":"V","total_amount":"1234.5","currency":"USD"}'):
    error = None if success else "Invalid JSON: x"
    at = DAY + dt.timedelta(minutes=minute)
    return (job, model, success, invoice if success else None, error, latency, Decimal("0.001000"), at)


def log(spark, *rows):
    return spark.createDataFrame(list(rows), REQUEST_LOG)


def test_statistics_of_an_empty_log(spark):
    path = tempfile.mkdtemp() + "/log"
    row = requestlog.stats(open_request_log(spark, path)).first()
    assert tuple(row) == (0, 0, 0.0, None, 0.0)


def test_zero_latency_reads_as_none(spark):
    row = requestlog.stats(log(spark, record("a", latency=0.0))).first()
    assert row["average_latency_seconds"] is None and row["success_rate"] == 1.0


def test_first_record_of_a_job_wins(spark):
    path = tempfile.mkdtemp() + "/log"
    append_outcomes(log(spark, record("a", 1, "first"), record("a", 2, "second"), record("b", 3)), path)
    append_outcomes(log(spark, record("a", 0, "third"), record("c", 4)), path)
    rows = {r["job_id"]: r["model_name"] for r in open_request_log(spark, path).collect()}
    assert rows == {"a": "first", "b": "m", "c": "m"}
    assert open_request_log(spark, path).count() == 3


def test_recent_list_and_reports(spark):
    rows = log(spark, record("a", 1), record("b", 2, success=False), record("c", 3, invoice='{"vendor_name":" ","total_amount":"n/a"}'))
    recent = requestlog.recent(rows, 2).collect()
    assert [r["job_id"] for r in recent] == ["c", "b"]
    assert recent[1]["vendor_name"] is None and recent[1]["error"] is not None
    report = {r["job_id"]: r for r in requestlog.recent_report(rows).collect()}
    assert report["a"]["total"] == "USD 1,234.50" and report["a"]["cost"] == "$0.001000" and report["a"]["latency"] == "1.00s"
    assert report["b"]["total"] == "Not detected" and report["b"]["status"] == "failed"
    assert report["c"]["vendor"] == "Not detected" and report["c"]["total"] == "n/a"


def test_latency_trend_numbers_after_dropping(spark):
    rows = log(spark, record("a", 1), record("b", 2, latency=None), record("c", 3, latency=3.0))
    trend = requestlog.latency_trend(rows).collect()
    assert [(r["job"], r["latency_seconds"]) for r in trend] == [("Job 1", 1.0), ("Job 2", 3.0)]


def test_replayed_batch_writes_the_same_records(spark):
    path = tempfile.mkdtemp() + "/log"
    first = log(spark, record("a", 1), record("b", 2))
    second = log(spark, record("b", 3, "late"), record("c", 4))
    for batch_id, batch in [(0, first), (1, second), (1, second), (0, first)]:
        stream.record_batch(batch, path, "s", batch_id)
    rows = sorted((r["job_id"], r["model_name"], r["batch_id"]) for r in stream.read_batches(spark, path).collect())
    assert rows == [("a", "m", 0), ("b", "m", 0), ("c", "m", 1)]


def test_new_checkpoint_keeps_earlier_records(spark):
    path, inbox = tempfile.mkdtemp() + "/log", [tempfile.mkdtemp() + "/in" for _ in range(2)]
    log(spark, record("a", 1), record("b", 2)).write.parquet(inbox[0])
    log(spark, record("b", 3, "late"), record("c", 4)).write.parquet(inbox[1])
    for folder in inbox:
        source = spark.readStream.schema(REQUEST_LOG).parquet(folder)
        stream.stream_records(source, path, tempfile.mkdtemp())
    rows = sorted((r["job_id"], r["model_name"]) for r in stream.read_batches(spark, path).collect())
    assert rows == [("a", "m"), ("b", "m"), ("c", "m")]


def test_known_jobs_are_not_sent_to_a_model(spark):
    path, inbox = tempfile.mkdtemp() + "/log", tempfile.mkdtemp() + "/in"
    rows = spark.createDataFrame([("1", "x"), ("2", "y")], "job_id string, raw_text string")
    rows.write.parquet(inbox)

    def once():
        return lambda prompt: "no answer"

    def never():
        def call(prompt):
            raise AssertionError("called")
        return call

    for make in (once, never):
        source = spark.readStream.schema(rows.schema).parquet(inbox)
        stream.stream_extract(source, [Model("m", make)], path, tempfile.mkdtemp())
    found = stream.read_batches(spark, path).collect()
    assert sorted(r["job_id"] for r in found) == ["1", "2"] and not any("called" in r["error"] for r in found)


def test_retried_jobs_count_once(spark):
    inbox, path, state = tempfile.mkdtemp() + "/in", tempfile.mkdtemp() + "/stats", tempfile.mkdtemp()
    for rows in ([record("a", 1), record("b", 2)], [record("a", 5), record("c", 6)]):
        log(spark, *rows).write.mode("append").parquet(inbox)
        stream.stream_stats(spark.readStream.schema(REQUEST_LOG).parquet(inbox), path, state)
    assert [r["requests"] if "requests" in r else r[1] for r in stream.read_stats(spark, path).collect()] == [3]


def test_stream_skips_blank_documents(spark):
    inbox, path = tempfile.mkdtemp() + "/inbox", tempfile.mkdtemp() + "/log"
    text = "INVOICE\nVendor: V\n- d | 1.00\nTotal Due: 1.00 USD"
    rows = spark.createDataFrame([("1", text), ("2", " \n"), ("3", "other")], "job_id string, raw_text string")
    rows.write.parquet(inbox)
    source = spark.readStream.schema(rows.schema).parquet(inbox)
    stream.stream_extract(source, [Model("reader", layout_reader())], path, tempfile.mkdtemp())
    found = {r["job_id"]: r for r in stream.read_batches(spark, path).collect()}
    assert set(found) == {"1", "3"}
    assert found["1"]["success"] and not found["3"]["success"] and "UnknownLayout" in found["3"]["error"]
