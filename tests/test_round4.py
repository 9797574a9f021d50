"""Work per row that must not be done twice, and disk that must not hold the same rows twice."""

import time
from decimal import Decimal

import pyarrow.parquet as pq
from pyspark.sql import functions as F
from test_evaluate import KEYS, RECEIPT, TABLE, label, rows

from docutally.operators import build, dataset, evaluate, evidence
from docutally.operators.clients import constant_client
from docutally.operators.extract import Model
from docutally.operators.validate import check_answers
from docutally.schemas import INVOICE
from docutally.session import CLEANED
from docutally.sources import jsonl, requestlog
from docutally.streaming import stream


def optimized(frame):
    return frame._jdf.queryExecution().optimizedPlan().toString()


def shuffle_files(spark):
    files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    return {name for i in range(files.size()) if (name := files.apply(i).getName()).startswith("shuffle_")}


def no_more_than(spark, before, seconds=20):
    """Whether the shuffle files are those of ``before``, within some seconds."""
    until = time.monotonic() + seconds
    while (more := shuffle_files(spark) - before) and time.monotonic() < until:
        time.sleep(0.2)
    return not more


def test_a_text_is_read_once_and_only_for_a_prediction(spark):
    frame = rows(spark, ("1 Latte 9.00", RECEIPT, TABLE), ("1 Latte 9.00", RECEIPT, None)).coalesce(1)
    flags = evaluate.with_flags(frame).select(*KEYS, "hallucinated", "hallucinated_amounts")
    # The start of the pattern stands once for every time that a text is read.
    assert optimized(flags).count(evidence.PATTERN[:40]) == 1
    text = optimized(flags).split(evidence.PATTERN[:40])[0].rsplit("CASE WHEN", 2)
    assert any("isnotnull(prediction" in part for part in text)
    assert [tuple(r)[2:] for r in flags.orderBy("doc_id").collect()] == [(2, 2), (0, 0)]


def test_stated_values_of_odd_texts(spark):
    texts = [None, "", "no number", "\x01 5.00 \x02 5.00", "$1,250.00 and 3 EUR\nTotal: 7", "9" * 20 + ".00"]
    frame = spark.createDataFrame(list(enumerate(texts)), "id int, raw_text string")
    got = [r[0] for r in frame.orderBy("id").select(evidence.stated("amount")).collect()]
    assert got == [None, [], [], [Decimal(5)], [Decimal(1250), Decimal(3), Decimal(7)], [None]]
    codes = frame.orderBy("id").select(evidence.stated("code"), evidence.stated("quantity")).collect()
    assert [tuple(r) for r in codes][:3] == [(None, None), ([], []), ([], [])]


def test_items_are_counted_once_per_level(spark):
    agreed = evaluate.with_item_agreement(rows(spark, ("", TABLE, RECEIPT), ("", TABLE, label(items=[("paper", 3.0, "2", "1.00")])))).select(*KEYS, "agreed")
    # One count by description and one for each of the three values.
    assert optimized(agreed).count("aggregate(") == 4
    got = [tuple(r["agreed"]) for r in agreed.orderBy("doc_id").collect()]
    assert got == [(0, 2, 2, 0, 0, 0), (1, 1, 0, 1, 1, 0)]


def test_lines_are_moved_before_their_items_are_made(spark):
    lines = spark.createDataFrame([(1, 2, "b", 2.0, True), (1, 1, "a", 1.5, True), (1, 3, "c", None, False), (2, 1, "d", 4.0, False)], "doc_id int, line_no int, description string, total double, known boolean")
    item = F.struct("description", F.col("total").cast("string").alias("total"))
    lists = dataset.assemble_items(lines, ["line_no"], item, listed=F.when(F.col("known"), True), total="total")
    moved = optimized(lists)
    assert "named_struct" not in moved[moved.index("RepartitionByExpression") :]
    got = {r["doc_id"]: ([tuple(i) for i in r["line_items"]], r["n_items"]) for r in lists.collect()}
    assert got == {1: ([("a", "1.5"), ("b", "2.0")], 3), 2: ([], 1)}


def test_a_sink_leaves_no_shuffle_files(spark, tmp_path):
    before = shuffle_files(spark)
    pairs = rows(spark, ("text", TABLE, RECEIPT), ("other", RECEIPT, TABLE)).select("raw_text", "invoice").repartition(3, "raw_text")
    jsonl.write_pairs(pairs, str(tmp_path / "pairs"))
    jsonl.write_pairs(pairs, str(tmp_path / "pairs"), append=True)
    assert no_more_than(spark, before) and spark.conf.get(CLEANED, None) is None
    assert jsonl.read_pairs(spark, str(tmp_path / "pairs")).count() == 4


def test_a_run_is_made_in_slices_and_leaves_only_itself(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(build, "SLICE_BYTES", 1)
    path, other, seen = str(tmp_path / "set"), str(tmp_path / "whole"), []
    texts = [(i, f"text {i % 30}", i % 11 == 0, i % 5 > 0, TABLE) for i in range(90)]
    frame = spark.createDataFrame(texts, f"attempt_id long, raw_text string, failed boolean, passed boolean, invoice {INVOICE.simpleString()}").repartition(4, "attempt_id")
    plain = build.with_status

    def watched(*args):
        seen.append((len(build.Folder(spark, f"{path}/_attempts").names(".parquet")), build.complete_runs(spark, path)))
        return plain(*args)

    def run(to):
        return {r["status"]: r["n"] for r in build.build(frame, to, F.col("failed"), F.col("passed")).collect()}

    with monkeypatch.context() as patch:
        patch.setattr(build, "with_status", watched)
        got = run(path)
    # Every slice takes its files with it, and the run counts after the last one only.
    assert len(seen) > 1 and seen == [(len(seen) - i, []) for i in range(len(seen))]
    monkeypatch.setattr(build, "SLICE_BYTES", 10**9)
    assert got == run(other) and sum(got.values()) == 90
    assert sorted(build.Folder(spark, path).names()) == ["runs", "test", "train"] and build.complete_runs(spark, path) == [0]
    files = build.Folder(spark, f"{path}/runs/run=0").names(".parquet")
    assert files and all(".zstd." in name for name in files)


def test_examples_are_written_without_dictionaries(spark, tmp_path):
    frame = rows(spark, ("text", TABLE, TABLE), ("other", RECEIPT, RECEIPT), ("none", RECEIPT, None)).repartition(2, "doc_id")
    before = shuffle_files(spark)
    evaluate.write_run(frame, KEYS, str(tmp_path), {"run_id": "1"})
    files = list(tmp_path.glob("examples/run_id=1/*.parquet"))
    columns = [pq.ParquetFile(f).metadata.row_group(0).column(i) for f in files for i in range(pq.ParquetFile(f).metadata.num_columns)]
    assert columns and {c.compression for c in columns} == {"ZSTD"} and not any(c.has_dictionary_page for c in columns)
    assert no_more_than(spark, before)
    assert spark.read.parquet(f"{tmp_path}/examples").count() == 3 and spark.read.parquet(f"{tmp_path}/metrics").count() == len(evaluate.METRICS)


def test_records_of_a_stream_need_no_search_for_the_first(spark, tmp_path, monkeypatch):
    texts = [("1", "x"), ("2", "y"), ("2", "y"), ("3", " ")]
    inbox, log = str(tmp_path / "in"), str(tmp_path / "log")
    frame = spark.createDataFrame(texts, "job_id string, raw_text string")
    frame.write.parquet(inbox)

    def never(outcomes):
        raise AssertionError("searched")

    monkeypatch.setattr(requestlog, "first_per_job", never)
    for state in ("one", "two"):
        source = spark.readStream.schema(frame.schema).parquet(inbox)
        stream.stream_extract(source, [Model("m", constant_client("no answer"))], log, str(tmp_path / state))
        assert sorted(r["job_id"] for r in stream.read_batches(spark, log).collect()) == ["1", "2"]


def test_only_odd_lists_are_taken_apart(spark):
    checked = check_answers(spark.createDataFrame([('{"vendor_name": "V"}',)], "raw_output string"))
    # The items as variants are asked for behind the verdict on the whole list, not for every answer.
    text = optimized(checked)
    assert text.count("try_variant_get(_line_items") == 1 and "AS _list#" not in text
