"""The dataset job: statuses, history, splits, broken runs."""

import tempfile

import pytest
from pyspark.sql import functions as F

from docutally.operators import build
from docutally.schemas import INVOICE
from docutally.sources import jsonl

INVOICE_ROW = ("V", None, None, [], None, None, "1.00", "USD")


def attempts(spark, *rows):
    full = [(i, text, failed, passed, INVOICE_ROW) for i, (text, failed, passed) in enumerate(rows)]
    return spark.createDataFrame(full, f"attempt_id long, raw_text string, failed boolean, passed boolean, invoice {INVOICE.simpleString()}")


def run(frame, path, **options):
    counted = build.build(frame, path, F.col("failed"), F.col("passed"), **options)
    return {r["status"]: r["n"] for r in counted.collect()}


def kept(spark, path):
    train, test = (f"{path}/train", f"{path}/test")
    return sorted(r["raw_text"] for r in jsonl.read_pairs(spark, test).collect()), jsonl.read_train(spark, train).count()


def test_statuses_and_history(spark):
    path = tempfile.mkdtemp() + "/set"
    one = attempts(spark, ("a", False, True), ("a", False, True), ("b", False, False), ("c", True, True), ("d", False, True))
    assert run(one, path) == {"error": 1, "roundtrip": 1, "duplicate": 1, "kept": 2}
    two = attempts(spark, ("a", False, True), ("b", False, True), (" ", False, True), ("e", False, True))
    assert run(two, path) == {"error": 1, "roundtrip": 0, "duplicate": 1, "kept": 2}
    tested, trained = kept(spark, path)
    assert trained + len(tested) == 4
    assert build.complete_runs(spark, path) == [0, 1]


def test_without_round_trip_and_without_kept_rows(spark):
    path = tempfile.mkdtemp() + "/set"
    assert run(attempts(spark, ("b", False, False)), path) == {"error": 0, "roundtrip": 1, "duplicate": 0, "kept": 0}
    assert not build.Folder(spark, f"{path}/train").exists()
    assert run(attempts(spark, ("b", False, False)), path, check=False) == {"error": 0, "roundtrip": 0, "duplicate": 0, "kept": 1}


@pytest.mark.parametrize("step", ["text_digest", "write_splits"])
def test_a_broken_run_gives_the_same_files(spark, monkeypatch, step):
    rows = [(f"text {i % 7}", False, i % 5 > 0) for i in range(20)]
    first, second = attempts(spark, *rows[:10]), attempts(spark, *rows)
    whole, broken = tempfile.mkdtemp() + "/set", tempfile.mkdtemp() + "/set"
    run(first, whole), run(second, whole)
    run(first, broken)

    def fail(*_, **__):
        raise KeyError("broken off")

    with monkeypatch.context() as patch:
        patch.setattr(build, step, fail)
        with pytest.raises(KeyError):
            run(second, broken)
    again = run(second, broken)
    assert kept(spark, whole) == kept(spark, broken)
    if step == "text_digest":  # the run did not count yet
        assert again["kept"] > 0 and build.complete_runs(spark, broken) == [0, 1]
    else:  # it counted: its texts are history now
        assert again["kept"] == 0
