"""Sinks, lookups, checks and matches that must not grow faster than their input."""

import json
from pathlib import Path

from test_evaluate import KEYS, RECEIPT, TABLE, label, rows

from docutally.functions import subwords
from docutally.operators import evaluate, evidence, extract
from docutally.operators.validate import check_answers
from docutally.sources import jsonl


def plan(frame):
    return frame._jdf.queryExecution().executedPlan().toString()


def test_json_files_are_compressed_and_read_back(spark, tmp_path):
    pairs = rows(spark, ("text", TABLE, RECEIPT)).select("raw_text", "invoice")
    jsonl.write_pairs(pairs, str(tmp_path / "pairs"))
    assert list(Path(tmp_path / "pairs").glob("part-*.json.gz")) and not list(Path(tmp_path / "pairs").glob("part-*.json"))
    assert jsonl.read_pairs(spark, str(tmp_path / "pairs")).collect() == pairs.collect()


def test_prices_do_not_move_the_calls(spark):
    calls = spark.range(1000).selectExpr("'invoice-small' AS model_used", "id AS input_tokens", "id AS output_tokens")
    assert "hashpartitioning(model_used" not in plan(extract.add_cost(calls))


def test_tokens_are_found_without_a_shuffle(spark):
    frame = spark.createDataFrame([(1, "a \x01 5.00 \x02 2024-01-05"), (2, "1.00 " * 500)], "doc_id int, raw_text string")
    found = evidence.spans(frame, ["doc_id"])
    assert "Exchange" not in plan(found)
    held = {r["doc_id"]: r["raw_text"] for r in frame.collect()}
    got = found.collect()
    assert len(got) == 502 and all(held[r["doc_id"]][r["start"] : r["stop"]] == r["text"] for r in got)


def test_items_are_matched_without_a_shuffle(spark):
    frame = rows(spark, ("", TABLE, RECEIPT), ("", TABLE, None), ("", TABLE, TABLE))
    assert "Exchange" not in plan(evaluate.with_item_sums(frame))
    got = evaluate.document_checks(frame, KEYS)
    assert "Exchange" not in plan(got) and got.count() == 3


def test_plain_lists_and_others_get_the_same_verdict(spark):
    item = {"description": "Paper", "quantity": 3, "unit_price": "2.00", "total": "6.00"}
    odd = [{"total": "1,2"}, {"total": "x"}, {"total": None}, {"unit_price": "~"}, {"unit_price": "1,2"}, {"unit_price": ""}, {"description": None}, {"total": "-1"}, {"quantity": "many"}]
    fine = [{"unit_price": None}, {"quantity": None}, {"quantity": 1.5}, {"total": "99999999999999"}, {"total": 5}, {"description": "a, b"}]
    # An item with one field more is not plain: its list is looked at item by item.
    lists = [(want, extra, [item, item | change]) for want, changes in ((False, odd), (True, fine)) for change in changes for extra in ({}, {"more": 1})]
    texts = [json.dumps({"vendor_name": "V", "total_amount": "6.00", "currency": "USD", "line_items": [i | extra for i in items]}) for _, extra, items in lists]
    frame = check_answers(spark.createDataFrame(list(enumerate(texts)), "n int, raw_output string")).orderBy("n")
    got = frame.collect()
    assert [r["valid"] for r in got] == [want for want, _, _ in lists]
    for plain, other in zip(got[::2], got[1::2]):
        assert (plain["errors"], plain["warnings"], plain["record"]) == (other["errors"], other["warnings"], other["record"])


def test_few_texts_are_encoded_at_a_time(spark, monkeypatch):
    sizes = []

    class Counting:
        def encode_batch_fast(self, texts, add_special_tokens):
            sizes.append(len(texts))
            return [type("E", (), {"ids": [len(t)]}) for t in texts]

    import pyarrow as pa

    monkeypatch.setattr(subwords, "_loaded", lambda path: Counting())
    monkeypatch.setattr(subwords.F, "arrow_udf", lambda f, kind: f)
    got = subwords.subword_tokens("any")(pa.array(["a" * i for i in range(100)])).to_pylist()
    assert got == [[i] for i in range(100)] and max(sizes) <= subwords.AT_A_TIME


def test_merges_of_a_growing_day_write_no_more_than_a_multiple_of_it():
    from docutally.sources.requestlog import MAX_FILES, _crowded

    batch, files, rewritten = 5_000_000, [], 0
    for n in range(1, 1001):
        files.append(batch)
        if _crowded(files):
            files, rewritten = [sum(files)], rewritten + sum(files)
    assert rewritten <= 3 * 1000 * batch
    assert _crowded([1000] * (MAX_FILES + 1)) and not _crowded([1000] * MAX_FILES)
