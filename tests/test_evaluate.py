"""Scores on hand-made documents with known answers."""

from pyspark.sql import functions as F

from docutally.operators import evaluate
from docutally.operators.validate import check_answers, record_label
from docutally.schemas import INVOICE

KEYS = ["model", "doc_id"]


def label(vendor="Corner Paper Shop", number="A-1", date="2024-03-15", items=(), sub="10.00", tax=None, total="10.00", currency="USD"):
    return (vendor, number, date, [tuple(i) for i in items], sub, tax, total, currency)


TABLE = label(items=[("Paper", 3.0, "2.00", "6.00"), ("Paper", 1.0, "4.00", "4.00")])
RECEIPT = label("Harbour Coffee", None, "2024-03-22", [("Latte", 2.0, None, "9.00"), ("Bagel", 1.0, None, "3.50")], None, None, "12.50")


def rows(spark, *cases):
    schema = f"model string, dataset string, doc_id int, raw_text string, raw_output string, invoice {INVOICE.simpleString()}, prediction {INVOICE.simpleString()}"
    full = [("m", "d", i, text, "{}" if pred else '{"vendor_name": "Har', truth, pred) for i, (text, truth, pred) in enumerate(cases)]
    return spark.createDataFrame(full, schema)


def test_equal_labels_score_full_marks(spark):
    frame = rows(spark, ("", TABLE, TABLE), ("", RECEIPT, RECEIPT))
    row = evaluate.results_table(frame, KEYS).first()
    assert [row[m] for m in evaluate.METRICS] == [100.0] * 5
    assert all(r["passed"] for r in evaluate.document_checks(frame, KEYS).collect())


def test_formatting_does_not_count_as_an_error(spark):
    spelled = label("  corner  PAPER shop ", "a-1", items=[("PAPER", 3.0, "2", "$6.00"), ("paper ", 1.0, "4.0", "4")], sub="$10", total="10.0")
    row = evaluate.results_table(rows(spark, ("", TABLE, spelled)), KEYS).first()
    assert [row[m] for m in evaluate.METRICS] == [100.0] * 5


def test_exponents_and_unreadable_amounts(spark):
    pairs = [("1e3", "1000", True), ("8888888888888.00", "9999999999999.00", False), ("8888888888888.00", "8888888888888.00", True), ("10.00", None, False), (None, "x", False)]
    frame = rows(spark, *[("", label(sub=a), label(sub=b)) for a, b, _ in pairs])
    found = evaluate.with_matches(frame).orderBy("doc_id").select("right.subtotal").collect()
    assert [r["subtotal"] for r in found] == [right for _, _, right in pairs]


def test_invalid_answers_count_as_all_wrong(spark):
    row = evaluate.results_table(rows(spark, ("", TABLE, TABLE), ("", RECEIPT, None)), KEYS).first()
    assert (row["valid_json"], row["field_accuracy"], row["item_recall"], row["item_precision"]) == (50.0, 50.0, 50.0, 100.0)


def test_repeated_descriptions_match_as_often_as_both_sides_have_them(spark):
    one = label(items=[("Paper", 1.0, "4.00", "4.00")])
    row = evaluate.item_prf(rows(spark, ("", TABLE, one)), ["model"], KEYS).first()
    assert (row["matched"], row["complete"], row["item_recall"], row["item_precision"]) == (1, 1, 50.0, 100.0)


def test_error_codes(spark):
    wrong = label(
        "Harbour Coffee", "X-9", "2023-03-22", [("Latte", 3.0, "4.50", "9.00"), ("Muffin", 1.0, None, "3.00")], None, "1.00", "12.00", "EUR"
    )
    text = "Harbour Coffee\n2 Latte 9.00\n1 Bagel 3.50\n12.50"
    human = spark.createDataFrame([("m", 0, "annotation", "ANNOTATION_AMBIGUITY")], "model string, doc_id int, level string, code string")
    errors = evaluate.example_errors(rows(spark, (text, RECEIPT, wrong), (text, RECEIPT, None)), KEYS, human)
    found = {(r["doc_id"], r["level"], r["code"]): r["n"] for r in errors.collect()}
    assert found == {
        (0, "document", "WRONG_INVOICE_NUMBER"): 1, (0, "document", "WRONG_DATE"): 1, (0, "document", "WRONG_TAX"): 1,
        (0, "document", "WRONG_TOTAL"): 1, (0, "document", "WRONG_CURRENCY"): 1, (0, "generation", "HALLUCINATION"): 1,
        (0, "line_item", "WRONG_DESCRIPTION"): 1, (0, "line_item", "WRONG_QUANTITY"): 1, (0, "line_item", "WRONG_UNIT_PRICE"): 1,
        (0, "annotation", "ANNOTATION_AMBIGUITY"): 1, (1, "generation", "TRUNCATION"): 1,
    }


def test_missing_prediction_row_is_an_invalid_document(spark):
    truth = rows(spark, ("", TABLE, None), ("", RECEIPT, None)).select("model", "dataset", "doc_id", "invoice")
    answers = spark.createDataFrame([("m", 0, '{"vendor_name": "corner paper shop", "total_amount": 10}')], "model string, doc_id int, raw_output string")
    predictions = check_answers(answers).select("model", "doc_id", record_label("record").alias("prediction"))
    joined = evaluate.pair_up(truth, predictions, KEYS)
    per_field = {r["field"]: r["correct"] for r in evaluate.per_field_accuracy(joined, ["model"]).collect()}
    assert per_field == {
        "vendor_name": 1, "invoice_number": 0, "invoice_date": 0, "subtotal": 0, "tax_amount": 1, "total_amount": 1, "currency": 1,
    }


def test_invented_amounts_are_no_parts_of_other_numbers(spark):
    text = "INVOICE\n- paper | 2 x 15.00 = 30.00\nTotal Due: 30.00"
    stated = label(items=[("Paper", 2.0, "15.00", "30")])
    cases = [(stated, 0), (label(items=[("Paper", 2.0, "15.00", "5.00")]), 1), (label(items=[("Paper", 2.0, "5.00", "30.00")]), 1), (label(items=[("Paper", 2.0, None, "30.00"), ("Ink", 1.0, None, "30.00")]), 1)]
    found = evaluate.with_flags(rows(spark, *[(text, stated, pred) for pred, _ in cases])).orderBy("doc_id").collect()
    assert [r["hallucinated"] for r in found] == [n for _, n in cases]


def test_a_repeated_run_replaces_itself(spark):
    import tempfile

    path = tempfile.mkdtemp()
    frame = rows(spark, ("", TABLE, TABLE), ("", RECEIPT, RECEIPT))
    for _ in range(2):
        evaluate.write_run(frame, KEYS, path, {"run_id": "7"})
    evaluate.write_run(frame.limit(1), KEYS, path, {"run_id": "8"})
    assert spark.read.parquet(f"{path}/examples").groupBy("run_id").count().orderBy("run_id").collect() == [(7, 2), (8, 1)]
    assert spark.read.parquet(f"{path}/metrics").where("run_id = 7").count() == len(evaluate.METRICS)


def test_truncation_is_an_open_end(spark):
    cases = {'{"a": 1': True, '{"a": "b': True, '{"a": [1, {"b": "}"': True, '{"a": 1} and more': False, '{"a": 1}': False, "": False, "prose": False}
    frame = spark.createDataFrame([(k,) for k in cases], "raw_output string")
    found = {r[0]: r[1] for r in frame.select("raw_output", evaluate.is_truncated()).collect()}
    assert found == cases


def test_model_delta(spark):
    schema = "model string, dataset string, " + ", ".join(f"{m} double" for m in evaluate.METRICS)
    results = spark.createDataFrame([("a", "d", 92.31, 46.15, 60.98, 92.59, 24.39), ("b", "d", 92.31, 54.95, 58.54, 70.59, 29.27)], schema)
    deltas = {r["metric"]: r["delta"] for r in evaluate.model_delta(results, "a", "b").collect()}
    assert deltas["field_accuracy"] == 8.8 and deltas["item_precision"] == -22.0 and deltas["valid_json"] == 0.0


def test_long_form_picks_one_metric(spark):
    frame = rows(spark, ("", TABLE, TABLE))
    long = evaluate.metric_long(evaluate.results_table(frame, KEYS)).where(F.col("metric") == "item_recall").collect()
    assert [(r["model"], r["value"]) for r in long] == [("m", 100.0)]
