"""Typed evidence of a text, and item errors counted within a row."""

import random
from collections import Counter
from decimal import Decimal

from test_evaluate import KEYS, RECEIPT, TABLE, label, rows

from docutally.operators import evaluate, evidence


def read(spark, text):
    frame = spark.createDataFrame([(1, text)], "doc_id int, raw_text string")
    return [(r["kind"], r["text"]) for r in evidence.spans(frame, ["doc_id"]).orderBy("start").collect()]


def test_kinds_are_told_apart(spark):
    assert read(spark, "INV-2024-01 of 2024-01-05 or 5 Mar 2024, 3/4/24") == [("code", "INV-2024-01"), ("date", "2024-01-05"), ("date", "5 Mar 2024"), ("date", "3/4/24")]
    assert read(spark, "total 30, due: 12 x 2 = 24 USD") == [("amount", "30"), ("amount", "12"), ("quantity", "2"), ("amount", "24 USD")]
    assert read(spark, "EUR5.5 $1,250.00 8.75% 2x 3x6ft A4") == [("amount", "EUR5.5"), ("amount", "$1,250.00"), ("percent", "8.75%"), ("quantity", "2"), ("code", "3x6ft"), ("code", "A4")]
    assert read(spark, "Customer#0012 2.5 15.00. no. 9 -3.20") == [("code", "Customer#0012"), ("quantity", "2.5"), ("amount", "15.00"), ("quantity", "9"), ("amount", "-3.20")]
    assert read(spark, "no numbers") == [] and read(spark, "") == []


def test_places_hold_the_tokens(spark):
    texts = [(1, "a 😀 5.00\nb 2024-01-05 é 3 x 7.10"), (2, None), (3, "1.00 1.00 1.00")]
    frame = spark.createDataFrame(texts, "doc_id int, raw_text string")
    found = evidence.spans(frame, ["doc_id"]).collect()
    held = dict(texts)
    assert len(found) == 7 and all(held[r["doc_id"]][r["start"] : r["stop"]] == r["text"] for r in found)


def test_amounts_are_not_found_in_dates_or_quantities(spark):
    text = "Shop\n2024-03-15\nInvoice INV-77\n3.0 Paper 2.00 6.00\nTotal: 10.00 USD"
    cases = [
        (label(items=[("Paper", 3.0, "2.00", "6.00")], sub=None), 0, 0),
        (label(items=[("Paper", 3.0, "15.00", "6.00")], sub=None), 1, 0),
        (label(items=[("Paper", 3.0, "3.00", "6.00")], sub=None), 1, 0),
        (label(items=[("Paper", 3.0, "2.00", "77")], sub=None), 1, 0),
        (label(items=[("Paper", 3.0, "2.00", "6.00")], sub="15.00", tax="3.00", total="2024"), 0, 3),
        (None, 0, 0),
    ]
    found = evaluate.with_flags(rows(spark, *[(text, TABLE, pred) for pred, _, _ in cases])).orderBy("doc_id").collect()
    assert [(r["hallucinated"], r["hallucinated_amounts"]) for r in found] == [(a, b) for _, a, b in cases]


def test_item_agreement_equals_counting_pairs(spark):
    rng = random.Random(8)
    draw = lambda: [(rng.choice(["Paper", "paper ", "Ink", "Pen"]), rng.choice([1.0, 2.0, None]), rng.choice(["2.00", "2", "3.50", None]), rng.choice(["4.00", "5.00"])) for _ in range(rng.randrange(9))]
    cases = [(draw(), draw()) for _ in range(40)]
    frame = rows(spark, *[("", label(items=a), label(items=b)) for a, b in cases], ("", TABLE, None))
    found = [r["agreed"].asDict() for r in evaluate.with_item_agreement(frame).orderBy("doc_id").collect()]

    def shared(a, b, *fields):
        left, right = (Counter(tuple(i[f] for f in fields) for i in side) for side in (a, b))
        return sum((left & right).values()), sum((left - right).values()), sum((right - left).values())

    for (a, b), got in zip(cases, found):
        a, b = ([(d.strip().lower(), q, None if u is None else Decimal(u), Decimal(t)) for d, q, u, t in side] for side in (a, b))
        matched, missing, extra = shared(a, b, 0)
        want = {"matched": matched, "missing": missing, "extra": extra, "same_quantity": shared(a, b, 0, 1)[0], "same_price": shared(a, b, 0, 2)[0], "same_total": shared(a, b, 0, 3)[0]}
        assert got == want
    assert set(found[-1].values()) == {0}


def test_errors_are_counted_without_a_shuffle(spark):
    errors = evaluate.example_errors(rows(spark, ("", TABLE, RECEIPT)), KEYS)
    plan = errors._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Expand" not in plan
    table = evaluate.error_taxonomy(errors, ["model"])._jdf.queryExecution().executedPlan().toString()
    assert "Expand" not in table and table.count("Exchange") == 1
