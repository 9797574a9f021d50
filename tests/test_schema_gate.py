"""Verdicts on single answers, one boundary case per row."""

import json

import pytest

from docutally.operators.validate import check_answers, gate_error, record_json

GOOD = {"vendor_name": "V", "total_amount": "10.00"}
ITEM = {"description": "d", "total": "1.00"}
ABSENT = object()


def answer(**changes):
    fields = {**GOOD, **changes}
    return json.dumps({k: v for k, v in fields.items() if v is not ABSENT})


def item(**changes):
    fields = {**ITEM, **changes}
    return answer(line_items=[{k: v for k, v in fields.items() if v is not ABSENT}])


ACCEPTED = {
    "minimal": answer(),
    "unknown key": answer(extra=[1, {"a": 2}]),
    "number as amount": '{"vendor_name": "V", "total_amount": 1.5}',
    "whole number as amount": '{"vendor_name": "V", "total_amount": 10}',
    "padded amount": answer(total_amount=" 1.50 "),
    "exponent": answer(total_amount="1e2"),
    "minus zero": answer(total_amount="-0"),
    "underscore": answer(total_amount="1_000"),
    "very large amount": answer(total_amount="1" * 24),
    "quantity as text": item(quantity="2.5"),
    "quantity as boolean": item(quantity=True),
    "negative quantity": item(quantity=-1),
    "null unit price": item(unit_price=None),
    "date": answer(invoice_date="2024-01-01"),
    "date with T midnight": answer(invoice_date="2024-01-01T00:00:00"),
    "date with midnight": answer(invoice_date="2024-01-01 00:00:00"),
    "epoch number": '{"vendor_name": "V", "total_amount": "1", "invoice_date": 86400}',
    "epoch text": answer(invoice_date="1704067200"),
    "epoch text with fraction": answer(invoice_date="1704067200.0"),
    "epoch text with exponent": answer(invoice_date="8.64e4"),
    "underscore in quantity": item(quantity="1_0.5"),
    "null number": answer(invoice_number=None),
    "duplicate keys, last wins": '{"vendor_name": 1, "vendor_name": "V", "total_amount": "10.00"}',
    "white space around": "\n " + answer() + "\n",
}
REJECTED = {
    "null currency": (answer(currency=None), "currency:NULL"),
    "null items": (answer(line_items=None), "line_items:NULL"),
    "items not a list": (answer(line_items="x"), "line_items:NOT_A_LIST"),
    "number as number": ('{"vendor_name": "V", "total_amount": "1", "invoice_number": 7}', "invoice_number:NOT_A_STRING"),
    "numeric vendor": (answer(vendor_name=5), "vendor_name:NOT_A_STRING"),
    "null vendor": (answer(vendor_name=None), "vendor_name:NULL"),
    "vendor only": ('{"vendor_name": "V"}', "total_amount:MISSING"),
    "null total": (answer(total_amount=None), "total_amount:NULL"),
    "currency sign": (answer(total_amount="$1"), "total_amount:NOT_A_NUMBER"),
    "comma": (answer(total_amount="1,2"), "total_amount:NOT_A_NUMBER"),
    "empty amount": (answer(total_amount=""), "total_amount:NOT_A_NUMBER"),
    "boolean amount": (answer(total_amount=True), "total_amount:NOT_A_NUMBER"),
    "NaN text": (answer(total_amount="NaN"), "total_amount:NOT_A_NUMBER"),
    "negative total": (answer(total_amount="-5.00"), "total_amount:NEGATIVE"),
    "negative item total": (item(total="-1.00"), "line_items[0].total:NEGATIVE"),
    "item without description": (item(description=ABSENT), "line_items[0].description:MISSING"),
    "item without total": (item(total=ABSENT), "line_items[0].total:MISSING"),
    "item is a number": (answer(line_items=[3]), "line_items[0].description:MISSING, line_items[0].total:MISSING"),
    "quantity word": (item(quantity="x"), "line_items[0].quantity:NOT_A_NUMBER"),
    "date with slashes": (answer(invoice_date="01/02/2024"), "invoice_date:NOT_A_DATE"),
    "empty date": (answer(invoice_date=""), "invoice_date:NOT_A_DATE"),
    "padded date": (answer(invoice_date=" 2024-01-01 "), "invoice_date:NOT_A_DATE"),
    "impossible date": (answer(invoice_date="2024-02-30"), "invoice_date:NOT_A_DATE"),
    "year and month": (answer(invoice_date="2024-01"), "invoice_date:NOT_A_DATE"),
    "short month": (answer(invoice_date="2024-1-5"), "invoice_date:NOT_A_DATE"),
    "time of day": (answer(invoice_date="2024-01-01T10:00:00"), "invoice_date:NOT_A_DATE"),
    "epoch with time": (answer(invoice_date="86401"), "invoice_date:NOT_A_DATE"),
    "year zero": (answer(invoice_date="0000-01-01"), "invoice_date:NOT_A_DATE"),
    "smallest whole number as date": ('{"vendor_name": "V", "total_amount": "1", "invoice_date": -9223372036854775808}', "invoice_date:NOT_A_DATE"),
    "far day as date": ('{"vendor_name": "V", "total_amount": "1", "invoice_date": 259200000000000000}', "invoice_date:NOT_A_DATE"),
    "far day as date text": (answer(invoice_date="259200000000000000"), "invoice_date:NOT_A_DATE"),
    "tiny negative amount": (answer(total_amount="-1e-400"), "total_amount:NEGATIVE"),
    "quantity with outer underscore": (item(quantity="_1"), "line_items[0].quantity:NOT_A_NUMBER"),
    "quantity with last underscore": (item(quantity="1_"), "line_items[0].quantity:NOT_A_NUMBER"),
    "quantity with two underscores": (item(quantity="1__0"), "line_items[0].quantity:NOT_A_NUMBER"),
    "list": ("[1]", "document:NOT_AN_OBJECT"),
    "number": ("1", "document:NOT_AN_OBJECT"),
    "text": ('"s"', "document:NOT_AN_OBJECT"),
    "null": ("null", "document:NOT_AN_OBJECT"),
}
NOT_JSON = {
    "prose": "this is not json {broken",
    "empty": "",
    "trailing word": answer() + " trailing",
    "trailing bracket": answer() + "] x",
    "trailing brace": answer() + "} x",
    "two values": answer() + " " + answer(),
    "two values with comma": answer() + "," + answer(),
    "code fence": "```json\n" + answer() + "\n```",
    "single quotes": "{'vendor_name': 'V', 'total_amount': '1'}",
    "cut": answer()[:-5],
}


@pytest.fixture(scope="module")
def verdicts(spark):
    cases = {**ACCEPTED, **{k: v[0] for k, v in REJECTED.items()}, **NOT_JSON}
    rows = spark.createDataFrame(list(cases.items()), "name string, raw_output string")
    checked = check_answers(rows).withColumns({"message": gate_error(), "json": record_json("record")})
    return {r["name"]: r for r in checked.collect()}


@pytest.mark.parametrize("name", ACCEPTED)
def test_accepted(verdicts, name):
    row = verdicts[name]
    assert row["valid"], row["message"]
    assert row["message"] is None
    assert row["record"]["currency"] == "USD"


@pytest.mark.parametrize("name", REJECTED)
def test_rejected(verdicts, name):
    row = verdicts[name]
    assert row["json_valid"] and not row["valid"]
    assert ", ".join(row["errors"]) == REJECTED[name][1]
    assert row["message"].startswith("Schema validation failed")
    assert row["record"] is None


@pytest.mark.parametrize("name", NOT_JSON)
def test_not_json(verdicts, name):
    row = verdicts[name]
    assert not row["json_valid"] and not row["valid"]
    assert row["message"].startswith("Invalid JSON")


def test_values(verdicts):
    def label(name):
        return json.loads(verdicts[name]["json"])

    assert label("minimal") == {
        "vendor_name": "V", "invoice_number": None, "invoice_date": None, "line_items": [],
        "subtotal": None, "tax_amount": None, "total_amount": "10.00", "currency": "USD",
    }
    assert label("padded amount")["total_amount"] == "1.50"
    assert label("number as amount")["total_amount"] == "1.5"
    assert label("whole number as amount")["total_amount"] == "10"
    assert label("underscore")["total_amount"] == "1000"
    assert label("epoch number")["invoice_date"] == "1970-01-02"
    assert label("epoch text")["invoice_date"] == "2024-01-01"
    assert label("quantity as text")["line_items"][0]["quantity"] == 2.5
    assert label("quantity as boolean")["line_items"][0]["quantity"] == 1.0
    assert verdicts["exponent"]["record"]["total_amount"]["amount"] == 100
    large = verdicts["very large amount"]
    assert large["warnings"] == ["total_amount:AMOUNT_OUT_OF_RANGE"]
    assert large["record"]["total_amount"]["amount"] is None
