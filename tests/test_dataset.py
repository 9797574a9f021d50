"""Dataset building, profile and training rows against plain Python."""

import hashlib
import json
import math
import re
import tempfile
from pathlib import Path

import duckdb
import pytest
from compare import difference
from pyspark.sql import functions as F

import __spark_entry__ as entry
from docutally import fixed_values as fv
from docutally.functions.text import sha256_mod_10000
from docutally.operators import dataset, profile, training
from docutally.plans import views
from docutally.sources import jsonl

SF = "/root/testdata/sf0.001"
LABEL = {
    "vendor_name": "V", "invoice_number": None, "invoice_date": None,
    "line_items": [{"description": "d", "quantity": None, "unit_price": None, "total": "1.00"}],
    "subtotal": None, "tax_amount": None, "total_amount": "1.00", "currency": "USD",
}


def lines(path, rows):
    with open(path, "w", encoding="utf-8") as f:
        f.write("\n".join(rows))


def test_pairs_scan_skips_blank_lines_and_stops_at_bad_ones(spark):
    path = tempfile.mkdtemp() + "/pairs.jsonl"
    lines(path, [json.dumps({"raw_text": "t", "invoice": LABEL}), "", "   ", json.dumps({"raw_text": "u", "invoice": LABEL})])
    assert jsonl.read_pairs(spark, path).count() == 2
    bad = tempfile.mkdtemp() + "/bad.jsonl"
    lines(bad, [json.dumps({"raw_text": "t", "invoice": LABEL}), "{broken"])
    with pytest.raises(Exception):
        jsonl.read_pairs(spark, bad).collect()


def test_training_scan_needs_both_columns(spark):
    path = tempfile.mkdtemp() + "/train.jsonl"
    lines(path, ['{"prompt": "p", "completion": "c", "other": 1}', '{"prompt": "p"}'])
    with pytest.raises(Exception):
        jsonl.read_train(spark, path).collect()


def test_written_labels_keep_their_nulls(spark):
    path = tempfile.mkdtemp() + "/out"
    source = tempfile.mkdtemp() + "/pairs.jsonl"
    lines(source, [json.dumps({"raw_text": "t", "invoice": LABEL})])
    jsonl.write_pairs(jsonl.read_pairs(spark, source), path)
    jsonl.write_pairs(jsonl.read_pairs(spark, source), path, append=True)
    written = [json.loads(r[0]) for r in spark.read.text(path).collect()]
    assert written == [{"raw_text": "t", "invoice": LABEL}] * 2


def test_split_bucket_equals_the_whole_hash(spark):
    rows = views.documents(spark, SF).select("raw_text", sha256_mod_10000("raw_text").alias("b"), dataset.is_test_row("raw_text", 0.57).alias("t"))
    for text, bucket, is_test in rows.collect():
        assert bucket == int(hashlib.sha256(text.encode()).hexdigest(), 16) % 10000
        assert is_test == (bucket < 5699)


@pytest.mark.parametrize("name", ["valid_rate", "results_table", "missing_totals", "build_counters", "stream_extract", "outcomes"])
def test_a_very_long_document_is_one_record(spark, long_order, name):
    assert difference(entry.queries()[name](spark, long_order), long_order, entry.oracle_sql()[name]) is None


@pytest.fixture(scope="module")
def long_order(spark, tmp_path_factory):
    """The smallest tables, with one order that has over 50,000 lines."""
    folder = tmp_path_factory.mktemp("long")
    for file in Path(SF).glob("*.parquet"):
        (folder / file.name).symlink_to(file)
    with duckdb.connect() as db:
        (folder / "orders.parquet").unlink()
        (folder / "lineitem.parquet").unlink()
        db.sql(f"COPY (SELECT * FROM '{SF}/orders.parquet' ORDER BY o_orderkey LIMIT 40) TO '{folder}/orders.parquet'")
        few = f"SELECT l.* FROM '{SF}/lineitem.parquet' l WHERE l_orderkey IN (SELECT o_orderkey FROM '{folder}/orders.parquet')"
        copies = f"SELECT (SELECT max(o_orderkey) FROM '{folder}/orders.parquet') AS l_orderkey, l.* EXCLUDE (l_orderkey, l_linenumber), n::INT AS l_linenumber FROM (SELECT * FROM '{SF}/lineitem.parquet' LIMIT 10) l, range(100, 5200) t(n)"
        db.sql(f"COPY (SELECT * FROM ({few}) UNION ALL BY NAME {copies}) TO '{folder}/lineitem.parquet'")
    return str(folder)


def test_generator_depends_on_key_and_seed_only(spark):
    ids = spark.range(200).withColumnRenamed("id", "doc_id")
    one = {r["doc_id"]: r["invoice"] for r in dataset.generate_invoices(ids.repartition(7)).collect()}
    two = {r["doc_id"]: r["invoice"] for r in dataset.generate_invoices(ids.coalesce(1)).collect()}
    other = {r["doc_id"]: r["invoice"] for r in dataset.generate_invoices(ids, seed=1).collect()}
    assert one == two and one != other
    pools = {name: pool for template, pool in fv.VENDOR_TEMPLATES for name in [template.replace("{name} ", "")]}
    for label in one.values():
        pool = next(p for name, p in pools.items() if label["vendor_name"].endswith(name))
        names = [i["description"] for i in label["line_items"]]
        assert 1 <= len(names) <= 8 and set(names) <= set(pool)
        assert len(set(names[: len(pool)])) == min(len(names), len(pool))


def test_line_total_rounds_half_up(spark):
    row = spark.sql("SELECT CAST(2.5 AS DECIMAL(10,1)) q, CAST(0.01 AS DECIMAL(18,2)) u").select(dataset.line_total("q", "u")).first()
    assert str(row[0]) == "0.03"


def test_duplicates_keep_the_first_and_respect_history(spark):
    rows = spark.createDataFrame([(3, "a"), (1, "a"), (2, "b"), (4, "c")], "doc_id long, raw_text string")
    history = spark.createDataFrame([("c",), ("c",)], "raw_text string")
    kept = dataset.drop_duplicates(rows, "raw_text", "doc_id", history)
    assert sorted(r["doc_id"] for r in kept.collect()) == [1, 2]


def test_attempt_status_order(spark):
    rows = spark.createDataFrame(
        [(1, " ", False, True), (2, "a", True, True), (3, "a", False, False), (4, "a", False, True), (5, "a", False, True), (6, "old", False, True)],
        "id long, raw_text string, failed boolean, passed boolean",
    )
    history = spark.createDataFrame([("old",)], "raw_text string")
    statuses = dataset.attempt_status(rows, "raw_text", "id", F.col("failed"), F.col("passed"), history)
    found = {r["id"]: r["status"] for r in statuses.collect()}
    assert found == {1: "error", 2: "error", 3: "roundtrip", 4: "kept", 5: "duplicate", 6: "duplicate"}
    counters = dataset.build_counters(rows, "raw_text", F.col("failed"), F.col("passed"), history)
    assert {r["status"]: r["n"] for r in counters.collect()} == {"error": 2, "roundtrip": 1, "duplicate": 2, "kept": 1}


def test_vendor_ties_go_to_the_first_seen(spark):
    rows = spark.createDataFrame([(5, "x"), (1, "y"), (2, "z"), (3, "z"), (4, "x")], "doc_id long, vendor string")
    top = profile.vendor_profile(rows, "vendor", top=2).collect()
    assert [(r["vendor_name"], r["n"], r["total_rows"], r["distinct_vendors"]) for r in top] == [("z", 2, 5, 3), ("x", 2, 5, 3)]


def test_profile_of_nested_pairs(spark):
    pairs = views.pairs(spark, SF)
    assert profile.item_count_stats(pairs).first()["max_items"] >= 1
    assert profile.currency_share(pairs).count() == 4
    assert {r["field"] for r in profile.omission_rates(pairs).collect()} == set(profile.OPTIONAL_FIELDS)
    assert profile.missing_descriptions(pairs).first()["missing"] == 0
    assert profile.missing_totals(pairs).first()["missing"] == 0


@pytest.mark.parametrize("prompt_words, done_words", [(0, 3), (5, 3), (700, 3), (5, 512), (5, 600), (508, 2)])
def test_training_rows(spark, prompt_words, done_words):
    rows = spark.createDataFrame([("p " * prompt_words, "c " * done_words)], "prompt string, completion string")
    row = training.pack_training_rows(rows).first()
    done = min(done_words, 512)
    kept = 0 if done_words > 512 else min(prompt_words + 4, 512 - done)
    assert len(row["input_ids"]) == len(row["attention_mask"]) == len(row["labels"]) == 512
    assert sum(row["attention_mask"]) == kept + done
    assert row["labels"][:kept] == [-100] * kept
    assert row["labels"][kept : kept + done] == row["input_ids"][kept : kept + done]
    assert row["labels"][kept + done :] == [-100] * (512 - kept - done)
    assert all(t > 0 for t in row["input_ids"][: kept + done])


@pytest.mark.parametrize("n", [0, 1, 9, 10, 11, 333])
def test_validation_size_is_exact(spark, n):
    rows = spark.range(n).withColumnRenamed("id", "k")
    split = training.train_valid_split(rows.repartition(3), "k")
    ranked = sorted(range(n), key=lambda k: (hashlib.md5(f"42:{k}".encode()).hexdigest(), k))
    assert {r["k"] for r in split.where("split = 'valid'").collect()} == set(ranked[: math.ceil(n / 10)])
    assert split.count() == n


def test_counters_against_digests_of_a_history(spark):
    from docutally.operators import dataset

    attempts = spark.createDataFrame([("a", False, True), ("a", False, True), ("b", False, True), ("c", False, False), ("d", True, True), (" ", False, True), ("e", False, True)], "t string, failed boolean, passed boolean")
    history = spark.createDataFrame([("b",), ("b",), ("z",)], "t string")
    want = {"error": 2, "roundtrip": 1, "duplicate": 2, "kept": 2}
    for known in (history, dataset.text_digests(history, "t")):
        counted = dataset.build_counters(attempts, "t", F.col("failed"), F.col("passed"), known)
        assert {r["status"]: r["n"] for r in counted.collect()} == want
    plan = counted._jdf.queryExecution().executedPlan().toString()
    assert not any(re.search(r"\bt#\d", line) for line in plan.splitlines() if "Exchange" in line)


def test_subword_ids_are_those_of_the_file(spark):
    from tokenizers import Tokenizer

    from docutally.functions.subwords import subword_text, subword_tokens
    from docutally.operators.training import pack_training_rows

    path = "/opt/tokenizers/byte_bpe_50k.json"
    backend = Tokenizer.from_file(path)
    backend.encode_special_tokens = True
    texts = [(0, "Invoice 12 from café 😀"), (1, ""), (2, None), (3, "a <|endoftext|> b"), (4, "long " * 3000)]
    frame = spark.createDataFrame(texts, "i int, t string").select("i", "t", subword_tokens(path)(F.col("t")).alias("ids"))
    found = frame.withColumn("back", subword_text(path)(F.col("ids"))).orderBy("i").collect()
    for (_, text), row in zip(texts, found):
        assert row["ids"] == backend.encode(text or "", add_special_tokens=False).ids and row["back"] == (text or "")
    rows = spark.createDataFrame([(1, "prompt text " * 400, '{"a": "b"}'), (2, "p", "long " * 700)], "i int, prompt string, completion string")
    for row in pack_training_rows(rows, subword_tokens(path)).collect():
        done = backend.encode(row["completion"], add_special_tokens=False).ids[:512]
        assert len(row["input_ids"]) == len(row["labels"]) == len(row["attention_mask"]) == 512
        assert [x for x in row["labels"] if x != -100] == done and sum(row["attention_mask"]) == 512
        assert row["input_ids"][512 - len(done):] == done
